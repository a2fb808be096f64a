"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its evidence is what its own bytes and those of the lines before and after show; neighbours are
also tied by transition weights. Forward-backward gives each line's marginal, and their mean weighted by line length is the
document's score.

Lines have no labels of their own. A document labelled good has only good lines; one labelled bad has at least one bad line, and
which one is latent. The model maximises the likelihood of these two events, so that transitions between good and bad lines
are learned too. It is fitted on the driver on a bounded sample of whole texts, `max_docs` labelled documents (those whose ids
hash lowest). Scoring covers whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import vectext as V
from pulseframe.llm.scratch import in_small_batches

MAX_DOCS = 6000
_BLOCK = 512  # lines of a long text that are passed through one after the other
_PIECE = 1 << 16  # lines of a long text whose features are held at a time

#: Byte classes that are counted in each line. Second bytes 0x80-0x9E after 0xC3 are the capital letters of Latin-1.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:")
_TABLE = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _TABLE[list(_chars)] = _k + 1
OWN = len(_CLASSES) + 4


@dataclass(frozen=True)
class Model:
    """unary: weights of a line's features for 'good'; pair[i][j]: weight of state j after state i."""

    unary: np.ndarray
    pair: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # slope and offset, on the log odds, of a document's mean marginal


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-separated lines of all rows, and each row's first line; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    counts = np.bincount(row_of_break, minlength=len(offsets) - 1)[: len(offsets) - 1] + 1
    firsts = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=firsts[1:])
    starts = np.empty_like(ends)
    starts[firsts[:-1]] = offsets[:-1]
    later = np.ones(len(ends), bool)
    later[firsts[:-1]] = False
    starts[later] = breaks + 1
    ends = np.empty_like(starts)
    last = firsts[1:] - 1
    ends[last] = offsets[1:]
    inner = np.ones(len(ends), bool)
    inner[last] = False
    ends[inner] = breaks
    return starts, ends, firsts


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line and its neighbours, length of each line in bytes, first line of each row)."""
    starts, ends, firsts = lines_of(data, offsets)
    length = ends - starts
    size = np.maximum(length, 1).astype(np.float64)
    own = np.zeros((len(starts), OWN))
    kinds = _TABLE[data]
    capital = np.zeros(len(data), bool)
    if len(data):
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    for k in range(len(_CLASSES)):
        hit = kinds == k + 1
        if k == 0:
            hit |= capital
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(hit, out=total[1:])
        own[:, k] = (total[ends] - total[starts]) / size
    word_starts, word_ends, _ = V.word_spans(data, offsets, V.SPACE)
    hashes = V.span_hashes(data, word_starts, word_ends)
    of_line = np.searchsorted(starts, word_starts, side="right") - 1
    n_words = np.bincount(of_line, minlength=len(starts))[: len(starts)]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])
    own[:, -4] = np.bincount(of_line, again, minlength=len(starts))[: len(starts)] / np.maximum(n_words, 1)
    own[:, -3] = np.minimum(n_words / size * 4, 2)
    own[:, -2] = np.log1p(length) / 8
    own[:, -1] = n_words == 0
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[firsts[:-1]] = 0
    after[firsts[1:] - 1] = 0
    edge = np.zeros((len(own), 2))
    edge[firsts[:-1], 0] = 1
    edge[firsts[1:] - 1, 1] = 1
    return np.concatenate([np.ones((len(own), 1)), own, before, after, edge], axis=1), length, firsts


def _step(state: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Log odds of the next line's states, before its own evidence."""
    return np.logaddexp(pair[1, 1] + state, pair[0, 1]) - np.logaddexp(pair[1, 0] + state, pair[0, 0])


def _back(state: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return np.logaddexp(pair[1, 1] + state, pair[1, 0]) - np.logaddexp(pair[0, 1] + state, pair[0, 0])


def messages(evidence: np.ndarray, firsts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (own evidence included) and backward log odds (excluded) of every line of ragged rows.

    Rows advance together, line by line. Longer ones are cut into blocks: the blocks' transfer matrices, combined along each row, give the
    odds at their borders, and then blocks advance together. That is exact.
    """
    counts = np.diff(firsts)
    blocks = -(-counts // _BLOCK)
    row = np.repeat(np.arange(len(counts)), blocks)
    number = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    heads = firsts[row] + number * _BLOCK
    tails = np.minimum(heads + _BLOCK, firsts[row + 1]) - 1
    size = tails - heads + 1
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    ahead, behind = evidence.copy(), np.zeros_like(evidence)
    if len(row) > len(counts):
        across = np.empty((len(row), 2, 2))  # log weight from the state before the block to that of its last line
        across[:] = np.where(number > 0, 1.0, 0.0)[:, None, None] * pair + evidence[heads][:, None, None] * np.array([0.0, 1.0])  # a row's first line has no state before it
        for t in range(1, int(size.max())):
            live = order[: int(np.searchsorted(falling, -t, side="left"))]
            own = np.logaddexp(across[live, :, 0, None] + pair[0], across[live, :, 1, None] + pair[1])
            across[live] = own + evidence[heads[live] + t][:, None, None] * np.array([0.0, 1.0])
        opening = np.cumsum(blocks) - blocks
        at = opening[blocks > 1]
        state = across[at, 0]
        left = blocks[blocks > 1] - 1
        while len(at):
            at = at + 1
            ahead[heads[at]] += _step(state[:, 1] - state[:, 0], pair)
            state = np.logaddexp(state[:, 0, None] + across[at, 0], state[:, 1, None] + across[at, 1])
            left = left - 1
            at, state, left = at[left > 0], state[left > 0], left[left > 0]
        at, state = opening[blocks > 1] + blocks[blocks > 1] - 1, np.zeros((int((blocks > 1).sum()), 2))
        left = blocks[blocks > 1] - 1
        while len(at):
            state = np.logaddexp(across[at, :, 0] + state[:, 0, None], across[at, :, 1] + state[:, 1, None])
            at = at - 1
            behind[tails[at]] = state[:, 1] - state[:, 0]
            left = left - 1
            at, state, left = at[left > 0], state[left > 0], left[left > 0]
    heads, tails = heads[order], tails[order]
    for t in range(1, int(size.max(initial=0))):
        n = int(np.searchsorted(falling, -t, side="left"))  # blocks with more than t lines
        at = heads[:n] + t
        ahead[at] += _step(ahead[at - 1], pair)
        at = tails[:n] - t
        behind[at] = _back(behind[at + 1] + evidence[at + 1], pair)
    return ahead, behind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(features: list[np.ndarray], labels: np.ndarray, steps: int = 250, rate: float = 0.15, ridge: float = 1e-4) -> Model:
    """Maximum likelihood of 'all lines are good' for label 1 and 'some line is bad' for label 0, by Adam. Without both labels every text scores 0.5 or so.

    A good document's log-likelihood is divided by its number of lines, and each label has half of the weight.
    """
    width = 3 * OWN + 3
    if not features:
        return Model(np.zeros(width), np.zeros((2, 2)))
    counts = np.array([len(f) for f in features])
    firsts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=firsts[1:])
    x = np.concatenate(features)
    good = labels.astype(bool)
    share = np.where(good, 0.5 / max(good.sum(), 1) / counts, 0.5 / max((~good).sum(), 1))
    row = np.repeat(np.arange(len(counts)), counts)
    has_next = np.ones(len(x), bool)
    has_next[firsts[1:] - 1] = False
    at = np.flatnonzero(has_next)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for k in range(1, steps + 1):
        weight, gap, joint = _pull(x, firsts, good, at, row, theta, share)
        grad = np.empty_like(theta)
        grad[:width] = x.T @ (weight[row] * gap).astype(np.float32)
        grad[width:] = np.array([0.0, 0.0, 0.0, weight[row[at]].sum()]) - joint @ weight[row[at]]
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    model = Model(theta[:width], theta[width:].reshape(2, 2))
    length = np.rint(np.expm1(x[:, OWN - 1] * 8))
    return Model(model.unary, model.pair, _calibrated(document_scores(x @ model.unary, length, firsts, model), labels.astype(np.float64)))


def _pull(x: np.ndarray, firsts: np.ndarray, good: np.ndarray, at: np.ndarray, row: np.ndarray, theta: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weight of each document in the gradient, 1 - P(good) of each line, and P(states) of each transition.

    Both gradients point along f(all good) - E[f]: for log P(all good) by 1, for log(1 - P(all good)) by -P / (1 - P).
    """
    pair = theta[-4:].reshape(2, 2)
    evidence = (x @ theta[:-4].astype(np.float32)).astype(np.float64)
    ahead, behind = messages(evidence, firsts, pair)
    right = evidence[at + 1] + behind[at + 1]
    logits = np.stack([pair[i, j] + i * ahead[at] + j * right for i in (0, 1) for j in (0, 1)])
    logits -= logits.max(axis=0)
    joint = np.exp(logits)
    joint /= joint.sum(axis=0)
    log_all = -np.logaddexp(0, -(ahead + behind)[firsts[:-1]])
    stay = logits[3] - np.logaddexp(logits[2], logits[3])  # log P(next is good | this is good)
    log_all = log_all + np.bincount(row[at], stay, minlength=len(log_all))
    all_good = np.exp(np.minimum(log_all, -1e-9))
    weight = share * np.where(good, 1.0, -np.minimum(all_good / (1 - all_good), 50.0))
    return weight, 1 - _sigmoid(ahead + behind), joint


def _calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression of the labels on the scores' log odds, by Newton steps; (1, 0) if a label is missing."""
    if y.min() == y.max():
        return 1.0, 0.0
    x = np.stack([_logit(raw), np.ones(len(raw))])
    beta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(beta @ x)
        grad = x @ (y - p) - (beta - prior)
        beta = beta + np.linalg.solve((x * (p * (1 - p))) @ x.T + np.eye(2), grad)
    return max(float(beta[0]), 1e-3), float(beta[1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def document_scores(evidence: np.ndarray, length: np.ndarray, firsts: np.ndarray, model: Model) -> np.ndarray:
    """The length-weighted mean of the lines' marginals, calibrated, for each row."""
    ahead, behind = messages(evidence, firsts, model.pair)
    weight = np.maximum(length, 1).astype(np.float64)
    mean = np.add.reduceat(weight * _sigmoid(ahead + behind), firsts[:-1]) / np.add.reduceat(weight, firsts[:-1])
    return mean if model.scale == (1.0, 0.0) else _sigmoid(model.scale[0] * _logit(mean) + model.scale[1])


def evidence_of(data: np.ndarray, offsets: np.ndarray, unary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence and length of each line, first line of each row). The features of a text with very many lines are made piece by piece."""
    if len(offsets) != 2 or len(data) <= _PIECE:
        x, length, firsts = line_features(data, offsets)
        return x @ unary, length, firsts
    starts, ends, firsts = lines_of(data, offsets)
    n, found = len(starts), []
    for a in range(0, n, _PIECE):
        b = min(a + _PIECE, n)
        lo, hi = max(a - 1, 0), min(b + 1, n)  # the neighbours of the piece's ends go along
        own = data[starts[lo] : ends[hi - 1]]
        x = line_features(own, np.array([0, len(own)]))[0][a - lo : b - lo]
        x[:, -2:] = 0
        x[0, -2], x[-1, -1] = a == 0, b == n
        found.append(x @ unary)
    return np.concatenate(found), ends - starts, firsts


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in V.chunks(batch.column("text")):
            x, _, firsts = line_features(data, offsets)
            blobs = [x[firsts[i] : firsts[i + 1]].astype(np.float32).tobytes() for i in range(len(firsts) - 1)]
            yield pa.RecordBatch.from_arrays([batch.slice(first, len(blobs)).column("doc_id"), batch.slice(first, len(blobs)).column("label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, max_docs: int = MAX_DOCS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, label 0/1), on the whole texts of at most max_docs ids; `where` chooses label rows.

    Rows with a null id or label are no labels; of several labels of an id the larger counts, and of several texts each. Null and
    empty texts are one empty line. Empty tables give a model that scores 0.5 or so. Other columns are ignored. The sample is bounded in
    documents, not in lines: the features of its whole texts are held on the driver, so labelled texts of millions of lines take memory and time there.
    """
    rows = labels.filter("doc_id is not null and label is not null")
    if where is not None:
        rows = rows.filter(where)
    chosen = rows.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    found = in_small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_sampled, "doc_id long, label int, x binary")
    sample = found.toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])  # at most max_docs ids
    width = 3 * OWN + 3
    features = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, width) for x in sample["x"]]
    return fit(features, np.asarray(sample["label"]))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in V.chunks(batch.column("text")):
            good = document_scores(*evidence_of(data, offsets, model.unary), model)
            rows = batch.slice(first, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(rows.columns, rows.schema.names, strict=True) if n != "text"), pa.array(np.clip(good, 0.0, 1.0))], names=[*(n for n in rows.schema.names if n != "text"), "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score in 0..1), one row for each row. Null and empty texts are one empty line and get a score too; repeated rows score alike; other columns are ignored; an empty table gives an empty result. Very long texts are scored whole."""
    return in_small_batches(docs).select("doc_id", "text").mapInArrow(partial(_scored, model=model), "doc_id long, score double")


def _kept(batches: Iterator[pa.RecordBatch], model: Model, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [s.column("score") for s in _scored(iter([batch.select(["text"])]), model)]
        yield batch.filter(pa.array(np.concatenate([np.asarray(s) for s in scores]) >= least)) if scores else batch


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs with a score of `least` or more, all columns unchanged, whatever they are called; docs needs a column text. Null and empty texts are judged like others; an empty table stays empty."""
    return in_small_batches(docs).mapInArrow(partial(_kept, model=model, least=least), docs.schema)
