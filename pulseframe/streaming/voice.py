"""Voice activity on a stream: the segments and pauses of the batch plans, from frames that arrive in any order and any micro-batches.

A session's state is a few numbers for each pad length, the frames that came before their turn, and, for pauses, its segments so far.
Frames are numbered, so each is judged when all before it have been; when the watermark passes a session's last frame by
`ended`, gaps are given up, what still waits is judged in order, and the session closes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class Detector:
    """On after `pad` speech frames in a row, off after as many without: the frames judged so far, the runs that end at the last one, and the open segment."""

    pad: int
    n: int = 0
    voiced: int = 0
    quiet: int = 0
    on: int | None = None
    segment: int = 0

    def take(self, speech: bool) -> tuple[int, int, int] | None:
        """The segment (number, first frame, frame after the last) that this frame closes."""
        self.voiced, self.quiet = (self.voiced + 1, 0) if speech else (0, self.quiet + 1)
        self.n += 1
        if self.on is None and self.voiced >= self.pad:
            self.on = self.n - 1
        elif self.on is not None and self.quiet >= self.pad:
            return self._closed(self.n - self.pad + 1)
        return None

    def close(self) -> tuple[int, int, int] | None:
        """The segment that is open at the session's end."""
        if self.on is None:
            return None
        return self._closed(max(self.on + 1, self.n - self.pad) if self.on < self.n - 1 else self.n)

    def _closed(self, stop: int) -> tuple[int, int, int]:
        found = (self.segment, self.on - self.pad + 1, stop)
        self.on, self.segment = None, self.segment + 1
        return found


@dataclass
class Session:
    """What a session has been through: waiting frames by number, the detectors, and their segments where those are kept."""

    detectors: list[Detector]
    waiting: dict[int, bool] = field(default_factory=dict)
    kept: list[list[tuple[int, int, int]]] = field(default_factory=list)
    last: int = 0

    @classmethod
    def read(cls, text: str) -> Session:
        raw = json.loads(text)
        return cls([Detector(**d) for d in raw["detectors"]], {int(k): v for k, v in raw["waiting"].items()}, [[tuple(s) for s in own] for own in raw["kept"]], raw["last"])

    def text(self) -> str:
        return json.dumps(asdict(self))

    def judge(self, everything: bool) -> list[list[tuple[int, int, int]]]:
        """The segments of each detector that the frames whose turn has come, or all that wait, close."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.detectors]
        while self.waiting:
            at = min(self.waiting) if everything else self.detectors[0].n
            if at not in self.waiting:
                break
            speech = self.waiting.pop(at)
            for detector, found in zip(self.detectors, out, strict=True):
                closed = detector.take(speech)
                found += [closed] if closed else []
        if everything:
            for detector, found in zip(self.detectors, out, strict=True):
                closed = detector.close()
                found += [closed] if closed else []
        return out


def _advance(frames: Iterator[pd.DataFrame], state: GroupState, pads: list[int], ended_ms: int) -> tuple[Session, list[list[tuple[int, int, int]]], bool]:
    """The session, the segments that close now, and whether it is over."""
    session = Session.read(state.get[0]) if state.exists else Session([Detector(p) for p in pads], kept=[[] for _ in pads])
    if state.hasTimedOut:
        found = session.judge(everything=True)
        state.remove()
        return session, found, True
    for batch in frames:
        for idx, speech, at in zip(batch["idx"], batch["speech"], batch["ts"], strict=True):
            session.last = max(session.last, int(pd.Timestamp(at).timestamp() * 1000))
            if idx >= session.detectors[0].n:
                session.waiting[int(idx)] = bool(speech)
    return session, session.judge(everything=False), False


def _keep(session: Session, state: GroupState, ended_ms: int) -> None:
    state.update((session.text(),))
    state.setTimeoutTimestamp(max(session.last + ended_ms, state.getCurrentWatermarkMs() + 1))


def _segments(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, pad: int, dur: float, ended_ms: int) -> Iterator[pd.DataFrame]:
    session, (found,), over = _advance(frames, state, [pad], ended_ms)
    if not over:
        _keep(session, state, ended_ms)
    yield pd.DataFrame([(key[0], k, a * dur, b * dur) for k, a, b in found], columns=["session_id", "segment", "start", "stop"])


def _silence(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, long_pad: int, short_pad: int, dur: float, ended_ms: int) -> Iterator[pd.DataFrame]:
    session, found, over = _advance(frames, state, [long_pad, short_pad], ended_ms)
    for kept, new in zip(session.kept, found, strict=True):
        kept += new
    columns = ["session_id", "total", "speaking", "n_pauses", "pause_time", "pause_fraction"]
    if not over:
        _keep(session, state, ended_ms)
        yield pd.DataFrame([], columns=columns)
        return
    wide, short = ([(a * dur, b * dur) for _, a, b in own] for own in session.kept)
    inside = [s for s in short if wide and min(a for a, _ in wide) <= s[0] <= max(b for _, b in wide)]
    rows = []
    if inside:
        total, gaps = inside[-1][1] - inside[0][0], sum((b[0] - a[1] for a, b in zip(inside, inside[1:])), 0.0)
        rows.append((key[0], total, sum(b - a for a, b in inside), len(inside) - 1, gaps, gaps / total if total else None))
    yield pd.DataFrame(rows, columns=columns)


def _stateful(stream: DataFrame, run, schema: str, late: str) -> DataFrame:  # noqa: ANN001
    timed = stream.select("session_id", "idx", "ts", "speech").withWatermark("ts", late)
    return timed.groupBy("session_id").applyInPandasWithState(run, schema, "session string", "append", GroupStateTimeout.EventTimeTimeout)


def vad_segments(stream: DataFrame, pad_frames: int, dur: float, late: str = "10 seconds", ended: float = 10.0) -> DataFrame:
    """(session_id, segment, start, stop) of a stream of frames(session_id, idx from 0, ts, speech), each when it closes; operators.speech.vad_segments on a stream.

    Frames later than `late` behind the newest are left out; a session without a frame for `ended` seconds of event time is over.
    """
    return _stateful(stream, partial(_segments, pad=pad_frames, dur=dur, ended_ms=int(ended * 1000)), "session_id long, segment long, start double, stop double", late)


def silence(stream: DataFrame, dur: float, long_pad: int = 10, short_pad: int = 5, late: str = "10 seconds", ended: float = 10.0) -> DataFrame:
    """(session_id, total, speaking, n_pauses, pause_time, pause_fraction) of each session of a stream of frames when it is over; operators.speech.silence on a stream."""
    run = partial(_silence, long_pad=long_pad, short_pad=short_pad, dur=dur, ended_ms=int(ended * 1000))
    return _stateful(stream, run, "session_id long, total double, speaking double, n_pauses long, pause_time double, pause_fraction double", late)
