"""DuckDB SQL of zero-phase filters and of the analytic envelope: sections as recursive common table expressions, the Hilbert transform as a sum."""

from __future__ import annotations

import math

import numpy as np

from pulseframe.operators.filters import Design, sections_of, steady
from pulseframe.sources.tables import SAMPLES_SQL


def plain_sections(order: int, edge: float, fs: float, high: bool) -> np.ndarray:
    """Sections of a low- or high-pass Butterworth of even order from the textbook biquads: K = tan(pi * edge / fs), damping 2 * sin((2k - 1) * pi / (2 * order)). Written down apart from the design under test."""
    k, out = math.tan(math.pi * edge / fs), []
    for n in range(1, order // 2 + 1):
        q = 2 * math.sin((2 * n - 1) * math.pi / (2 * order))
        below = 1 + q * k + k * k
        gain = (1 if high else k * k) / below
        out.append([gain, (-2 if high else 2) * gain, gain, 2 * (k * k - 1) / below, (1 - q * k + k * k) / below])
    return np.array(out)


def _sections(design: Design) -> np.ndarray:
    if design.kind == "butterworth" and design.order % 2 == 0 and not (design.low and design.high):
        return plain_sections(design.order, design.low or design.high, design.fs, bool(design.low))
    return sections_of(design)


def _pass(name: str, source: str, sections: np.ndarray) -> str:
    """Recursive CTE `name`(session_id, j, y): the sections over `source`(session_id, j, x), from their steady states for the first sample."""
    f = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    n = len(sections)
    states = ", ".join(f"z{k}a, z{k}b" for k in range(n))
    first, step = ["session_id", "j", "x AS v0"], ["t.session_id", "t.j", "t.x AS v0"]
    for k, s in enumerate(sections):
        b0, b1, b2, a1, a2 = s
        for rows, za, zb in ((first, f"{f(steady(s)[0])} * v{k}", f"{f(steady(s)[1])} * v{k}"), (step, f"p.z{k}a", f"p.z{k}b")):
            rows.append(f"{f(b0)} * v{k} + {za} AS v{k + 1}")
            rows.append(f"{f(b1)} * v{k} - {f(a1)} * v{k + 1} + {zb} AS n{k}a")
            rows.append(f"{f(b2)} * v{k} - {f(a2)} * v{k + 1} AS n{k}b")
    names = ", ".join(f"n{k}a, n{k}b" for k in range(n))
    return f"""{name}(session_id, j, y, {states}) AS (
  SELECT session_id, j, v{n}, {names} FROM (SELECT {", ".join(first)} FROM {source} WHERE j = 0)
  UNION ALL SELECT session_id, j, v{n}, {names} FROM (SELECT {", ".join(step)}, p.* EXCLUDE (session_id, j, y) FROM {name} p JOIN {source} t ON t.session_id = p.session_id AND t.j = p.j + 1))"""


def zero_phase_ctes(design: Design) -> str:
    """CTEs over s(session_id, idx, value), with n(session_id, n, p, x0, x1), that end in g(session_id, j, y), the filtered samples backwards from j = n + p - 1 - idx."""
    sections = _sections(design)
    pad = 3 * (2 * len(sections) + 1)
    return f"""n AS (SELECT session_id, count(*) AS n, least(count(*) - 1, {pad}) AS p, arg_min(value, idx) AS x0, arg_max(value, idx) AS x1 FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT session_id, idx + p AS j, value AS x FROM s JOIN n USING (session_id)
  UNION ALL SELECT session_id, p - idx, 2 * x0 - value FROM s JOIN n USING (session_id) WHERE idx BETWEEN 1 AND p
  UNION ALL SELECT session_id, 2 * n + p - 2 - idx, 2 * x1 - value FROM s JOIN n USING (session_id) WHERE idx BETWEEN n - 1 - p AND n - 2),
{_pass("f", "e", sections)},
r AS MATERIALIZED (SELECT session_id, n + 2 * p - 1 - j AS j, y AS x FROM f JOIN n USING (session_id)),
{_pass("g", "r", sections)}"""


def zero_phase_sql(design: Design, digits: int) -> str:
    return f"""WITH RECURSIVE {SAMPLES_SQL}, {zero_phase_ctes(design)}
SELECT session_id, n + p - 1 - j AS idx, round(CASE WHEN n = 1 THEN x0 ELSE y END, {digits}) + 0.0 AS value FROM g JOIN n USING (session_id) WHERE j BETWEEN p AND n + p - 1"""


def envelope_sql(digits: int) -> str:
    return f"""WITH {SAMPLES_SQL}, n AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.session_id, a.idx, a.value, b.value AS other, n, (a.idx - b.idx) AS d FROM s a JOIN s b USING (session_id) JOIN n USING (session_id)),
h AS (SELECT session_id, idx, value, sum(CASE WHEN d = 0 THEN 0 WHEN n % 2 = 0 AND d % 2 = 0 THEN 0 WHEN n % 2 = 0 THEN other * 2.0::DOUBLE / n * cot(pi() * d / n)
  ELSE other * 1.0::DOUBLE / n * (cot(pi() * d / n) - (CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END) / sin(pi() * d / n)) END) AS q FROM k GROUP BY 1, 2, 3)
SELECT session_id, idx, round(sqrt(value * value + q * q), {digits}) + 0.0 AS value FROM h"""
