"""Runs of identical or near-identical consecutive events, by optimal segmentation.

Events of an entity are numbers in order. A segmentation costs the squared
deviation of each event from the mean of its segment, in units of ``unit``,
plus ``penalty`` a boundary; the cheapest one is found by dynamic programming
with pruning of start points that can never win again.

The work is cut without changing the optimum:

* absent positions are boundaries in any case;
* a step of more than ``sqrt(8 * penalty)`` units between neighbours is a
  boundary of every optimal segmentation: one of the two lies at least half the
  step from the mean of a segment that held both, and two boundaries around it
  would cost less;
* an optimal boundary never lies between equal neighbours, as the cost of moving
  it is concave, so equal neighbours enter as one weighted point;
* what lies before a stretch changes the cost of a boundary within it, against that
  of a fresh start, by at most one ``penalty``, as a boundary can be put at the start.
  So where no candidate within that margin reaches over a place, the place is a
  boundary whatever comes before and after: it is certain.

An entity is handled in stretches of ``CHUNK`` positions on different tasks, however
long it is. Between the first and the last certain boundary of a stretch its runs are
done; only the points outside go on, to stretches of ``WIDER`` times as many positions,
and what is left of those is joined by entity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions of an entity that one task takes at a time, and how many such stretches the next step takes.
CHUNK, WIDER = 8192, 512
#: Candidates that the search for certain boundaries follows; where there are more it leaves the rest of the stretch open.
FOLLOW = 256

#: Fixed value: digits of other scripts that stand for 0 to 9 in labels.
DIGITS = ("０１２３４５６７８９", "0123456789")


def label_number(label: Column) -> Column:
    """The number that a label names, or NULL.

    A state may be written plainly, with sign, decimals or exponent, padded, in
    full-width digits, or behind ``s``, ``S-``, ``state`` and the like. What is not
    positive names no state.
    """
    x = F.translate(F.lower(label), *DIGITS)
    pad = r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]*"
    number = r"(?=[^e]*[1-9])\+?[0-9]+(?:\.[0-9]*)?(?:e[+-]?[0-9]+)?"
    return F.regexp_extract(x, rf"^{pad}(?:s(?:tate)?[\s_:#-]*)?({number}){pad}$", 1).try_cast("double")


def _sums(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cumulated weights, sums and sums of squares about the mean, for accuracy."""
    shift = s.sum() / n.sum()
    return tuple(np.concatenate(([0.0], np.cumsum(x))) for x in (n, s - shift * n, q - 2 * shift * s + shift * shift * n))


def _costs(live: list[int], t: int, best: list[float], sums: tuple[np.ndarray, ...], plain: tuple[list[float], ...]) -> list[float]:
    """The cost up to ``t`` with the last boundary at each live place."""
    if len(live) > 48:
        cn, cs, cq = (c[t] - c[live] for c in sums)
        return (np.asarray([best[i] for i in live]) + np.maximum(cq - cs * cs / cn, 0.0)).tolist()
    cn, cs, cq = plain
    a, b, c = cn[t], cs[t], cq[t]
    return [best[i] + max(c - cq[i] - (b - cs[i]) ** 2 / (a - cn[i]), 0.0) for i in live]


def optimal_segments(n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """Cheapest segmentation of weighted points as half-open index ranges.

    ``n``, ``s`` and ``q`` hold the weight, the sum and the sum of squares of each
    point. Start points whose cost so far cannot be won back are pruned.
    """
    m = len(n)
    if m == 1:
        return [(0, 1)]
    sums = _sums(n, s, q)
    plain = tuple(c.tolist() for c in sums)
    best, back, live = [-penalty] + [0.0] * m, [0] * (m + 1), [0]
    for t in range(1, m + 1):
        costs = _costs(live, t, best, sums, plain)
        low = min(costs)
        back[t] = live[costs.index(low)]
        best[t] = low = low + penalty
        live = [i for i, x in zip(live, costs) if x <= low]
        live.append(t)
    out, end = [], m
    while end > 0:
        out.append((back[end], end))
        end = back[end]
    return out[::-1]


def certain_boundaries(n: np.ndarray, s: np.ndarray, q: np.ndarray, penalty: float) -> list[int]:
    """Places that are boundaries of the optimum whatever points come before the first and after the last.

    A place is one if no segment covers it that may be part of an optimum. Places after
    which more than ``FOLLOW`` candidates stay are not looked at.
    """
    m = len(n)
    if m < 2:
        return []
    sums = _sums(n, s, q)
    plain = tuple(c.tolist() for c in sums)
    best, live, close = [0.0] * (m + 1), [0], [[]]
    for t in range(1, m + 1):
        costs = _costs(live, t, best, sums, plain)
        low = min(costs)
        best[t] = low + penalty
        close.append([i for i, x in zip(live, costs) if x <= low + penalty])
        live = [i for i, x in zip(live, costs) if x <= low + 2 * penalty]
        live.append(t)
        if len(live) > FOLLOW:
            break
    # segments that an optimum may hold, from the end back; those that are still open cover all up to it
    reached, covered = [False] * (t + 1), [0] * (t + 2)
    for i in live:
        reached[i] = True
        covered[i + 1] += 1
        covered[t + 1] -= 1
    for end in range(t, 0, -1):
        if reached[end]:
            for i in close[end]:
                reached[i] = True
                covered[i + 1] += 1
                covered[end] -= 1
    over = np.cumsum(covered[: t + 1])
    return [i for i in range(1, t) if reached[i] and over[i] == 0]


class _Rows:
    """Columns of weighted points in order: entity, chunk, first and last position, weight, sum, squares, peak value."""

    NAMES = ("chunk", "first", "last", "n", "s", "q", "value")

    def __init__(self, entity: pa.Array, **columns: np.ndarray):
        self.entity = entity
        self.__dict__.update(columns)

    def __len__(self) -> int:
        return len(self.first)


def _changes(entity: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it."""
    codes = entity.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([True], codes[1:] != codes[:-1]))


def _segment(fresh: np.ndarray, rows: _Rows, penalty: float, unit: float, low: np.ndarray, high: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the segment of each row, and whether it stays open as a point of its own.

    ``fresh`` marks rows that begin a segment in any case, ``low`` and ``high`` are the ends
    of the stretch of each row, ``todo`` tells the rows that are not done yet.
    """
    begins, opened = fresh | ~todo, np.zeros(len(fresh), bool)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(fresh))
    left, right = rows.first[starts] == low[starts], rows.last[ends - 1] == high[ends - 1]
    work = todo[starts] & ((ends - starts > 1) | left | right)
    for a, b, goes_left, goes_right in zip(starts[work], ends[work], left[work], right[work]):
        points = rows.n[a:b], rows.s[a:b] / unit, rows.q[a:b] / unit**2
        c, d = 0, b - a
        if goes_left or goes_right:
            sure = certain_boundaries(*points, penalty)
            if goes_left:
                c = sure[0] if sure else d
            if goes_right:
                d = max(sure[-1] if sure else 0, c) if c < d else d
            opened[a : a + c] = opened[a + d : b] = True
            begins[a : a + c] = begins[a + d : b] = True
        if c < d:
            for e, _ in optimal_segments(*(x[c:d] for x in points), penalty):
                begins[a + c + e] = True
        elif c < b - a:
            begins[a + c] = True
    return np.cumsum(begins) - 1, opened


def collapse_runs(
    df: DataFrame,
    entity: str,
    position: str,
    value: str | Column,
    penalty: float = 0.1,
    unit: float = 1.0,
    alike: float = 0.0,
    latest: str | None = None,
    stretch: int = CHUNK,
) -> DataFrame:
    """One row for each run: entity, ``value``, ``first``, ``last`` and ``n``.

    ``position`` is a whole number; an absent one ends a run, and so does a row
    with a missing ``value``. Adjoining runs whose values differ by at most ``alike`` that
    the end of a stretch brought together are one. Of several rows of a position the
    one with the greatest ``latest`` counts, rows without it as the oldest, ties by the
    greater value; without ``latest`` the greater value. ``value`` of a run is its most
    frequent one, the smaller of equals. Rows with a NULL entity or position are left
    out. Other columns are not read. An empty table gives no runs. A task takes
    ``stretch`` positions of an entity.

    Three shuffles: events by entity and stretch, which serves the choice among
    repeated rows too, then runs and what is left open, twice. Runs that are done stay
    salted by their stretch. An entity that varies for longer than a stretch, but never
    enough for one certain boundary, passes its points on to the wider stretches, at
    last to one task, as one point for each change of value.
    """
    kind = df.schema[entity].dataType
    points = (
        df.select(
            F.col(entity).alias("__e"),
            F.floor(F.col(position) / stretch).cast("long").alias("chunk"),
            F.col(position).cast("long").alias("first"),
            F.struct(*([latest] if latest else []), (F.col(value) if isinstance(value, str) else value).cast("double").alias("value")).alias("row"),
        )
        .where(F.col("__e").isNotNull() & F.col("first").isNotNull())
        .repartition("__e", "chunk")
        .groupBy("__e", "chunk", "first")
        .agg(F.max("row").alias("row"))
        .select("__e", "chunk", "first", F.col("row.value").alias("value"))
        .sortWithinPartitions("__e", "chunk", "first")
    )
    schema = T.StructType(
        [T.StructField("__e", kind), T.StructField("chunk", T.LongType()), T.StructField("open", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("first", "last", "n")]
        + [T.StructField(c, T.DoubleType()) for c in ("s", "q", "value")]
    )
    step = math.sqrt(8 * penalty) * unit

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, lambda t: _chunk_runs(t, penalty, unit, step, stretch), schema, ("__e", "chunk"))

    def across(wide: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _by_group(batches, lambda t: _join_runs(t, penalty, unit, step, wide, alike), schema, ("__e", "open", "chunk"))

        return run

    runs = points.mapInArrow(within, schema)
    for wide in (stretch * WIDER, None):
        where = F.floor(F.col("first") / wide).cast("long") if wide else F.lit(-1).cast("long")
        salted = runs.withColumn("chunk", F.when(F.col("open"), where).otherwise(F.col("chunk")))
        runs = salted.repartition("__e", "chunk").sortWithinPartitions("__e", "open", "chunk", "first").mapInArrow(across(wide), schema)
    return runs.select(F.col("__e").alias(entity), "value", "first", "last", "n")


def _by_group(batches, work, schema: T.StructType, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """``work`` on tables that end where a group ends; the rest of a batch waits for the next."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target, rest = to_arrow_schema(schema), None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            change |= _changes(t[k].combine_chunks())
        cut = int(np.flatnonzero(change)[-1])
        t, rest = t.slice(0, cut), t.slice(cut)
        if t.num_rows:
            yield from work(t).cast(target).to_batches()
    if rest is not None and rest.num_rows:
        yield from work(rest).cast(target).to_batches()


def _take(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().to_numpy(zero_copy_only=False)


def _runs(entity: pa.Array, chunk: np.ndarray, rows: _Rows, seg: np.ndarray, opened: np.ndarray) -> pa.Table:
    """A row for each segment of consecutive rows."""
    if not len(seg):
        none = {c: rows.first for c in ("first", "last", "n", "s", "q", "value")}
        return pa.table({"__e": entity, "chunk": chunk, "open": opened} | none)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    ends = np.append(starts[1:], len(seg))
    total = lambda x: np.add.reduceat(x, starts)
    value = rows.value[starts].copy()
    for i in np.flatnonzero(ends - starts > 1):
        v, k = np.unique(rows.value[starts[i] : ends[i]], return_inverse=True)
        value[i] = v[int(np.argmax(np.bincount(k, weights=rows.n[starts[i] : ends[i]])))]
    return pa.table(
        {
            "__e": entity.take(pa.array(starts)),
            "chunk": chunk[starts],
            "open": opened[starts],
            "first": rows.first[starts],
            "last": rows.last[ends - 1],
            "n": total(rows.n),
            "s": total(rows.s),
            "q": total(rows.q),
            "value": value,
        }
    )


def _chunk_runs(t: pa.Table, penalty: float, unit: float, step: float, stretch: int) -> pa.Table:
    """Runs of whole stretches; what may go on in a neighbouring stretch stays open, as weighted points."""
    t = t.filter(pa.array(np.isfinite(_take(t, "value").astype(float))))
    if not t.num_rows:
        return _runs(t["__e"].combine_chunks(), np.zeros(0, int), _Rows(None, **dict.fromkeys(("first", "last", "n", "s", "q", "value"), np.zeros(0))), np.zeros(0), np.zeros(0, bool))
    entity, chunk, first, value = t["__e"].combine_chunks(), _take(t, "chunk"), _take(t, "first"), _take(t, "value").astype(float)
    group = _changes(entity) | np.concatenate(([True], chunk[1:] != chunk[:-1]))
    fresh = group | np.concatenate(([True], (first[1:] != first[:-1] + 1) | (np.abs(np.diff(value)) > step)))
    same = ~fresh & np.concatenate(([False], value[1:] == value[:-1]))
    at = np.flatnonzero(~same)  # equal neighbours become one point
    n = np.diff(np.append(at, len(first)))
    rows = _Rows(None, first=first[at], last=first[at] + n - 1, n=n, s=n * value[at], q=n * value[at] ** 2, value=value[at])
    fresh, chunk = fresh[at], chunk[at]
    entity = entity.take(pa.array(at))
    low = chunk * stretch
    seg, opened = _segment(fresh, rows, penalty, unit, low, low + stretch - 1, np.ones(len(fresh), bool))
    return _runs(entity, chunk, rows, seg, opened)


def _join_runs(t: pa.Table, penalty: float, unit: float, step: float, wide: int | None, alike: float) -> pa.Table:
    """Segments of the open points of an entity in wider stretches, at last in all; what is done passes through."""
    entity, todo, chunk = t["__e"].combine_chunks(), _take(t, "open").astype(bool), _take(t, "chunk")
    rows = _Rows(None, **{c: _take(t, c) for c in ("first", "last", "n", "s", "q", "value")})
    group = _changes(entity) | np.concatenate(([True], (todo[1:] != todo[:-1]) | (chunk[1:] != chunk[:-1])))
    apart = np.concatenate(([True], rows.first[1:] != rows.last[:-1] + 1))
    fresh = group | ~todo | apart | np.concatenate(([True], np.abs(np.diff(rows.value)) > step))
    if not todo.any():
        return _runs(entity, chunk, rows, np.arange(len(todo)), todo)
    none = np.full(len(todo), np.iinfo(np.int64).min)
    low = chunk * wide if wide else none
    seg, opened = _segment(fresh, rows, penalty, unit, low, low + wide - 1 if wide else none, todo)
    out = _runs(entity, chunk, rows, seg, opened)
    if alike <= 0 or not out.num_rows:
        return out
    # runs that are done and name one value are one
    entity, value, closed = out["__e"].combine_chunks(), _take(out, "value"), ~_take(out, "open").astype(bool)
    first, last, chunk = _take(out, "first"), _take(out, "last"), _take(out, "chunk")
    come = np.add.reduceat(todo, np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))) > 0
    new = _changes(entity)
    new[1:] |= ~(closed & come)[1:] | ~(closed & come)[:-1] | (chunk[1:] != chunk[:-1]) | (first[1:] != last[:-1] + 1) | (np.abs(np.diff(value)) > alike)
    rows = _Rows(None, **{c: _take(out, c) for c in ("first", "last", "n", "s", "q", "value")})
    return _runs(entity, chunk, rows, np.cumsum(new) - 1, ~closed)


#: Squared states that a boundary costs. Below a quarter every change of state is a boundary of the
#: optimum: n alternating states cost n / 4 in one segment, and n - 1 boundaries less. Noise of
#: 0.001 would be divided only after 200,000 frames.
STATE_PENALTY = 0.2
#: How far a label may lie from the whole number that it names.
STATE_NOISE = 0.001


def state_runs(frames: DataFrame, meta: DataFrame, unit: float = STATE_NOISE) -> DataFrame:
    """Each longest stretch of consecutive frames in one state, with its number of frames and its duration.

    Columns ``traj_id``, ``state``, ``first_frame``, ``last_frame``, ``n_frames`` and
    ``duration_ps``, which is NULL where the trajectory has no usable ``step_ps``.
    Of several rows of a frame the one with the latest ``loaded_at`` counts. Labels
    name numbers as :func:`label_number` reads them; one that is not within
    ``STATE_NOISE`` of a positive whole number names no state and is missing. The
    numbers go to the segmentation as they are; see :func:`collapse_runs`.
    """
    number = label_number(F.col("label"))
    named = F.when(F.abs(number - F.rint(number)) <= STATE_NOISE, number)
    runs = collapse_runs(frames, "traj_id", "frame", named, STATE_PENALTY / unit**2, unit, alike=2 * STATE_NOISE, latest="loaded_at")
    runs = runs.withColumn("value", F.rint("value")).where(F.col("value") > 0)
    steps = (
        meta.where(F.col("traj_id").isNotNull())
        .groupBy("traj_id")
        .agg(F.max(F.struct("gathered_at", "step_ps")).getField("step_ps").alias("__step"))
        .select("traj_id", F.when((F.col("__step") > 0) & ~F.isnan("__step"), F.col("__step")).alias("__step"))
    )
    return runs.join(steps, "traj_id", "left").select(
        "traj_id",
        F.col("value").cast("long").alias("state"),
        F.col("first").alias("first_frame"),
        F.col("last").alias("last_frame"),
        F.col("n").alias("n_frames"),
        (F.col("n") * F.col("__step")).alias("duration_ps"),
    )
