"""Best-fit packing of token sequences by repeated patterns.

1. ``token_pieces`` tokenizes every document and cuts those longer than the capacity.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver.
3. ``pattern_plan`` groups the longer lengths into classes and enumerates the patterns of at most ``max_parts``
   classes that fill a sequence, whole or up to a gap that short pieces can fill. It fits how often to repeat
   each pattern by non-negative least squares to the histogram, with one more row for the tokens of the short
   pieces that the gaps ask for, rounds, and packs what is left (residuals and the short pieces) by best fit
   into the gaps and into new sequences. It works on runs of equal lengths, never on single pieces, so its size
   is bounded by the number of lengths.
4. Every piece gets its rank among the pieces of its length, and the plan turns (length, rank) into a sequence
   and an offset.

Null texts count as empty: such a document is the single end id. Null ids are kept as rows. Rows that repeat
an id are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import checkpointed, map_batches, text_groups
from leadloom.llm.word_tokens import codec, forget

CAPACITY = 4096
END_ID = 1
#: Length classes: pieces of a class differ by less than capacity / CLASSES.
CLASSES = 32
#: Documents in a pattern at most.
MAX_PARTS = 3
#: Pieces up to this share of the capacity are kept to fill the gaps that patterns leave.
SHORT = 4
#: Classes of gap that a pattern may leave, least and most; narrower gaps are hard to fill.
GAPS = (4, 16)
#: The pieces of one length are ranked in so many parts, so that no task holds a frequent length alone.
RANK_PARTS = 256


def token_pieces(
    df: DataFrame, model_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of each document: (id, piece, start, length, ids_crc32), and the ids themselves if wanted."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_file)
        row, piece, start, length, crc, lists = [], [], [], [], [], []
        for a, texts in text_groups(batch.column(1)):
            flat, counts = own.encode(texts)
            at = 0
            for k, n in enumerate(counts.tolist()):
                ids = np.append(flat[at:at + n], END_ID).astype("<u4")
                at += n
                for p, s in enumerate(range(0, len(ids), capacity)):
                    cut = ids[s:s + capacity]
                    row.append(a + k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        lists.append(cut.astype(np.int32))
        columns = [
            batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
        ]
        names = [id_col, "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_batches(df.select(f"`{id_col}`", f"`{text_col}`"), run, schema, lambda: forget(model_file))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| with x >= 0 by an active set: release the steepest variable, solve, step to the bound."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ b
    tiny = 1e-9 * max(1.0, np.abs(slope).max(initial=0))
    for _ in range(3 * n):
        if free.all() or slope[~free].max() <= tiny:
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (z <= 0)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min()
            x += step * (z - x)
            free &= x > tiny * 1e-3
            x[~free] = 0
        x = z
        slope = a.T @ (b - a @ x)
    return x


def patterns(longest: dict[int, int], capacity: int, max_parts: int, tight: int, gaps: tuple[int, int]) -> list[tuple[int, ...]]:
    """Falling tuples of at most ``max_parts`` classes whose longest members together leave a gap of at most
    ``tight``, or one within the bounds that short pieces can fill."""
    out, classes = [], sorted(longest, reverse=True)

    def grow(parts: tuple[int, ...], start: int, rest: int) -> None:
        if parts and (rest <= tight or gaps[0] <= rest <= gaps[1]):
            out.append(parts)
        if len(parts) < max_parts:
            for k in range(start, len(classes)):
                if longest[classes[k]] <= rest:
                    grow((*parts, classes[k]), k, rest - longest[classes[k]])

    grow((), 0, capacity)
    return out


class Plan:
    """Runs of equal treatment: pieces of ``length`` ranked from ``rank`` on go ``per`` to a sequence, the first to
    ``sequence``, beginning at ``offset``."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = defaultdict(int)
        self.sequences = 0

    def place(self, length: int, bins: int, first: int, per: int, offset: int) -> None:
        self.rows.append((length, self.used[length], first, per, offset))
        self.used[length] += bins * per

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return (rows[:, 0] << 40) + rows[:, 1], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4]


def pattern_plan(
    histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, max_parts: int = MAX_PARTS,
    short_share: int = SHORT,
) -> Plan:
    width, short = -(-capacity // classes), capacity // short_share
    plan, left = Plan(), {n: c for n, c in histogram.items() if c > 0}
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    runs: dict[int, list[list[int]]] = defaultdict(list)  # class -> its lengths, rising, with their counts
    for n in sorted(left):
        if n > short:
            runs[-(-n // width)].append([n, left[n]])
    own = {c: sum(m for _, m in rs) for c, rs in runs.items()}
    middle = {c: sum(n * m for n, m in rs) / own[c] for c, rs in runs.items()}
    longest = {c: rs[-1][0] for c, rs in runs.items()}
    choices = patterns(longest, capacity, max_parts, width, (GAPS[0] * width, GAPS[1] * width))
    if choices:
        row = {c: k for k, c in enumerate(sorted(own))}
        a = np.zeros((len(row) + 1, len(choices)))
        for k, p in enumerate(choices):
            for c in p:
                a[row[c], k] += 1
            a[-1, k] = 1 - sum(middle[c] for c in p) / capacity  # the gap, in sequences
        filler = sum(n * m for n, m in left.items() if n <= short) / capacity
        fit = non_negative_least_squares(a, np.array([*(float(own[c]) for c in row), filler]))
        for k in np.argsort(-fit, kind="stable"):
            repeat = min([int(fit[k] + 0.5), *(own[c] // choices[k].count(c) for c in choices[k])])
            if repeat <= 0:
                continue
            for c in choices[k]:
                own[c] -= repeat
            _lay_pattern(plan, runs, choices[k], repeat, capacity, gaps, left)
    _best_fit(plan, left, gaps, capacity)
    return plan


def _lay_pattern(plan: Plan, runs, pattern, repeat: int, capacity: int, gaps, left) -> None:
    """Repeat one pattern; the longest of one class meet the shortest of the next, so that sums are even."""
    slots = []
    for s, c in enumerate(pattern):
        taken, need = [], repeat
        from_top = s % 2 == 0
        while need:
            run = runs[c][-1 if from_top else 0]
            n = min(need, run[1])
            taken.append([run[0], n])
            run[1] -= n
            need -= n
            if not run[1]:
                runs[c].pop(-1 if from_top else 0)
        slots.append(taken)
    while slots[0]:
        n = min(t[0][1] for t in slots)
        first, offset = plan.sequences, 0
        plan.sequences += n
        for t in slots:
            length = t[0][0]
            plan.place(length, n, first, 1, offset)
            left[length] -= n
            offset += length
            t[0][1] -= n
            if not t[0][1]:
                t.pop(0)
        if offset < capacity:
            gaps[capacity - offset].append((first, n))


def _best_fit(plan: Plan, left: dict[int, int], gaps, capacity: int) -> None:
    """Longest first, each into the smallest gap that holds it; equal gaps and equal pieces move together."""
    order = sorted(gaps)
    for length in sorted((n for n in left if left[n] > 0), reverse=True):
        need = left[length]
        while need:
            at = bisect.bisect_left(order, length)
            if at == len(order):  # no gap holds it: new sequences, as many whole ones as this length fills
                per = capacity // length
                gap, first, bins = capacity, plan.sequences, -(-need // per)
                plan.sequences += bins
            else:
                gap = order[at]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            per = min(gap // length, need)
            full = min(bins, need // per)
            plan.place(length, full, first, per, capacity - gap)
            need -= full * per
            _open(gaps, order, gap - per * length, first, full)
            if full < bins:
                _open(gaps, order, gap, first + full, bins - full) if gap < capacity or not need else None
                if gap == capacity and need:
                    plan.place(length, 1, first + full, need, 0)
                    _open(gaps, order, gap - need * length, first + full, 1)
                    need = 0
        left[length] = 0


def _open(gaps, order: list[int], gap: int, first: int, bins: int) -> None:
    if gap > 0 and bins > 0:
        if gap not in gaps:
            bisect.insort(order, gap)
        gaps[gap].append((first, bins))


def ranked(pieces: DataFrame, id_col: str, parts: int = RANK_PARTS) -> DataFrame:
    """Number the pieces of each length from 0 without gaps, each length in ``parts`` parts."""
    split = pieces.withColumn("_part", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(parts)).cast("int"))
    own = Window.partitionBy("length", "_part").orderBy(F.col(id_col), "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = split.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    base = checkpointed(base.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    numbered = split.withColumn("_own", F.row_number().over(own) - 1)
    return (
        numbered.join(base, ["length", "_part"])
        .withColumn("_rank", F.col("_base") + F.col("_own")).drop("_part", "_base", "_own")
    )


def assigned(ranks: DataFrame, plan: Plan) -> DataFrame:
    """The sequence and the offset of every ranked piece."""
    starts, rank, first, per, offset = plan.arrays()
    columns = [c for c in ranks.columns if c != "_rank"]
    at_length, at_rank = columns.index("length"), len(columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at_length, at_rank))
        row = np.searchsorted(starts, (length << 40) + own, side="right") - 1
        nth = own - rank[row]
        sequence = first[row] + nth // per[row]
        place = offset[row] + nth % per[row] * length
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:at_rank], pa.array(sequence, pa.int64()), pa.array(place, pa.int64())], names=[*columns, "sequence_id", "offset"]
        )

    types = dict(ranks.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", sequence_id long, offset long"
    return map_batches(ranks.select(*columns, "_rank"), run, schema)


def pack(df: DataFrame, model_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = checkpointed(token_pieces(df, model_file, capacity, id_col, text_col))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return assigned(ranked(pieces, id_col), pattern_plan(histogram, capacity))
