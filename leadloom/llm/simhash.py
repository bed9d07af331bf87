"""SimHash near-duplicates with bit-sliced comparison.

1. ``fingerprints``: 64 bits per document from the hashes of its three-word shingles.
2. Equal fingerprints are one node from here on, so copies cost nothing.
3. Two fingerprints within ``RADIUS`` bits agree in at least two of four 16-bit blocks: every fingerprint goes
   to six tables keyed by two of its blocks. A bucket of more than ``DENSE`` members is divided once more by
   the same rule over its 32 open bits, after which at most 2**16 different members share a bucket.
4. ``bucket_labels`` compares within buckets: bit planes of 64 members lie in one word, a carry-save counter
   adds up 64 distances with a few word operations per bit, and a block is abandoned once every lane has
   overflowed the radius.
5. Links of a bucket shrink to a chain per connected class; ``components`` joins the chains.

Null and empty texts have fingerprint zero. Documents with a null id take part but never name a class; a class
without any id has a null component. Rows that repeat an id each get a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import checkpointed, map_batches, spans, text_groups
from leadloom.llm.components import components, local_labels

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Members from which a bucket is divided further.
DENSE = 256
#: Shingles hashed, lanes laid out and comparisons made at a time.
PART_SHINGLES, PART_BLOCKS, PART_ROWS = 1 << 16, 1 << 12, 1 << 15
ALL = np.uint64(2**64 - 1)


def fingerprint(text: str) -> int:
    """Bit by bit the majority of the hashes of all word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: only A-Z changes, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(SHINGLE, len(words))
    first, last = starts[:len(words) - span + 1].tolist(), ends[span - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(first), PART_SHINGLES):
        pairs = zip(first[k:k + PART_SHINGLES], last[k:k + PART_SHINGLES])
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for _, texts in text_groups(batch.column(1)) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    return map_batches(df.select(f"`{id_col}`", f"`{text_col}`"), run, f"`{id_col}` {dict(df.dtypes)[id_col]}, fp long")


def bit_planes(fp: np.ndarray, block: np.ndarray, lane: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """planes[bit, block]: that bit of the block's 64 members; and the lanes in use."""
    bits = np.zeros((blocks, 64, BITS), np.uint8)
    bits[block, lane] = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]
    used = np.zeros((blocks, 64), np.uint8)
    used[block, lane] = 1
    return np.ascontiguousarray(planes), np.ascontiguousarray(np.packbits(used, axis=1, bitorder="little")).view("<u8")[:, 0]


def near_lanes(planes: np.ndarray, used: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, block): a word with a bit for every lane within the radius.

    The counter starts so high that it overflows at radius + 1 differences; an overflow stays.
    """
    digits = max(1, radius.bit_length())
    near = np.zeros(len(query), np.uint64)
    alive = np.arange(len(query))
    start = (1 << digits) - 1 - radius
    counter = [np.full(len(query), ALL if start >> d & 1 else np.uint64(0)) for d in range(digits)]
    over = ~used[block]
    for bit in range(BITS):
        carry = planes[bit, block] ^ (np.uint64(0) - ((query >> np.uint64(bit)) & np.uint64(1)))
        for d in range(digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if bit % 8 == 7:
            kept = over != ALL
            if not kept.all():  # abandon the blocks in which every lane is beyond the radius
                alive, query, block, over = alive[kept], query[kept], block[kept], over[kept]
                counter = [c[kept] for c in counter]
                if not len(alive):
                    return near
    near[alive] = ~over
    return near


def bucket_labels(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For fingerprints sorted by bucket: the first member of each one's class within its bucket."""
    size = len(fp)
    labels = np.arange(size)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, size])
    own = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(size) - starts[own]
    blocks_of = -(-sizes // 64)
    block_base = np.cumsum(blocks_of) - blocks_of
    block = block_base[own] + within // 64
    last_block = (block_base + blocks_of - 1)[own]
    block_first = np.flatnonzero(within % 64 == 0)  # the member in lane 0 of each block
    planes, used = bit_planes(fp, block, within % 64, int(blocks_of.sum()))
    rows = last_block - block + 1  # each member against its own and the later blocks of its bucket
    ends = np.cumsum(rows)
    at = 0
    while at < size:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_ROWS, side="right")))
        who = np.repeat(np.arange(at, stop), rows[at:stop])
        where = spans(block[at:stop], rows[at:stop])
        hits = near_lanes(planes, used, fp[who], where, radius)
        same = where == block[who]
        later = ALL << np.minimum(within[who] % 64 + 1, 63).astype(np.uint64)
        later[within[who] % 64 == 63] = 0
        hits[same] &= later[same]
        found = np.flatnonzero(hits)
        if len(found):
            row, lane = np.nonzero(np.unpackbits(hits[found].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            labels = local_labels(size, who[found][row], block_first[where[found][row]] + lane, labels)
        at = stop
    return labels


def chains(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between consecutive members of each class, which keep it connected without a hub."""
    labels = bucket_labels(fp, bucket, radius)
    order = np.argsort(labels, kind="stable")
    same = labels[order][1:] == labels[order][:-1]
    return fp[order[:-1][same]], fp[order[1:][same]]


def _masks(open_bits: list[int]) -> list[int]:
    """Masks of two of four equal blocks of the open bits."""
    share = len(open_bits) // 4
    blocks = [sum(1 << b for b in open_bits[k * share:(k + 1) * share]) for k in range(4)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _tables(rows: DataFrame, masks: list[int]) -> DataFrame:
    keys = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]
    return rows.select("fp", F.inline(F.array(*keys)))


def links(nodes: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(a, b): chains through all pairs of the distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    if radius > 2:
        raise ValueError("two of four blocks agree only up to two differing bits")
    masks = _masks(list(range(BITS)))
    rows = _tables(nodes, masks)
    shared = checkpointed(rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = checkpointed(rows.join(shared, ["t", "key"]))
    sparse = rows.filter(F.col("n") <= dense).select("t", "key", "fp")
    divided = None
    for t, mask in enumerate(masks):
        inner = [m | mask for m in _masks([b for b in range(BITS) if not mask >> b & 1])]
        part = _tables(rows.filter((F.col("n") > dense) & (F.col("t") == t)).select("fp"), inner)
        part = part.select((F.col("t") + 6 * (t + 1)).alias("t"), "key", "fp")
        divided = part if divided is None else divided.unionAll(part)
    buckets = sparse.unionAll(divided).repartition("t", "key").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append(np.stack([t.astype(np.int64), key, fp]))
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last bucket may go on in the next batch
            held = [rows[:, cut:]]
            yield from _compared(rows[:, :cut])
        if held:
            yield from _compared(held[0])

    def _compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]) if rows.size else []
        edges = [*np.asarray(starts).tolist(), rows.shape[1]]
        at = 0
        while at < len(edges) - 1:
            stop = min(at + PART_BLOCKS, len(edges) - 1)
            # as many buckets as stay within PART_BLOCKS words of lanes, one at least
            words = np.cumsum([-(-(edges[k + 1] - edges[k]) // 64) for k in range(at, stop)])
            stop = at + max(1, int(np.searchsorted(words, PART_BLOCKS, side="right")))
            part = rows[:, edges[at]:edges[stop]]
            bucket = np.repeat(np.arange(stop - at), np.diff(edges[at:stop + 1]))
            a, b = chains(np.ascontiguousarray(part[2]).view(np.uint64), bucket, radius)
            at = stop
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): the smallest id that can be reached over links."""
    documents = checkpointed(fingerprints(df, id_col, text_col))
    nodes = checkpointed(documents.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(checkpointed(links(nodes.select("fp"), radius)))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpointed(linked.select("fp", "root").join(checkpointed(named), "root").select("fp", "component_id"))
    classes = checkpointed(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return documents.join(classes, "fp").select(id_col, "fp", "component_id")


def one_of_each(df: DataFrame, classify: Callable[..., DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``classify`` (as ``near_duplicates``), with all columns: the least id names it.

    Rows are told apart by id and text, so unlike texts that share an id are in the classes of their texts. If texts
    of one class share the least id, the one with the least hash stays; of rows that agree in id and text, the
    least as JSON. Classes without any id are dropped, as nothing can name them.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(f"`{text_col}`").alias("text_key"))
    classes = classify(df.select(key.alias("_key"), F.col(f"`{text_col}`").alias("_text")), "_key", "_text")
    named = checkpointed(classes.filter("not component_id.none").select("component_id").distinct())
    named = named.select(F.col("component_id.id").alias("_id"), F.col("component_id.text_key").alias("_text_key"))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(f"`{text_col}`").alias("_text_key"), row)
    one = rows.join(named, ["_id", "_text_key"]).groupBy("_id", "_text_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class within the radius, as ``one_of_each`` chooses it."""
    return one_of_each(df, near_duplicates, id_col, text_col)


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
