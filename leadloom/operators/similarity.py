"""Cosine similarity of prospects to known clients.

Exact top-k needs every prospect-client product, but no pair is ever emitted: a task multiplies a block of
prospect vectors with the client matrix and returns ``k`` rows per prospect.

* Client matrix measured to fit the bound: broadcast once, prospects stay where they are, unless that is in few partitions.
* Larger: prospects are dealt into even chunks and clients into even blocks, each (chunk, block) is one
  bounded task, and the per-block winners are merged. A prospect is copied once per block and a client once per
  chunk, so both numbers stay small until a chunk or block would exceed ``CHUNK_BYTES``.

The approximate form first deals the clients into lists around centroids and compares a prospect only with
its nearest lists. Lists share blocks: a prospect goes to a block once, with the lists that it wants there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import vectors
from leadloom.functions.exprs import let
from leadloom.operators.common import top_per_key
from leadloom.sizing import bounded_broadcast, checkpointed, evenly_dealt

MATRIX_MAX_BYTES = 128 << 20
CHUNK_BYTES = 64 << 20
#: Smaller chunks and blocks than that are made as asked for, but no more than so many: each costs a copy of the other side.
CHUNKS, BLOCKS = 32, 4
#: No chunk is made smaller than that to keep all cores busy.
CHUNK_LEAST_BYTES = 4 << 20
PRODUCT_CELLS = 4_000_000
#: Rows and columns of a product that stays in the processor's cache, and the share of its cells beyond which it is ranked as a whole.
TILE, DENSE = (512, 1_024), 32
#: Columns per group whose maxima bound the k-th best, and winners held before they are merged.
GROUP, HELD = 32, 2_000_000
ROW = "_row"


def _matrix_size(clients: DataFrame, vector: str) -> tuple[int, int]:
    n, dim = clients.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    return int(n), int(dim)


def _unit_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1, and a mask of the rows that have a direction."""
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    ok = n > 0
    return m / np.where(ok, n, 1.0)[:, None], ok


def _top_k(product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank) of the ``k`` largest per row; ties go to the lower column."""
    n, c = product.shape
    k = min(k, c)
    # the k-th largest of the maxima of disjoint groups of columns is at most the k-th largest of all
    wide = c // GROUP
    best = product[:, :wide * GROUP].reshape(n, GROUP, wide).max(axis=1) if wide > 2 * k else product
    bound = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
    rows, cols = np.divmod(np.flatnonzero(product >= bound[:, None]), c)
    order = np.lexsort((cols, -product[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, np.arange(n))
    rank = np.arange(len(rows)) - starts[rows] + 1
    keep = rank <= k
    return rows[keep], cols[keep], rank[keep]


def _rank_block(x: np.ndarray, ids: np.ndarray, unit: np.ndarray, k: int, near: np.ndarray | None = None):
    """Top-k of a block of unit vectors, in slices that bound the product's memory. ``near`` is ``unit`` in single precision."""
    near = unit.astype(np.float32) if near is None else near
    for start in range(0, len(x), TILE[0]):
        rows, cols, cos, rank = _ranked(x[start : start + TILE[0]], unit, near, k)
        yield start + rows, ids[cols], cos, rank


def _ranked(x: np.ndarray, unit: np.ndarray, near: np.ndarray, k: int):
    """(row, column, cosine, rank) of the ``k`` largest per row, ties to the lower column.

    Products are made in single precision, tile by tile; what may be better than a row's k-th best so far is computed in double.
    A tile with much of that, as the first one, is ranked in double as a whole.
    """
    single, k = x.astype(np.float32), min(k, len(unit))
    # no product of unit vectors in single precision is off by more
    error = (x.shape[1] + 8) * 2.0**-24
    bound = np.full((len(x), 1), -np.inf, np.float32)
    none = np.zeros(0, np.int64)
    found, more = [(none, none, np.zeros(0, unit.dtype))], 0
    product = mask = np.empty(0, bool)
    for at in range(0, len(unit), TILE[1]):
        rows, tile = None, near[at : at + TILE[1]]
        if at:
            if product.shape != (len(x), len(tile)):
                product, mask = (np.empty((len(x), len(tile)), kind) for kind in (np.float32, bool))
            np.greater_equal(np.matmul(single, tile.T, out=product), bound, out=mask)
            hits = _marked(mask)
            if len(hits) <= mask.size // DENSE:
                rows, cols = np.divmod(hits, len(tile))
        if rows is None:
            rows, cols, _ = _top_k(x @ unit[at : at + TILE[1]].T, k)
        if not len(rows):
            continue
        cols = cols + at
        found.append((rows, cols, np.einsum("ij,ij->i", x[rows], unit[cols])))
        more += len(rows)
        if more >= len(x) * k:
            *best, rank = _best_of(*map(np.concatenate, zip(*found, strict=True)), k)
            found, more = [tuple(best)], 0
            last = rank == k
            bound[best[0][last], 0] = best[2][last] - 2 * error
    return _best_of(*map(np.concatenate, zip(*found, strict=True)), k)


def _marked(mask: np.ndarray) -> np.ndarray:
    """As ``flatnonzero``, for few marks: eight cells are looked at as one."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    own, at = np.nonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[own] * 8 + at, whole + np.flatnonzero(flat[whole:])])


def _best_of(rows: np.ndarray, cols: np.ndarray, cos: np.ndarray, k: int):
    """Merge winners of several lists: the ``k`` best per row, ties to the lower column."""
    order = np.lexsort((cols, -cos, rows))
    rows, cols, cos = rows[order], cols[order], cos[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)])) + 1
    keep = rank <= k
    return rows[keep], cols[keep], cos[keep], rank[keep]


def _list_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _out_schema(prospects: DataFrame, clients: DataFrame, key: str, client_key: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(key, prospects.schema[key].dataType),
            T.StructField(client_key, clients.schema[client_key].dataType),
            T.StructField("cosine", T.DoubleType()),
            T.StructField("rank", T.IntegerType()),
        ]
    )


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("similarity", F.round(F.col("cosine") * 100, 2))


def top_similar(
    prospects: DataFrame, clients: DataFrame, k: int = 10, key: str = "vec_id",
    vector: str = "embedding", client_key: str = "client_id", client_vector: str = "embedding",
    matrix_max_bytes: int = MATRIX_MAX_BYTES, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Rows (key, client, cosine, rank, similarity) of the ``k`` most similar clients, ties by client key.

    Every prospect row gets its own ranking under its ``key``, also when the key repeats. ``similarity`` is the
    cosine in percent with two decimals. Rows without a vector, with the zero vector or with a component that
    is not a number have no ranking.
    """
    p = prospects.select(key, F.col(vector).alias("v")).filter("v is not null")
    c = clients.select(client_key, F.col(client_vector).alias("v")).filter("v is not null")
    schema = _out_schema(prospects, clients, key, client_key)
    n, dim = _matrix_size(c, "v")
    if n == 0:
        return _shown(p.sparkSession.createDataFrame([], schema))
    if n * dim * 8 <= matrix_max_bytes:
        return _shown(_by_broadcast(evenly_dealt(p), c, k, key, client_key, schema))
    blocks = _pieces(n * dim * 8, chunk_bytes, BLOCKS)
    dealt = c.select(client_key, "v", F.lit(0).alias("list"), _share(client_key, blocks).alias("block"))
    p = p.withColumn(ROW, F.monotonically_increasing_id())
    one = F.lit(np.packbits([True]).tobytes()).alias("lists"), F.lit(0).alias("base")
    copies = p.select("*", *one, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return _shown(_by_blocks(copies, dealt, _chunks(p, dim, chunk_bytes, blocks), k, key, client_key, schema))


def _pieces(size: int, piece_bytes: int, most: int) -> int:
    """Pieces of ``piece_bytes`` that a side is dealt into; beyond ``most`` they get larger, up to ``CHUNK_BYTES``."""
    return max(1, min(math.ceil(size / piece_bytes), max(most, math.ceil(size / CHUNK_BYTES))))


def _chunks(p: DataFrame, dim: int, chunk_bytes: int, blocks: int) -> int:
    """Chunks of prospects: bounded in size, and of large sides so many that all cores have tasks of about equal number."""
    size = p.count() * dim * 8
    busy = math.ceil(4 * p.sparkSession.sparkContext.defaultParallelism / blocks)
    return max(_pieces(size, chunk_bytes, CHUNKS), min(busy, size // CHUNK_LEAST_BYTES, CHUNKS))


def _share(name: str, count: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(count)).cast("int")


def _batch(names: list[str], key: pa.Array, client, cos, rank) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [key, pa.array(client), pa.array(cos), pa.array(rank, pa.int32())], names=names
    )


def _by_broadcast(p, c, k, key, client_key, schema) -> DataFrame:
    """Every prospect against a client matrix that the caller measured against the bound."""
    table = c.toArrow().combine_chunks().sort_by(client_key)
    unit, ok = _unit_rows(_list_matrix(table.column("v").combine_chunks()))
    shared = p.sparkSession.sparkContext.broadcast((table.column(client_key).to_numpy()[ok], unit[ok]))
    names = schema.names

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        near = matrix.astype(np.float32)
        for b in batches:
            if len(b) == 0 or len(ids) == 0:
                continue
            x, good = _unit_rows(_list_matrix(b.column(1)))
            keys = b.column(0).filter(pa.array(good))
            for rows, client, cos, rank in _rank_block(x[good], ids, matrix, k, near):
                yield _batch(names, keys.take(pa.array(rows)), client, cos, rank)

    return p.mapInArrow(kernel, schema)


def _rank_lists(
    x: np.ndarray, wanted: np.ndarray, members: np.ndarray, starts: np.ndarray, unit: np.ndarray, k: int, near: np.ndarray | None = None
):
    """Winners (row, member, cosine, rank) of every row among the members of the lists that it wants.

    ``wanted[row, list]`` marks them; ``members[starts[l]:starts[l + 1]]`` are the rows of ``unit`` in list l. Adjacent lists
    that the same rows want are one product. Winners held at a time are bounded, whatever the number of lists.
    """
    near = unit.astype(np.float32) if near is None else near
    step = max(1, PRODUCT_CELLS // max(1, wanted.shape[1]))
    for start in range(0, len(x), step):
        some, own = x[start : start + step], wanted[start : start + step]
        edges = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0)) + 1
        found, held, full = [], 0, HELD
        for lo, hi in zip(np.r_[0, edges], np.r_[edges, wanted.shape[1]], strict=True):
            at, inside = np.flatnonzero(own[:, lo]), np.sort(members[starts[lo] : starts[hi]])
            if not len(at) or not len(inside):
                continue
            both = (unit, near) if len(inside) == len(unit) else (unit[inside], near[inside])
            for r, which, cos, _ in _rank_block(some[at], inside, both[0], k, both[1]):
                found.append((at[r], which, cos))
                held += len(r)
                if held > full:
                    found = [_best_of(*(np.concatenate(f) for f in zip(*found, strict=True)), k)[:3]]
                    held = len(found[0][0])
                    full = HELD + held
        if found:
            rows, which, cos, rank = _best_of(*(np.concatenate(f) for f in zip(*found, strict=True)), k)
            yield start + rows, which, cos, rank


def _by_blocks(copies, dealt, chunks, k, key, client_key, schema) -> DataFrame:
    """(chunk, block) tasks of bounded size; winners per block are merged per prospect.

    ``copies`` (key, v, row number, lists, base, block) has a prospect once per block that it visits, with the lists it wants
    there: a bit for each list from ``base`` on, as many for all rows of the block, so that a row that wants all lists is no
    larger than others. ``dealt`` (client, v, list, block) has a client once. A row is told from others of its key by its number, which also
    spreads the rows of a frequent key.
    """
    copies = copies.withColumn("chunk", _share(ROW, chunks))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    wide = T.StructType([*schema.fields[:3], T.StructField(ROW, T.LongType())])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            right = right.sort_by(client_key)
            unit, ok = _unit_rows(_list_matrix(right.column("v").combine_chunks()))
            x, good = _unit_rows(_list_matrix(left.column("v").combine_chunks()))
            clients, who, rows = right.column(client_key).filter(pa.array(ok)), left.column(key), left.column(ROW)
            names, number = np.unique(right.column("list").to_numpy()[ok], return_inverse=True)
            members = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[members], np.arange(len(names) + 1))
            wanted = _bits(left.column("lists").combine_chunks(), names - left.column("base")[0].as_py())
            wanted[~good] = False
            for r, client, cos, _ in _rank_lists(x, wanted, members, starts, unit[ok], k):
                at = pa.array(r)
                parts.append(pa.table([who.take(at), clients.take(pa.array(client)), pa.array(cos), rows.take(at)], names=wide.names))
        if parts:
            return pa.concat_tables(parts)
        kinds = [left.schema.field(key).type, right.schema.field(client_key).type, pa.float64(), pa.int64()]
        return pa.table([pa.array([], kind) for kind in kinds], names=wide.names)

    by = ["chunk", "block"]
    partial = copies.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(rank, wide)
    return top_per_key(partial, [ROW], [F.col("cosine").desc(), client_key], k, rank_name="rank").drop(ROW)


def _bits(packed: pa.Array, places: np.ndarray) -> np.ndarray:
    """The bits at these places of every row; all rows have as many."""
    width = len(packed[0].as_py())
    rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), width)
    out = np.zeros((len(packed), len(places)), bool)
    for i, at in enumerate(places):
        if 0 <= at < 8 * width:
            out[:, i] = rows[:, at // 8] >> (7 - at % 8) & 1
    return out


def approx_similar(
    prospects: DataFrame, clients: DataFrame, k: int = 10, probes: int = 8, lists: int | None = None,
    key: str = "vec_id", vector: str = "embedding", client_key: str = "client_id",
    client_vector: str = "embedding", matrix_max_bytes: int = MATRIX_MAX_BYTES,
    chunk_bytes: int = CHUNK_BYTES, seed: int = 7,
) -> DataFrame:
    """Approximate top-k: compare each prospect only with the clients of its ``probes`` nearest lists.

    The lists come from k-means over the client directions, about as many as the square root of the
    number of clients. As in the exact form, clients that fit the bound are broadcast and prospects stay
    where they are; else adjacent lists share blocks of even size, a large list has several, and prospects travel to
    the blocks of their lists, once to each.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    p = prospects.select(key, F.col(vector).alias("v")).filter("v is not null")
    c = clients.select(
        client_key, F.col(client_vector).alias("v"),
        vectors.unit(vectors.as_doubles(F.col(client_vector))).alias("u"),
    ).filter("u is not null")
    n, dim = _matrix_size(c, "v")
    schema = _out_schema(prospects, clients, key, client_key)
    if n == 0:
        return _shown(p.sparkSession.createDataFrame([], schema))
    if n == 1:
        return top_similar(prospects, clients, k, key, vector, client_key, client_vector)
    ready = checkpointed(c.withColumn("f", array_to_vector("u")).drop("u"))  # read once per iteration
    model = KMeans(
        k=max(2, lists or math.isqrt(n)), seed=seed, maxIter=5, initMode="random", featuresCol="f",
        predictionCol="list",
    ).fit(ready)
    dealt = model.transform(ready).select(client_key, "v", "list")
    centers, _ = _unit_rows(np.array(model.clusterCenters()))
    p = evenly_dealt(p)
    if n * dim * 8 <= matrix_max_bytes:
        return _shown(_lists_by_broadcast(p, dealt, centers, probes, k, key, client_key, schema))
    return _shown(_lists_by_blocks(p, checkpointed(dealt), centers, probes, n, dim, chunk_bytes, k, key, client_key, schema))


def _nearest_lists(x: np.ndarray, centers: np.ndarray, near: int) -> np.ndarray:
    """wanted[row, list]: whether the list's centre is among the ``near`` nearest of the row."""
    wanted = np.ones((len(x), len(centers)), bool)
    if near < len(centers):
        rows, cols, _ = _top_k(x @ centers.T, near)
        wanted[:] = False
        wanted[rows, cols] = True
    return wanted


def _lists_by_broadcast(p, dealt, centers, probes, k, key, client_key, schema) -> DataFrame:
    table = dealt.select(client_key, "v", "list").toArrow().combine_chunks().sort_by(client_key)
    unit, _ = _unit_rows(_list_matrix(table.column("v").combine_chunks()))
    lists, ids = table.column("list").to_numpy(), table.column(client_key).to_numpy()
    members = np.argsort(lists, kind="stable")
    starts = np.searchsorted(lists[members], np.arange(len(centers) + 1))
    shared = p.sparkSession.sparkContext.broadcast((ids, unit, members, starts, centers))
    names, near = schema.names, min(probes, len(centers))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, members, starts, centers = shared.value
        single = unit.astype(np.float32)
        step = max(1, PRODUCT_CELLS // len(centers))
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                x, good = _unit_rows(_list_matrix(b.column(1)))
                x, keys = x[good], b.column(0).filter(pa.array(good))
                if len(x):
                    wanted = _nearest_lists(x, centers, near)
                    for rows, which, cos, rank in _rank_lists(x, wanted, members, starts, unit, k, single):
                        yield _batch(names, keys.take(pa.array(rows)), ids[which], cos, rank)

    return p.mapInArrow(kernel, schema)


def _lists_by_blocks(p, dealt, centers, probes, n, dim, chunk_bytes, k, key, client_key, schema) -> DataFrame:
    """Clients lie in the order of their lists, in blocks of even size; a client's place within its list is drawn."""
    near, blocks = min(probes, len(centers)), _pieces(n * dim * 8, chunk_bytes, BLOCKS)
    sizes = np.zeros(len(centers), np.int64)
    for r in dealt.groupBy("list").count().collect():  # one row per list, as the centroids on the driver
        sizes[r["list"]] = r["count"]
    ends = np.cumsum(sizes)
    spans = p.sparkSession.createDataFrame(
        [(i, int(end - size), int(size)) for i, (end, size) in enumerate(zip(ends, sizes, strict=True))], "list int, first long, size long"
    )
    at = F.col("first") + F.pmod(F.xxhash64(client_key), F.col("size"))
    dealt = dealt.join(F.broadcast(spans), "list").select(client_key, "v", "list", F.floor(at * blocks / n).cast("int").alias("block"))
    # the first and the last block of every list; one without clients has none
    first, last = (ends - sizes) * blocks // n, np.where(sizes > 0, (ends - 1) * blocks // n, -1)
    shared = p.sparkSession.sparkContext.broadcast((centers, first, last))
    p = p.withColumn(ROW, F.monotonically_increasing_id())  # one number in all blocks of a row

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, first, last = shared.value
        step = max(1, PRODUCT_CELLS // len(centers))
        for whole in batches:
            for start in range(0, len(whole), step):
                b = whole.slice(start, step)
                x, good = _unit_rows(_list_matrix(b.column(1)))
                wanted = _nearest_lists(x, centers, near) & good[:, None]
                for block in range(blocks):
                    lists = np.flatnonzero((first <= block) & (block <= last))
                    if not len(lists):
                        continue
                    asked = wanted[:, lists[0] : lists[-1] + 1]
                    who = np.flatnonzero(asked.any(axis=1))
                    if not len(who):
                        continue
                    bits = pa.array([r.tobytes() for r in np.packbits(asked[who], axis=1)], pa.binary())
                    places = [pa.array(np.full(len(who), at), pa.int32()) for at in (lists[0], block)]
                    copied = [c.take(pa.array(who)) for c in b.columns]
                    yield pa.RecordBatch.from_arrays([*copied, bits, *places], names=kinds.names)

    more = [("lists", T.BinaryType()), ("base", T.IntegerType()), ("block", T.IntegerType())]
    kinds = T.StructType([*p.schema.fields, *(T.StructField(*f) for f in more)])
    return _by_blocks(p.mapInArrow(route, kinds), dealt, _chunks(p, dim, chunk_bytes, blocks), k, key, client_key, schema)


def best_match(ranked: DataFrame, clients: DataFrame, client_key: str = "client_id") -> DataFrame:
    """The top client of each prospect with the client's columns (prefixed ``client_``)."""
    names = {c: (c if c.startswith("client_") else f"client_{c}") for c in clients.columns}
    c = bounded_broadcast(clients.select(*[F.col(old).alias(new) for old, new in names.items()]))
    return ranked.filter(F.col("rank") == 1).join(c, names[client_key])


def similarity_points(similarity: Column) -> Column:
    """Up to 10 points; 5 when there was nothing to compare with."""
    return F.when(similarity.isNull(), F.lit(5.0)).otherwise(
        F.least(similarity * F.lit(0.1), F.lit(10.0))
    )


# The wording of the explanations below.
def explanation(similarity: Column) -> Column:
    """Why a prospect resembles its best client; reads prospect columns and ``client_*`` columns."""

    def text_of(c: str, default: str) -> Column:
        return F.coalesce(F.lower(F.col(c).cast("string")), F.lit(default))

    stores = F.coalesce("store_count", F.lit(0))
    theirs = F.coalesce("client_store_count", F.lit(0))
    unknown = F.lit("unknown")
    size = F.when(
        F.abs(stores - theirs) <= 5,
        F.format_string("similar boutique size (%d vs %d stores)", stores, theirs),
    )
    wool = F.when(
        F.coalesce("wool_percentage", unknown) == F.coalesce("client_wool_percentage", unknown),
        "100% wool suits",
    )
    mtm = F.when(
        text_of("made_to_measure", "unknown") == text_of("client_made_to_measure", ""),
        "made-to-measure services",
    )
    style = F.when(
        F.coalesce("brand_style", unknown) == F.coalesce("client_brand_style", unknown),
        F.concat(F.coalesce("brand_style", unknown), F.lit(" positioning")),
    )
    parts = F.concat_ws(", ", size, wool, mtm, style)
    name = F.coalesce("client_name", F.lit("client"))
    percent = F.round(similarity.cast("decimal(18,8)"), 1).cast("decimal(10,1)").cast("string")
    return F.when(
        parts != "", F.concat(F.lit("Similar to "), name, F.lit(" because both have: "), parts, F.lit("."))
    ).otherwise(
        F.concat(
            F.lit("Similar to "), name, F.lit(" ("), percent,
            F.lit("% match) based on overall brand profile and positioning."),
        )
    )


# ---------------------------------------------------------------- alternative measures


def _mean_vector(clients: DataFrame, vector: Column, weight: Column) -> DataFrame:
    """One row with the weighted mean per dimension; map-side sums, at most ``dim`` rows shuffled per task."""
    per_dim = (
        clients.select(F.posexplode(vector), weight.alias("w"))
        .groupBy("pos")
        .agg((F.sum(F.col("col") * F.col("w")) / F.sum("w")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return per_dim.agg(F.transform(ordered, lambda s: s["x"]).alias("mean"))


def alternative_similarity(
    prospects: DataFrame, clients: DataFrame, k: int = 10, key: str = "vec_id",
    high_tier: str = "high_value", high_weight: float = 2.0,
) -> DataFrame:
    """Mean of the top ``k``, similarity to the centroid, and tier-weighted mean similarity (percent).

    The weighted mean of cosines equals one product with the weighted mean of the client *directions*, so
    no pairs are formed for it.
    """
    v = vectors.as_doubles(F.col("embedding"))
    weight = F.when(F.col("tier") == high_tier, F.lit(high_weight)).otherwise(F.lit(1.0))
    directions = clients.withColumn("u", vectors.unit(v)).filter("u is not null")
    centroid = _mean_vector(clients, v, F.lit(1.0)).select(vectors.unit(F.col("mean"))).scalar()
    direction = _mean_vector(directions, F.col("u"), weight).scalar()
    top = (
        top_similar(prospects, clients, k, key=key)
        .groupBy(key)
        .agg((F.avg("cosine") * 100).alias("top_mean"))
    )
    both = let(
        vectors.unit(v),
        lambda u: F.struct(
            (vectors.dot(u, F.col("c")) * 100).alias("centroid_similarity"),
            (vectors.dot(u, F.col("d")) * 100).alias("weighted_similarity"),
        ),
    )
    whole = (
        prospects.withColumn("c", centroid)
        .withColumn("d", direction)
        .select(key, both.alias("x"))
        .select(key, "x.*")
    )
    return whole.join(top, key, "left")
