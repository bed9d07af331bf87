"""Exact top-k similarity through stored blocks of clients with bounds.

Clients are dealt into blocks around centroids and stored once, each block with its centre and the widest angle between
the centre and a member. No member can be closer to a prospect than the angle to the centre less that width, so a
prospect visits its nearest blocks first, then only those whose bound reaches its k-th score.

Blocks reach the tasks in waves of bounded size, one broadcast each. Prospects stay in their partitions: a wave is one more
step over the same rows, which carry their winners so far, so a later wave starts with the k-th score of the earlier ones.
As a wave reads and writes all prospects, waves are larger than asked for, up to ``WAVE_BYTES``, where there would be many.
Between waves the rows are checkpointed, as steps in one stage would each keep a Python worker. No prospect is ever copied,
whatever the number of clients; they are dealt anew, once, only where they lie in few partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import vectors
from leadloom.operators.similarity import _best_of, _list_matrix, _top_k, _unit_rows
from leadloom.sizing import bounded_broadcast, checkpointed, evenly_dealt, work_folder

WAVE_BYTES = 128 << 20
#: Waves that smaller bounds than that may lead to.
WAVES = 8
#: Blocks that a prospect visits in the order of their bounds, before the others are visited block by block.
FIRST = 4
#: Members of a block; a larger list is dealt into several blocks with bounds of their own.
BLOCK_ROWS = 4096
#: Scores are compared with so many decimals, so that equal clients tie whatever block they are in.
DECIMALS = 12
#: Added to every width, in radians, against rounding.
SLACK = 1e-7
PRODUCT_CELLS = 4_000_000


def store_blocks(
    clients: DataFrame, client_key: str = "client_id", vector: str = "embedding", path: str | None = None,
    lists: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 7,
) -> DataFrame:
    """Write the table (block, client, u) and read it back; clients without a direction are left out.

    Centroids come from k-means over directions, about as many as the square root of the number of clients. The table
    can be kept and used for any number of searches.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = clients.sparkSession
    path = path or work_folder(spark, "client_blocks")
    unit = vectors.unit(vectors.as_doubles(F.col(vector)))
    rows = checkpointed(clients.select(client_key, unit.alias("u")).filter("u is not null"))
    n = rows.count()
    if n > 1:
        ready = rows.withColumn("f", array_to_vector("u"))
        model = KMeans(
            k=max(2, lists or math.isqrt(n)), seed=seed, maxIter=5, initMode="random", featuresCol="f", predictionCol="list"
        ).fit(ready)
        rows = checkpointed(model.transform(ready).drop("f"))
    else:
        rows = rows.withColumn("list", F.lit(0))
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    dealt = rows.join(bounded_broadcast(parts), "list")
    part = F.pmod(F.xxhash64(client_key), F.col("parts"))
    dealt.select(F.xxhash64("list", part).alias("block"), client_key, "u").write.parquet(path)
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Wave:
    """Blocks that a task holds at once; members of block b are rows starts[b] to starts[b + 1], by client."""

    ids: np.ndarray
    unit: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    widths: np.ndarray


def make_wave(block: np.ndarray, ids: np.ndarray, unit: np.ndarray) -> Wave:
    order = np.lexsort((ids, block))
    block, ids, unit = block[order], ids[order], unit[order]
    starts = np.append(np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block))
    sums = np.add.reduceat(unit, starts[:-1], axis=0)
    centres, ok = _unit_rows(sums)
    centres[~ok] = unit[starts[:-1]][~ok]
    closeness = np.einsum("ij,ij->i", unit, np.repeat(centres, np.diff(starts), axis=0))
    widths = np.arccos(np.clip(np.minimum.reduceat(closeness, starts[:-1]), -1, 1)) + SLACK
    return Wave(ids, unit, starts, centres, widths)


def _merged(rows, ids, cos, found, n: int, k: int):
    """The winners with those found; only rows for which something was found are ranked again."""
    new = np.zeros(n, bool)
    for r, _, _ in found:
        new[r] = True
    again = new[rows]
    found = [(rows[again], ids[again], cos[again]), *found]
    ranked = _best_of(*(np.concatenate(f) for f in zip(*found)), k)[:3]
    rows, ids, cos = (np.concatenate([old[~again], own]) for old, own in zip((rows, ids, cos), ranked))
    order = np.argsort(rows, kind="stable")
    return rows[order], ids[order], cos[order]


def _k_th(rows: np.ndarray, cos: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th score of every row that has k winners."""
    least = np.full(n, -np.inf)
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    full = np.bincount(rows, minlength=n) == k
    least[rows[last]] = np.where(full[rows[last]], cos[last], -np.inf)
    return least


def _in_block(wave: Wave, b: int, x: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
    """Candidates (rows, ids, cos) of the rows ``own`` in a block: all that can be among the winners."""
    lo, hi = wave.starts[b], wave.starts[b + 1]
    step = max(1, PRODUCT_CELLS // (hi - lo))
    for at in range(0, len(own), step):
        some = own[at:at + step]
        product = x[some] @ wave.unit[lo:hi].T
        r = None
        if np.isfinite(least[some]).all():  # only what reaches the k-th score can win
            r, c = np.divmod(np.flatnonzero(product >= least[some, None] - 10.0**-DECIMALS), hi - lo)
        if r is None or len(r) > k * len(some):
            product = np.round(product, DECIMALS)
            r, c, _ = _top_k(product, k)
        if len(r):
            yield some[r], wave.ids[lo:hi][c], np.round(product[r, c], DECIMALS)


def search(wave: Wave, x: np.ndarray, k: int, rows: np.ndarray, ids: np.ndarray, cos: np.ndarray):
    """Winners (rows, ids, cos), by row and rank, after this wave, given those before it; and the products computed.

    Every row visits its ``FIRST`` nearest blocks, one after the other, which settles most of its k-th score; the blocks that
    may still hold a winner are then visited by all such rows at once, as one product per block.
    """
    away = np.arccos(np.clip(x @ wave.centres.T, -1, 1))
    bound = np.cos(np.maximum(away - wave.widths, 0)) + 10.0**-DECIMALS
    sizes = np.diff(wave.starts)
    first = min(FIRST, bound.shape[1])
    order = np.argsort(-bound, axis=1, kind="stable")[:, :first]
    products = 0
    least = _k_th(rows, cos, len(x), k)
    for turn in range(first):
        block = order[:, turn]
        active = np.flatnonzero(bound[np.arange(len(x)), block] >= least)
        if not len(active):
            return rows, ids, cos, products  # bounds only fall from here
        found = []
        for b in np.unique(block[active]):
            own = active[block[active] == b]
            products += len(own) * int(sizes[b])
            found += _in_block(wave, b, x, own, least, k)
        if found:
            rows, ids, cos = _merged(rows, ids, cos, found, len(x), k)
            least = _k_th(rows, cos, len(x), k)
    np.put_along_axis(bound, order, -np.inf, axis=1)  # visited; -inf reaches only a row without k winners
    for b in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
        own = np.flatnonzero((bound[:, b] >= least) & (bound[:, b] > -np.inf))
        if not len(own):
            continue
        products += len(own) * int(sizes[b])
        found = list(_in_block(wave, b, x, own, least, k))
        if found:
            rows, ids, cos = _merged(rows, ids, cos, found, len(x), k)
            least = _k_th(rows, cos, len(x), k)
    return rows, ids, cos, products


def _waves(blocks: DataFrame, client_key: str, wave_bytes: int) -> list[list[int]]:
    """Block numbers per wave, filled in the order of their numbers; sizes come from one grouped count. Some ``WAVES`` at
    most, unless they would exceed ``WAVE_BYTES``."""
    sizes = blocks.groupBy("block").agg(F.sum(F.size("u") * 8).alias("bytes")).orderBy("block").collect()
    wave_bytes = max(wave_bytes, min(WAVE_BYTES, math.ceil(sum(r["bytes"] for r in sizes) / WAVES)))
    waves, room = [], 0
    for r in sizes:
        if not waves or r["bytes"] > room:
            waves.append([])
            room = wave_bytes
        waves[-1].append(r["block"])
        room -= r["bytes"]
    return waves


def top_similar_bounded(
    prospects: DataFrame, blocks: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    client_key: str = "client_id", wave_bytes: int = WAVE_BYTES, products: Accumulator | None = None,
) -> DataFrame:
    """Rows (key, client, cosine, rank, similarity) as ``similarity.top_similar`` gives them, from stored blocks.

    Every prospect row has its own ranking, also when its key repeats; rows without a direction have none. Clients of equal
    score, to twelve decimals, go by their key. ``products`` counts the cosines computed.
    """
    kinds = T.StructType([
        prospects.schema[key], T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("ids", T.ArrayType(blocks.schema[client_key].dataType)), T.StructField("cos", T.ArrayType(T.DoubleType())),
    ])
    none = [F.array().cast(kinds[c].dataType).alias(c) for c in ("ids", "cos")]
    state = prospects.select(key, vectors.unit(vectors.as_doubles(F.col(vector))).alias("v"), *none).filter("v is not null")
    state = evenly_dealt(state)
    for turn, numbers in enumerate(_waves(blocks, client_key, wave_bytes)):
        own = F.col("block").between(numbers[0], numbers[-1])
        state = checkpointed(state) if turn else state
        state = state.mapInArrow(_visit(blocks.filter(own), client_key, k, products), kinds)
    ranked = state.select(key, F.posexplode(F.arrays_zip("ids", "cos")).alias("place", "hit"))
    ranked = ranked.select(
        key, F.col("hit.ids").alias(client_key), F.col("hit.cos").alias("cosine"), (F.col("place") + 1).alias("rank")
    )
    return ranked.withColumn("similarity", F.round(F.col("cosine") * 100, 2))


def _visit(blocks: DataFrame, client_key: str, k: int, products: Accumulator | None):
    """A step that lets every prospect visit the blocks of one wave."""
    table = blocks.select("block", client_key, "u").toArrow().combine_chunks()
    unit = _list_matrix(table.column("u").combine_chunks())
    wave = make_wave(table.column("block").to_numpy(), table.column(client_key).to_numpy(), unit)
    shared = blocks.sparkSession.sparkContext.broadcast(wave)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _list_matrix(b.column(1))
            have = b.column(2).value_lengths().to_numpy()
            rows = np.repeat(np.arange(len(b)), have)
            ids = b.column(2).flatten().to_numpy(zero_copy_only=False)
            cos = b.column(3).flatten().to_numpy(zero_copy_only=False)
            rows, ids, cos, computed = search(shared.value, x, k, rows, ids.astype(shared.value.ids.dtype, copy=False), cos)
            if products is not None:
                products.add(computed)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(b)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, cos)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=b.schema.names)

    return step
