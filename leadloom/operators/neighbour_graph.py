"""Approximate top-k similarity through stored, layered neighbour graphs.

Clients are dealt into shards of bounded size. Each shard becomes a graph, built in one task: every node has its nearest
nodes in different directions as neighbours, links go both ways, and parts that would stay apart are linked. A share of the
nodes, drawn anew from layer to layer, forms sparser layers above, whose links span longer ways. Shards that fit a wave
together are then joined: every node also has the nearest nodes of all of them, in different directions, and the ways back.
The graphs are a table, written once and used for any number of searches.

A search compares a prospect with a sparse layer, as a whole where that is small enough, and widens a beam over the layers
below, for all prospects of an Arrow batch in step. Shards reach the tasks in waves of bounded size, those of a wave as one
graph; prospects carry their winners from wave to wave, with a checkpoint between. They are not copied, and dealt anew only
where they lie in few partitions. Pays off where waves are large: below some ten thousand clients ``top_similar`` is faster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import vectors
from leadloom.operators.common import top_per_key
from leadloom.operators.similarity import _best_of, _list_matrix, _rank_block, _top_k
from leadloom.sizing import checkpointed, evenly_dealt, remove_folder, work_folder

SHARD_ROWS = 65_536
WAVE_BYTES = 384 << 20
#: Links that a node chooses in a layer; with those of others it has at most twice as many.
LINKS = 16
#: Width of the beam at least, nodes opened per step at least, prospects in step.
BEAM, OPENED, ROWS_IN_STEP = 96, 16, 512
#: Winners more than asked for that single precision leaves to double.
SPARE = 4
#: Nodes from which a layer between the top and the lowest one is searched.
STARTS = 24
#: A layer of so many nodes is compared with as a whole, in place of a descent through the layers above it.
PLAIN_NODES = 16_384
#: Components of clients gathered at a time, and pairs of a prospect in step and a node.
GATHERED, STEP_CELLS = 500_000, 1 << 25
#: Links followed per prospect at a time; their numbers are noted in 16 bits.
FOLLOWED = 1 << 15


def store_graph(
    clients: DataFrame, client_key: str = "client_id", vector: str = "embedding", path: str | None = None,
    shard_rows: int = SHARD_ROWS, links: int = LINKS, seed: int = 7,
) -> DataFrame:
    """Write the graphs (shard, node, client, v, norm, links, across) and read them back.

    ``v`` is the vector, in single precision if given so, and ``norm`` its length. ``links`` has a list per layer of the node;
    ``across`` has the addresses of other neighbours in all shards that were joined with its own. Clients without a direction
    are left out.
    """
    spark = clients.sparkSession
    given = F.col(vector) if clients.schema[vector].dataType.elementType == T.FloatType() else vectors.as_doubles(F.col(vector))
    rows = clients.select(client_key, given.alias("v"), vectors.norm(vectors.as_doubles(F.col(vector))).alias("norm"))
    rows = checkpointed(rows.filter("norm > 0 and norm < double('infinity')"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("node", T.IntegerType()), *rows.schema.fields,
        T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(client_key, ignore_index=True)
        graph = layers(np.stack(pdf["v"]).astype(np.float64) / pdf["norm"].to_numpy()[:, None], links, seed)
        return pdf.assign(node=np.arange(len(pdf), dtype=np.int32), links=graph)[schema.names]

    path = path or work_folder(spark, "neighbour_graph")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(client_key), F.lit(shards)))
    built = rows.groupBy("shard").applyInPandas(build, schema)
    if shards == 1:
        built.withColumn("across", F.array().cast("array<bigint>")).write.parquet(path)
    else:
        parts = work_folder(spark, "neighbour_graph_parts")
        built.write.parquet(parts)
        _join(spark.read.schema(schema).parquet(parts), links, path)
        remove_folder(spark, parts)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("across", T.ArrayType(T.LongType()))])).parquet(path)


def _address(shard, node):
    return shard * (1 << 32) + node


def _join(graphs: DataFrame, most: int, path: str) -> None:
    """Link the shards of each wave: to the nearest nodes in different directions, and back from them, nearest first."""
    spark = graphs.sparkSession
    ways = work_folder(spark, "neighbour_graph_ways")
    for wave in _waves(graphs, WAVE_BYTES):
        own = graphs.filter(F.col("shard").isin(wave)).select("shard", "node", "v", "norm")
        evenly_dealt(own.select("shard", "node")).mapInArrow(_ways(own, most), "at bigint, to bigint, cos float").write.mode("append").parquet(ways)
    there = spark.read.schema("at bigint, to bigint, cos float").parquet(ways)
    back = there.select(F.col("to").alias("at"), F.col("at").alias("to"), "cos")
    back = top_per_key(back, ["at"], [F.col("cos").desc(), "to"], most, rank_name="place").drop("place")
    both = there.unionByName(back).groupBy("at").agg(F.collect_set("to").alias("across"))
    at = _address(F.col("shard"), F.col("node"))
    within = F.transform(F.col("links")[0], lambda j: _address(F.col("shard"), j))
    others = F.array_except(F.coalesce("across", F.array().cast("array<bigint>")), within)
    graphs.join(both, at == F.col("at"), "left").select(*graphs.columns, others.alias("across")).write.parquet(path)
    remove_folder(spark, ways)


def _ways(own: DataFrame, most: int):
    """A step that gives for every node of a wave its neighbours (at, to, cos) among all nodes of the wave."""
    table = own.orderBy("shard", "node").toArrow().combine_chunks()
    address = _address(table.column("shard").to_numpy(), table.column("node").to_numpy().astype(np.int64))
    single = _singles(_given(table.column("v").combine_chunks()), table.column("norm").to_numpy())
    shared = own.sparkSession.sparkContext.broadcast((address, single))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            address, single = shared.value
            at = _address(b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64))
            node = np.searchsorted(address, at)
            chosen = np.array(_spread(single, node, _nearest(single, 3 * most, node), most), np.int64).reshape(len(b), -1)
            cos = np.einsum("ij,ikj->ik", single[node], single[chosen])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (np.repeat(at, chosen.shape[1]), address[chosen.ravel()], cos.ravel())], names=["at", "to", "cos"]
            )

    return step


def _given(column: pa.Array) -> np.ndarray:
    """The vectors as a matrix, in their own precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _singles(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Directions in single precision."""
    out = np.empty(x.shape, np.float32)
    for at in range(0, len(x), SHARD_ROWS):
        out[at:at + SHARD_ROWS] = x[at:at + SHARD_ROWS] / norm[at:at + SHARD_ROWS, None]
    return out


def _nearest(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The ``k`` nearest other rows of every row, or of the rows ``of``, nearest first."""
    of = np.arange(len(x)) if of is None else of
    k = min(k, len(x) - 1)
    out = np.empty((len(of), k), np.int64)
    single, ids = x.astype(np.float32, copy=False), np.arange(len(x))
    for at in range(0, len(of) if k else 0, ROWS_IN_STEP):
        own = of[at:at + ROWS_IN_STEP]
        _, cols, _, _ = map(np.concatenate, zip(*_rank_block(x[own], ids, x, k + 1, single), strict=True))
        cols = cols.reshape(-1, k + 1)
        order = np.argsort(cols == own[:, None], axis=1, kind="stable")[:, :k]  # itself last; missing only among equal rows
        out[at:at + ROWS_IN_STEP] = np.take_along_axis(cols, order, axis=1)
    return out


def _spread(x: np.ndarray, of: np.ndarray, near: np.ndarray, most: int) -> list[list[int]]:
    """Neighbours in different directions, of the rows ``of``: one is taken if it is nearer to the node than to those taken
    before; then the nearest of the others while there is room."""
    out = []
    for at in range(0, len(near), ROWS_IN_STEP):
        own = near[at:at + ROWS_IN_STEP]
        around = x[own]
        among = around @ around.transpose(0, 2, 1)
        to_own = np.einsum("ikj,ij->ik", around, x[of[at:at + ROWS_IN_STEP]])
        taken, closest = np.zeros(own.shape, bool), np.full(own.shape, -np.inf)
        for k in range(own.shape[1]):
            take = (taken.sum(axis=1) < most) & (closest[:, k] <= to_own[:, k])
            taken[:, k] = take
            closest[take] = np.maximum(closest[take], among[take, k])
        order = np.argsort(~taken, axis=1, kind="stable")[:, :most]
        out += np.take_along_axis(own, order, axis=1).tolist()
    return out


def _parts(links: list[list[int]]) -> np.ndarray:
    """The least node of each node's connected part."""
    label = np.arange(len(links))
    a = np.repeat(label, [len(x) for x in links])
    b = np.array([y for x in links for y in x], np.int64)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _layer(x: np.ndarray, most: int) -> list[list[int]]:
    """Links of one layer: chosen neighbours, the ways back, and links between parts."""
    chosen = _spread(x, np.arange(len(x)), _nearest(x, 3 * most), most)
    both = [dict.fromkeys(c) for c in chosen]
    for i, c in enumerate(chosen):
        for j in c:
            if len(both[j]) < 2 * most:
                both[j].setdefault(i)
    out = [list(b) for b in both]
    label = _parts(out)
    while (label != label[0]).any():  # the nearest pair from the first part to the next one outside
        inside, outside = np.flatnonzero(label == label[0]), np.flatnonzero(label == label[label != label[0]][0])
        i = outside[0]
        j = inside[np.argmax(x[inside] @ x[i])]
        out[i].append(int(j))
        out[j].append(int(i))
        label[outside] = label[0]
    return out


def layers(x: np.ndarray, most: int, seed: int) -> list[list[list[int]]]:
    """For every node its links in each of its layers, the lowest first."""
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(len(x))) / math.log(max(2, most))).astype(int)
    links: list[list[list[int]]] = [[] for _ in range(len(x))]
    for layer in range(height.max() + 1 if len(x) else 0):
        nodes = np.flatnonzero(height >= layer)
        for i, own in zip(nodes, _layer(x[nodes], most)):
            links[i].append([int(nodes[j]) for j in own])
    return links


@dataclass(frozen=True)
class Graph:
    ids: np.ndarray
    x: np.ndarray  # as given
    norm: np.ndarray
    near: np.ndarray  # in single precision, the same array as ``x`` if that is
    scale: np.ndarray | None  # what makes directions of ``near``, if it is not such
    links: list[np.ndarray]  # for the layers below ``top``, a row of neighbours per node, -1 beyond them
    top: np.ndarray  # nodes of the lowest layer, above the first, that has at most ``PLAIN_NODES``

    def unit(self, nodes: np.ndarray) -> np.ndarray:
        return self.x[nodes].astype(np.float64) / self.norm[nodes, None]

    def single(self, nodes: np.ndarray) -> np.ndarray:
        return self.near[nodes] if self.scale is None else self.near[nodes] * self.scale[nodes, None]


def make_graph(
    ids: np.ndarray, x: np.ndarray, links: list[list[list[int]]] | pa.ListArray, first: np.ndarray | int = 0,
    across: tuple[np.ndarray, np.ndarray] | None = None, norm: np.ndarray | None = None,
) -> Graph:
    """One graph of the nodes of one or several shards: ``links`` count from the nodes ``first``, ``across`` are more links
    (node, node) of the lowest layer, in the order of the first. ``x`` are directions, or any vectors of the lengths ``norm``."""
    norm = np.ones(len(x)) if norm is None else norm
    if not isinstance(links, pa.ListArray):
        links = pa.array(links, pa.list_(pa.list_(pa.int32())))
    height, lists = links.value_lengths().to_numpy(), links.flatten()
    node, layer = np.repeat(np.arange(len(x), dtype=np.int32), height), _places(height).astype(np.int8)
    top = max(1, next((i for i in range(1, height.max()) if (height > i).sum() <= PLAIN_NODES), height.max() - 1))
    size = lists.value_lengths().to_numpy()
    own, layer = np.repeat(node, size), np.repeat(layer, size)
    to = lists.flatten().to_numpy() + np.broadcast_to(first, len(x)).astype(np.int32)[own]
    tables = []
    for i in range(top):
        a, b = own[layer == i], to[layer == i]
        count = np.bincount(a, minlength=len(x))
        more = np.bincount(across[0], minlength=len(x)) if across is not None and not i else np.zeros(len(x), int)
        table = np.full((len(x), max(1, (count + more).max())), -1, np.int32)
        table[a, _places(count)] = b
        if more.any():
            table[across[0], _places(more) + count[across[0]]] = across[1]
        tables.append(table)
    plain = x.dtype == np.float32 and (norm > 1e-15).all() and (norm < 1e15).all()
    near, scale = (x, (1 / norm).astype(np.float32)) if plain else (_singles(x, norm), None)
    return Graph(ids, x, norm, near, scale, tables, np.flatnonzero(height > top) if height.max() > top else np.array([height.argmax()]))


def _places(size: np.ndarray) -> np.ndarray:
    """0, 1, ... for the entries of lists of these sizes."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _products(x: np.ndarray, nodes: np.ndarray, graph: Graph) -> np.ndarray:
    """The products of every row of ``x`` with the nodes that ``nodes`` has for it."""
    of = graph.near
    out = np.empty(nodes.shape, of.dtype)
    step = max(1, GATHERED // max(1, nodes.shape[1] * of.shape[1]))
    for at in range(0, len(nodes), step):
        out[at:at + step] = (of.take(nodes[at:at + step], axis=0) @ x[at:at + step, :, None])[:, :, 0]
    return out if graph.scale is None else out * graph.scale.take(nodes)


def _widened(
    graph: Graph, table: np.ndarray, x: np.ndarray, first: np.ndarray, first_near: np.ndarray, met: np.ndarray, width: int,
    k: int | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """The nodes met that are nearest to each prospect, nearest first, by opening the nearest unopened ones until none of the
    nearest ``width`` is unopened. Starts from the nodes ``first``.

    With ``k`` this begins with half the width, and the width doubles for prospects whose ``k`` nearest still change by that.
    ``met`` has a zero for every pair of a row and a node, also afterwards.
    """
    n, size = len(x), len(graph.x)
    noted = [(first + (np.arange(n) * size)[:, None]).reshape(-1)]
    met[noted[0]] = -1
    rows, products = np.arange(n), 0
    out, out_near = np.zeros((n, k or width), np.int32), np.full((n, k or width), -np.inf, x.dtype)
    width = max(1, width // 2, k) if k else width
    held, near, opened = first.astype(np.int32), first_near, np.zeros(first.shape, bool)
    while True:
        held, near, opened = _held(held, near, opened, width)
        step = min(max(min(OPENED, width), width // 6), max(1, (FOLLOWED - 1) // table.shape[1]))
        while True:
            score = np.where(opened[:, :width], np.inf, -near[:, :width])
            pick = np.argpartition(score, step - 1, axis=1)[:, :step]
            at, slot = np.nonzero(np.take_along_axis(score, pick, axis=1) < np.inf)
            if not len(at):
                break
            slot = pick[at, slot]
            opened[at, slot] = True
            around = table.take(held[at, slot], axis=0)
            new = (around + (rows[at] * size)[:, None])[around >= 0]
            at = np.repeat(at, (around >= 0).sum(axis=1))
            free = met.take(new) == 0
            new, at = new[free], at[free]
            number = (np.arange(len(new)) % (FOLLOWED - 1) + 1).astype(np.int16)  # of a prospect all differ
            met[new] = number
            once = met.take(new) == number  # of a node that several opened ones lead to, one stays
            new, at = new[once], at[once]
            if not len(at):
                continue
            noted.append(new)
            products += len(at)
            count = np.bincount(at, minlength=len(rows))
            some = np.flatnonzero(count)
            place, slot = (np.cumsum(count > 0) - 1)[at], _places(count)
            padded = np.zeros((len(some), count.max()), np.int64)
            padded[place, slot] = new % size
            value = np.full(padded.shape, -np.inf, x.dtype)
            value[place, slot] = _products(x[rows[some]], padded, graph)[place, slot]
            at, slot = np.nonzero(value > near[some].min(axis=1)[:, None])
            if not len(at):
                continue
            count = np.bincount(at, minlength=len(some))
            place = _places(count)
            more_held, more = np.zeros((len(some), count.max()), np.int32), np.full((len(some), count.max()), -np.inf, x.dtype)
            more_held[at, place], more[at, place] = padded[at, slot], value[at, slot]
            joined = (np.concatenate(c, axis=1) for c in ((held[some], more_held), (near[some], more), (opened[some], more == -np.inf)))
            held[some], near[some], opened[some] = _held(*joined, width)
        order = np.argsort(-near[:, :width], axis=1, kind="stable")[:, :out.shape[1]]
        best = np.take_along_axis(near, order, axis=1)
        changed = (best > out_near[rows][:, :best.shape[1]]).any(axis=1)
        out[rows, :best.shape[1]], out_near[rows, :best.shape[1]] = np.take_along_axis(held, order, axis=1), best
        if not k or width >= size or not changed.any():
            for pairs in noted:
                met[pairs] = 0
            return out, out_near, products
        rows, held, near, opened, width = rows[changed], held[changed], near[changed], opened[changed], 2 * width


def _held(held: np.ndarray, near: np.ndarray, opened: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest ``width`` nodes, then as many of the next ones."""
    short = 2 * width - held.shape[1]
    if short >= 0:
        pad = ((0, 0), (0, short + 1))
        held, near, opened = np.pad(held, pad), np.pad(near, pad, constant_values=-np.inf), np.pad(opened, pad, constant_values=True)
    order = np.argpartition(-near, (width - 1, 2 * width - 1), axis=1)[:, :2 * width]
    return tuple(np.take_along_axis(c, order, axis=1) for c in (held, near, opened))


def search(graph: Graph, x: np.ndarray, k: int, beam: int, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, node, cosine) of up to ``k`` clients per prospect, and the products computed.

    The way is found in single precision; the winners are ranked in double. ``met`` are zeros for every pair of a row and a
    node, which are used and set back, so that calls may share them.
    """
    met = np.zeros(len(x) * len(graph.x), np.int16) if met is None else met
    whole, x, width = x, x.astype(np.float32), max(beam, 2 * k)
    near = x @ graph.single(graph.top).T
    products = near.size
    some = min(len(graph.top), STARTS if len(graph.links) > 1 else 2 * width)
    rows, cols, _ = _top_k(near, some)
    held, near = graph.top[cols].reshape(len(x), some), near[rows, cols].reshape(len(x), some)
    for table in graph.links[:0:-1]:
        held, near, computed = _widened(graph, table, x, held, near, met, STARTS)
        held, near, products = held[:, near.max(axis=0) > -np.inf], near[:, near.max(axis=0) > -np.inf], products + computed
    held, near, computed = _widened(graph, graph.links[0], x, held, near, met, width, k + SPARE)
    rows, slots = np.nonzero(near > -np.inf)
    node = held[rows, slots]
    rows, node, value, _ = _best_of(rows, node, np.einsum("ij,ij->i", whole[rows], graph.unit(node)), k)
    return rows, node, value, products + computed


def similar_by_graph(
    prospects: DataFrame, graphs: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    client_key: str = "client_id", beam: int = BEAM, wave_bytes: int = WAVE_BYTES, products: Accumulator | None = None,
) -> DataFrame:
    """Rows (key, client, cosine, rank, similarity): nearly always the ``k`` most similar clients.

    Every prospect row has its own ranking; rows without a direction have none. ``products`` counts cosines.
    """
    kinds = T.StructType([
        prospects.schema[key], T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("ids", T.ArrayType(graphs.schema[client_key].dataType)), T.StructField("cos", T.ArrayType(T.DoubleType())),
    ])
    none = [F.array().cast(kinds[c].dataType).alias(c) for c in ("ids", "cos")]
    state = prospects.select(key, vectors.unit(vectors.as_doubles(F.col(vector))).alias("v"), *none).filter("v is not null")
    state = evenly_dealt(state)
    for turn, wave in enumerate(_waves(graphs, wave_bytes)):
        state = checkpointed(state) if turn else state
        state = state.mapInArrow(_visit(graphs, wave, client_key, k, beam, products), kinds)
    ranked = state.select(key, F.posexplode(F.arrays_zip("ids", "cos")).alias("place", "hit"))
    ranked = ranked.select(
        key, F.col("hit.ids").alias(client_key), F.col("hit.cos").alias("cosine"), (F.col("place") + 1).alias("rank")
    )
    return ranked.withColumn("similarity", F.round(F.col("cosine") * 100, 2))


def _waves(graphs: DataFrame, wave_bytes: int) -> list[list[int]]:
    """Shards per wave, in the order of their numbers; sizes come from one grouped count."""
    single = graphs.schema["v"].dataType.elementType == T.FloatType()
    node = F.size("v") * (4 if single else 12) + 20 + LINKS * 16  # vector, id, length, links
    sizes = graphs.groupBy("shard").agg(F.sum(node).alias("bytes")).orderBy("shard").collect()
    waves, room = [], 0
    for r in sizes:
        if not waves or r["bytes"] > room:
            waves.append([])
            room = wave_bytes
        waves[-1].append(r["shard"])
        room -= r["bytes"]
    return waves


def _wave(rows: DataFrame, client_key: str) -> Graph:
    """The graph of one wave; its columns are fetched one after the other, which bounds what is held at a time."""
    table = rows.select("shard", "node", client_key, "norm").toArrow().combine_chunks()
    shard, node = table.column("shard").to_numpy(), table.column("node").to_numpy().astype(np.int64)
    address = _address(shard, node)
    across = rows.select("across").toArrow().combine_chunks().column(0).combine_chunks()
    to = across.flatten().to_numpy()
    at = np.searchsorted(address, to).astype(np.int32)
    there = address[np.minimum(at, len(address) - 1)] == to  # of another wave, if it was made smaller
    own = np.repeat(np.arange(len(address), dtype=np.int32), across.value_lengths().to_numpy())[there]
    at = at[there]
    del across, to, there
    links = rows.select("links").toArrow().combine_chunks().column(0).combine_chunks()
    x = _given(rows.select("v").toArrow().combine_chunks().column(0).combine_chunks())
    ids, norm = (table.column(c).to_numpy() for c in (client_key, "norm"))
    return make_graph(ids, x, links, np.arange(len(node)) - node, (own, at), norm)


def _visit(graphs: DataFrame, wave: list[int], client_key: str, k: int, beam: int, products: Accumulator | None):
    """A step that lets every prospect search the graph of one wave."""
    rows = graphs.filter(F.col("shard").isin(wave)).orderBy("shard", "node")
    shared = graphs.sparkSession.sparkContext.broadcast(_wave(rows, client_key))
    nodes = len(shared.value.ids)
    in_step = max(1, min(ROWS_IN_STEP, STEP_CELLS // nodes))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(in_step * nodes, np.int16)
        for batch in batches:
            for at in range(0, len(batch), in_step):
                yield visited(batch.slice(at, in_step), met)

    def visited(b: pa.RecordBatch, met: np.ndarray) -> pa.RecordBatch:
        x = _list_matrix(b.column(1))
        have = b.column(2).value_lengths().to_numpy()
        ids = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(shared.value.ids.dtype, copy=False)
        rows, node, cos, computed = search(shared.value, x, k, beam, met)
        if products is not None:
            products.add(computed)
        found = (np.repeat(np.arange(len(b)), have), rows), (ids, shared.value.ids[node]), (b.column(3).flatten().to_numpy(zero_copy_only=False), cos)
        rows, ids, cos, _ = _best_of(*map(np.concatenate, found), k)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(b)))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (ids, cos)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=b.schema.names)

    return step
