"""Quality classification by a convolutional network over bytes, in numpy.

The whole text, as UTF-8, is cut into overlapping chunks of ``CHUNK`` bytes; neighbours share ``WIDTH - 1`` bytes,
so that every window of ``WIDTH`` bytes lies in one chunk. ``FILTERS`` learned filters run over each chunk and
their rectified responses are max-pooled per chunk. The mean and the maximum of the chunk maxima over the
document are combined by a learned logistic layer into one probability.

A filter is a table of one weight per (place, byte value), which is a convolution over one-hot bytes; scoring
looks two bytes up at once in tables of their sums. Training is stochastic gradient descent over the whole texts of
at most ``SAMPLE_DOCUMENTS`` labelled rows per label, which the driver holds; scoring and training read a text in
blocks of chunks.

Null and empty texts score 0. Very long texts are read whole. Rows that repeat are scored alike, equal scores are left as
they are. Without a labelled row of both kinds every text scores the share of label 1 among them (0.5 without any). An
empty table gives an empty result. The result has the kept columns and the score; a kept column of its name, in any letter
case, is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import held_out, sampled_texts, with_columns_of

CHUNK = 128
WIDTH = 6
FILTERS = 16
#: Labelled documents per label to learn from, the least by a hash of the id.
SAMPLE_DOCUMENTS = 1500
#: Steps of the descent, whatever the size of the sample.
STEPS = 1100
RATE = 0.05
DECAY = 1e-4
BATCH = 32
THRESHOLD = 0.7
#: Chunks scored at a time.
PART_CHUNKS = 2048


class Network(NamedTuple):
    filters: np.ndarray  # [place, byte, filter]
    bias: np.ndarray  # [filter]
    mean_weight: np.ndarray
    max_weight: np.ndarray
    offset: float

    def pair_tables(self) -> np.ndarray:
        """[place pair, two bytes, filter]: sums for two neighbouring places."""
        t = self.filters
        return np.stack([(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)])


def chunk_rows(text: bytes) -> np.ndarray:
    """[chunk, CHUNK] bytes; the last chunk is moved back to end with the text, a short text is zero-padded."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < CHUNK:
        return np.pad(data, (0, CHUNK - len(data)))[None, :]
    starts = np.arange(0, len(data) - CHUNK + 1, CHUNK - WIDTH + 1)
    if starts[-1] + CHUNK < len(data):
        starts = np.append(starts, len(data) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[starts]


def responses(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """[chunk, place, filter] before bias and rectification."""
    wide = rows.astype(np.int32)
    pairs = wide[:, :-1] * 256 + wide[:, 1:]
    n = CHUNK - WIDTH + 1
    out = np.take(tables[0], pairs[:, :n], axis=0)
    for k in range(1, len(tables)):
        out += np.take(tables[k], pairs[:, 2 * k:2 * k + n], axis=0)
    return out


def pooled(text: bytes, tables: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and maximum over all chunks of the chunk maxima."""
    rows = chunk_rows(text)
    total, most = np.zeros(len(bias)), np.zeros(len(bias), np.float32)
    for k in range(0, len(rows), PART_CHUNKS):
        best = np.maximum(responses(rows[k:k + PART_CHUNKS], tables).max(axis=1) + bias, 0)
        total += best.sum(axis=0)
        most = np.maximum(most, best.max(axis=0))
    return total / len(rows), most


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probability(text: bytes, net: Network, tables: np.ndarray) -> float:
    if not text:
        return 0.0
    mean, most = pooled(text, tables, net.bias)
    return float(sigmoid(mean @ net.mean_weight + most @ net.max_weight + net.offset))


def train(rows: list[tuple[int, bytes]], seed: int = 7) -> Network:
    """Fit to (label, text) rows; labels are weighted to count alike in sum."""
    rng = np.random.default_rng(seed)
    rows = [(y, t) for y, t in rows if t]
    labels = np.array([y for y, _ in rows], np.float64)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS), rng.normal(0, 0.1, FILTERS), 0.0,
    )
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-6, 1 - 1e-6))
        return net._replace(mean_weight=net.mean_weight * 0, max_weight=net.max_weight * 0, offset=float(np.log(share / (1 - share))))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    chunks = [chunk_rows(t) for _, t in rows]
    filters, bias, wide, peak, offset = net.filters.copy(), net.bias.copy(), net.mean_weight, net.max_weight, net.offset
    done = 0
    while done < STEPS:
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            rate = RATE * max(0.0, 1 - done / STEPS)
            done += 1
            chosen = order[at:at + BATCH]
            sizes = np.array([len(chunks[i]) for i in chosen])
            data = np.concatenate([chunks[i] for i in chosen])
            where, best = _highest(data, filters, bias)
            firsts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(chosen)), sizes)
            mean = np.add.reduceat(best, firsts, axis=0) / sizes[:, None]
            most = np.maximum.reduceat(best, firsts, axis=0)
            error = (sigmoid(mean @ wide + most @ peak + offset) - labels[chosen]) * weight[chosen] / len(chosen)
            back = (error / sizes)[owner, None] * wide + (best == most[owner]) * error[owner, None] * peak
            back *= best > 0
            grad = np.zeros((WIDTH * 256, FILTERS))
            for k in range(WIDTH):
                value = np.take_along_axis(data, where + k, axis=1).astype(np.int64)
                cell = (k * 256 + value) * FILTERS + np.arange(FILTERS)
                grad += np.bincount(cell.ravel(), back.ravel(), WIDTH * 256 * FILTERS).reshape(-1, FILTERS)
            filters = (filters * (1 - rate * DECAY) - rate * 10 * grad.reshape(filters.shape)).astype(np.float32)
            bias = (bias - rate * back.sum(axis=0)).astype(np.float32)
            wide = wide * (1 - rate * DECAY) - rate * 10 * (error @ mean)
            peak = peak * (1 - rate * DECAY) - rate * (error @ most)
            offset -= rate * 10 * error.sum()
    return Network(filters, bias, wide, peak, float(offset))


def _plain_responses(rows: np.ndarray, filters: np.ndarray) -> np.ndarray:
    n = CHUNK - WIDTH + 1
    out = np.take(filters[0], rows[:, :n], axis=0)
    for k in range(1, WIDTH):
        out += np.take(filters[k], rows[:, k:k + n], axis=0)
    return out


def _highest(rows: np.ndarray, filters: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[chunk, filter]: the place of the highest response, and that response after bias and rectification."""
    where, best = [], []
    for k in range(0, len(rows), PART_CHUNKS):
        raw = _plain_responses(rows[k:k + PART_CHUNKS], filters)
        where.append(raw.argmax(axis=1))
        best.append(np.take_along_axis(raw, where[-1][:, None, :], 1)[:, 0])
    return np.concatenate(where), np.maximum(np.concatenate(best) + bias, 0)


def sample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[int, bytes]]:
    """At most SAMPLE_DOCUMENTS whole texts (label, bytes) per label from the rows that may be learned from."""
    labelled = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("label"))
    rows = sampled_texts(documents, labelled, F.col(text_col), SAMPLE_DOCUMENTS, id_col=id_col)
    return sorted((r["label"], r["text"].encode()) for r in rows.toLocalIterator())


def score(
    df: DataFrame, net: Network, text_col: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "score"
) -> DataFrame:
    """The kept columns of every row with its score."""
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"name the score otherwise than {name}")
    made: list[np.ndarray] = []

    def run(texts: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(net.pair_tables())
        return [pa.array([probability((t.as_py() or "").encode(), net, made[0]) for t in texts], pa.float64())]

    return with_columns_of(df, text_col, keep, run, {name: "double"})
