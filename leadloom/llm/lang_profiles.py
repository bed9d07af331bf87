"""Language identification by rank-order profiles of letter n-grams.

``learn`` counts the n-grams of whole documents, at most ``SAMPLE_DOCUMENTS`` per language, and keeps the ``PROFILE`` most
frequent of each language in rank order. Counting is two grouped jobs, letters first and then n-grams; only the common
letters and the profiles reach the driver. ``train`` is the same for texts at hand. ``identify`` ranks each whole document's own most frequent n-grams and sums, per
language, how far out of place each stands; an n-gram that the profile lacks counts as ``PROFILE`` places. The
language with the least distance wins, ties to the first name. The score is one minus the winner's share of the
greatest possible distance.

Null and empty texts and texts without a letter give ``und`` with score 0. Very long texts are counted whole, in parts.
Rows that repeat are judged alike; null ids count as held out. With no learnable row every text is ``und``; an empty table
gives an empty result. The result has the kept columns and two new ones, under other ``names`` where a kept column has
theirs. Every language that occurs is learned; a task holds a row of about 270,000 places for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import checkpointed, held_out, sampled_texts, strings, text_groups, with_columns_of

#: Labelled documents per language to learn from, the least by a hash of the id.
SAMPLE_DOCUMENTS = 400
#: N-grams of a profile, and most frequent n-grams of a document that are compared.
PROFILE = 400
LONGEST = 3
#: Letters told apart; rarer ones share a code. 0 is a word's edge.
ALPHABET = 62
UNKNOWN = "und"
#: Characters counted at a time.
PART_CHARS = 1 << 20


class Profiles(NamedTuple):
    languages: list[str]
    letters: dict[int, int]  # lower-case code point -> code from 1
    places: np.ndarray  # [language, n-gram code]: place in the profile, or PROFILE


def letter_codes(text: str, codes: np.ndarray) -> np.ndarray:
    """The text's lower-cased letters as codes, every run of other characters as one 0, and 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = codes[points]
    found = np.concatenate([[0], found, [0]]).astype(np.int64)
    return found[np.r_[True, (found[1:] != 0) | (found[:-1] != 0)]]


def gram_space(size: int) -> int:
    """Number of n-gram codes: those of one length follow those of the shorter ones."""
    return sum((size + 1) ** n for n in range(1, LONGEST + 1))


def count_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Counts of the n-grams up to ``LONGEST`` by code. A word's edge may begin or end an n-gram, never stand
    inside it or alone."""
    base, first = size + 1, 0
    total = np.zeros(gram_space(size), np.int64)
    for n in range(1, LONGEST + 1):
        room = total[first:first + base**n]
        for at in range(0, len(codes), PART_CHARS):
            part = codes[at:at + PART_CHARS + n - 1]
            if len(part) < n:
                continue
            gram, fine = part, part != 0
            if n > 1:
                fine = np.ones(len(part) - n + 1, bool) if n > 2 else (part[:-1] != 0) | (part[1:] != 0)
                for k in range(1, n):
                    gram = gram[:-1] * base + part[k:]
                    if k < n - 1:
                        fine &= part[k:len(part) - n + 1 + k] != 0
            room += np.bincount(gram[fine], minlength=len(room))
        first += base**n
    return total


def top_grams(counts: np.ndarray, most: int) -> np.ndarray:
    """Codes of the most frequent n-grams, by falling count and then code."""
    present = np.flatnonzero(counts)
    if len(present) > most:
        held = counts[present]
        least = np.partition(held, len(held) - most)[len(held) - most]
        present = present[held >= least]
    return present[np.argsort(-counts[present], kind="stable")][:most]


def _code_table(letters: dict[int, int], size: int) -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = size
    for point, code in letters.items():
        table[point] = code
    return table


def sample(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(label, text) of at most SAMPLE_DOCUMENTS whole documents per language from the rows that may be learned from."""
    labelled = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull()).select(id_col, F.col(lang_col).alias("label"))
    return sampled_texts(df, labelled, F.col(text_col), SAMPLE_DOCUMENTS, id_col=id_col)


def common_letters(tally: dict[str, int]) -> dict[int, int]:
    """Codes from 1 for the ALPHABET most frequent letters."""
    common = sorted((c for c in tally if c.isalpha()), key=lambda c: (-tally[c], c))[:ALPHABET]
    return {ord(c): k + 1 for k, c in enumerate(sorted(common))}


def _profiles(letters: dict[int, int], grams: dict[str, list[int]]) -> Profiles:
    languages = sorted(grams)
    places = np.full((len(languages), gram_space(len(letters) + 1)), PROFILE, np.int32)
    for k, language in enumerate(languages):
        places[k, grams[language]] = np.arange(len(grams[language]))
    return Profiles(languages, letters, places)


def train(rows: list[tuple[str, str]]) -> Profiles:
    """Profiles of (language, text) rows at hand."""
    letters = common_letters(Counter(c for _, text in rows for c in text.lower()))
    size = len(letters) + 1  # the last code stands for every other letter
    table = _code_table(letters, size)
    grams = {}
    for language in {lang for lang, _ in rows}:
        counts = sum(count_grams(letter_codes(t, table), size) for lang, t in rows if lang == language)
        grams[language] = top_grams(counts, PROFILE).tolist()
    return _profiles(letters, grams)


def learn(sampled: DataFrame) -> Profiles:
    """Profiles of sampled (label, text) rows, counted where the rows are."""
    sampled = checkpointed(sampled)

    def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                for text in texts:
                    tally.update(text.lower())
        found = [(c, n) for c, n in tally.items() if c.isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["c", "n"])

    tally = sampled.select("text").mapInArrow(count_letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    tally = tally.orderBy(F.desc("n"), "c").limit(ALPHABET)
    letters = common_letters({r["c"]: r["n"] for r in tally.collect()})
    size = len(letters) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _code_table(letters, size)
        for batch in batches:
            labels = np.array(strings(batch.column(0)), object)
            for label in dict.fromkeys(labels):
                total = np.zeros(gram_space(size), np.int64)
                for at in np.flatnonzero(labels == label):
                    total += count_grams(letter_codes(batch.column(1)[int(at)].as_py(), table), size)
                held = np.flatnonzero(total)
                columns = [pa.array([label] * len(held), pa.string()), pa.array(held), pa.array(total[held])]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "gram", "n"])

    counts = sampled.select(F.col("label").cast("string").alias("label"), "text").mapInArrow(count, "label string, gram long, n long")
    counts = counts.groupBy("label", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= PROFILE)
    grams: dict[str, list[int]] = {r["label"]: [] for r in sampled.select(F.col("label").cast("string").alias("label")).distinct().collect()}
    for r in sorted(best.collect(), key=lambda r: (r["label"], r["place"])):
        grams[r["label"]].append(r["gram"])
    return _profiles(letters, grams)


def distances(text: str, profiles: Profiles, table: np.ndarray) -> np.ndarray | None:
    """Mean places out of place per language, as a share of PROFILE; None without a letter."""
    codes = letter_codes(text, table)
    if not codes.any():
        return None
    grams = top_grams(count_grams(codes, len(profiles.letters) + 1), PROFILE)
    places = profiles.places[:, grams]
    apart = np.abs(places - np.arange(len(grams)))
    return np.where(places == PROFILE, PROFILE, apart).mean(axis=1) / PROFILE


def identify(
    df: DataFrame, profiles: Profiles, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The kept columns of every row with its language and score."""
    made: list[np.ndarray] = []

    def judge(text: str | None) -> tuple[str, float]:
        if not made:
            made.append(_code_table(profiles.letters, len(profiles.letters) + 1))
        far = distances(text, profiles, made[0]) if text and profiles.languages else None
        if far is None:
            return UNKNOWN, 0.0
        best = int(far.argmin())
        return profiles.languages[best], float(1 - far[best])

    def run(texts: pa.Array) -> list[pa.Array]:
        lang, score = zip(*(judge(t.as_py()) for t in texts))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return with_columns_of(df, text_col, keep, run, dict(zip(names, ("string", "double"))))
