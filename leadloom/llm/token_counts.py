"""Token counts of whole texts by compiled finite-state transducers, equal to the tokenizer library's.

``word_cuts`` finds the words, ``count_machine`` adds up their tokens. Special tokens that stand in a text count one each and
part it, as the library's default is. Supported are byte-level BPE files without a normalizer, with the usual pattern,
whose special tokens take no neighbouring white space; other files are refused.

The driver reads the tokenizer and probes its classes of characters, a table of a few thousand ranges; a Python worker builds
the machine from it once, and forgets its states whenever a task ends. Texts run in groups of about 2 MB; a longer text runs
alone and needs some 30 bytes per character.

Null and empty texts have no bytes and no tokens. Rows that repeat, tie or have no id each get a row. An empty table gives
an empty result. The result has the kept columns, ``n_bytes`` and ``n_tokens``; where a kept column has such a name, in any
letter case, other ``names`` must be given.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadloom.llm import word_cuts
from leadloom.llm.common import text_groups, with_columns_of
from leadloom.llm.count_machine import CountMachine, Merges
from leadloom.llm.word_tokens import byte_letters


@dataclass(frozen=True)
class Compiled:
    """What tasks need of a tokenizer: merges, special tokens, and the first code point and class of every range."""

    pairs: tuple[tuple[bytes, bytes], ...]
    special: tuple[str, ...]
    range_starts: tuple[int, ...]
    range_kinds: tuple[int, ...]


@cache
def compiled(model_file: str) -> Compiled:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(model_file)
    spec = json.loads(library.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    greedy = any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    if odd or not plain or greedy or spec["normalizer"] or model["type"] != "BPE":
        raise ValueError(f"{model_file}: not a plain byte-level BPE")
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs = tuple(tuple(bytes(byte_of[c] for c in part) for part in m) for m in merges)
    kinds = word_cuts.probed_classes(library)
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    return Compiled(pairs, tuple(t["content"] for t in spec["added_tokens"]), tuple(starts.tolist()), tuple(kinds[starts].tolist()))


class TokenCounter:
    def __init__(self, tokenizer: Compiled) -> None:
        sizes = np.diff([*tokenizer.range_starts, word_cuts.END_POINT + 1])
        self.kinds = np.repeat(np.array(tokenizer.range_kinds, np.uint8), sizes)
        self.machine = CountMachine(Merges(list(tokenizer.pairs)))
        longest_first = sorted(tokenizer.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first)) or r"(?!)")

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """Tokens of every text."""
        if not texts:
            return np.zeros(0, np.int64)
        parts = [self.special.split(t) for t in texts]
        end = np.array([word_cuts.END_POINT], np.uint32)
        points = np.concatenate(
            [x for text in parts for p in text for x in (np.frombuffer(p.encode("utf-32-le"), np.uint32), end)]
        )
        data = np.frombuffer("".join(p for text in parts for p in text).encode(), np.uint8)
        marks = np.flatnonzero(word_cuts.word_starts(self.kinds[points]))
        ends = points == word_cuts.END_POINT
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000) - 4 * ends
        at = np.concatenate([[0], np.cumsum(width)])
        starts = at[marks]
        lengths = np.diff(np.append(starts, at[-1]))
        words = self.machine.counts(data, starts, lengths)
        pieces = np.array([len(p) for p in parts], np.int64)
        piece_of = np.cumsum(ends) - ends  # ends ahead of each place
        owner = np.repeat(np.arange(len(texts)), pieces)[piece_of[marks]]
        return np.bincount(owner, weights=words, minlength=len(texts)).astype(np.int64) + pieces - 1


@lru_cache(maxsize=1)
def _counter(tokenizer: Compiled) -> TokenCounter:
    return TokenCounter(tokenizer)


def count_tokens(
    df: DataFrame, model_file: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
    names: tuple[str, str] = ("n_bytes", "n_tokens"),
) -> DataFrame:
    """The kept columns of every row with its bytes and tokens."""
    if clash := {c.lower() for c in keep} & {c.lower() for c in names}:
        raise ValueError(f"name the results otherwise than {sorted(clash)}")
    tokenizer = compiled(model_file)

    def run(column: pa.Array) -> list[pa.Array]:
        counter = _counter(tokenizer)
        sizes, counts = [], []
        for _, texts in text_groups(column):
            sizes += [len(t.encode()) for t in texts]
            counts.append(counter.counts(texts))
        return [pa.array(sizes, pa.int64()), pa.array(np.concatenate(counts), pa.int64())]

    return with_columns_of(df, text_col, keep, run, dict(zip(names, ("long", "long"))), done=lambda: _counter(tokenizer).machine.forget())
