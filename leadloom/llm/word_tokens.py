"""Token ids of a byte-level word BPE, for many texts at once.

A text is cut at white space, which this kind of tokenizer drops, and each distinct chunk is encoded once per
task (while the cache has room). Chunks of plain Latin letters, digits and marks go through the vectorised merge rounds of
``merging``; any other chunk, and one that may hold a special token, is handed to the tokenizer library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np

from leadloom.llm.common import spans
from leadloom.llm.merging import PairTable, merge_words

CACHED_CHUNKS = 400_000
ROUND_CHARS = 200_000
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters.update({b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in letters)})
    return [letters[b] for b in range(256)]


class WordCodec:
    def __init__(self, model_file: str, cached_chunks: int = CACHED_CHUNKS) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model_file)
        spec = json.loads(self.library.to_str())
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rows = np.array([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs)])
        self.table = PairTable(*rows.T)
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.odd = re.compile("[^\u0000-ɏ]")
        self.gaps = re.compile(f"[{WHITE}]+")
        # characters that str.split takes for white space and the tokenizer does not
        self.controls = re.compile("[\x1c-\x1f]")
        self.cached_chunks = cached_chunks
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.learned: list[tuple[np.ndarray, np.ndarray]] = []

    def _chunks(self, text: str) -> list[str]:
        if self.controls.search(text):
            return [c for c in self.gaps.split(text) if c]
        return text.split()

    def _by_library(self, chunk: str) -> bool:
        return bool(self.odd.search(chunk)) or any(s in chunk for s in self.special)

    def _learn(self, chunks: list[str]) -> None:
        foreign = []
        joined = "\n".join(chunks)
        if self._by_library(joined):  # some chunk is not for the merge rounds
            own = [not self._by_library(c) for c in chunks]
            foreign = [
                (k, self.library.encode(c, add_special_tokens=False).ids)
                for k, (c, fine) in enumerate(zip(chunks, own)) if not fine
            ]
            joined = "\n".join(c if fine else "" for c, fine in zip(chunks, own))
        found = self.words.findall(joined.lower())
        ends = np.array([w == "\n" for w in found] + [True])
        counts = np.diff(np.r_[-1, np.flatnonzero(ends)]) - 1
        pretokens = [w for w in found if w != "\n"]
        data = np.frombuffer("".join(pretokens).encode(), np.uint8)
        byte_of = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # where each character starts
        stops = byte_of[np.cumsum(np.fromiter(map(len, pretokens), np.int64, len(pretokens)))]
        lengths = np.diff(np.r_[0, stops])
        sym = self.inner[data]
        sym[stops - 1] = self.final[data[stops - 1]]
        out, sizes = merge_words(self.table, sym, lengths)
        edges = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]
        size = np.diff(edges)
        for k, ids in foreign:
            out = np.insert(out, edges[k], np.array(ids, np.int32)) if ids else out
            edges[k + 1:] += len(ids)
            size[k] += len(ids)
        base = len(self.known)
        self.known.update(zip(chunks, range(base, base + len(chunks))))
        self.learned.append((out.astype(np.int32), size))

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The number of each of the chunks; one lookup each, and a second one for those that were new."""
        number = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(number < 0)
        if not len(new):
            return number
        if len(self.known) > self.cached_chunks:
            self.forget()
            new = np.arange(len(chunks))
        asked = [chunks[k] for k in new.tolist()]
        part, chars = [], 0
        for c in dict.fromkeys(asked):
            part.append(c)
            chars += len(c)
            if chars >= ROUND_CHARS:
                self._learn(part)
                part, chars = [], 0
        if part:
            self._learn(part)
        self.pool = np.concatenate([self.pool, *(ids for ids, _ in self.learned)])
        self.size = np.concatenate([self.size, *(n for _, n in self.learned)])
        self.start, self.learned = np.cumsum(self.size) - self.size, []
        number[new] = np.fromiter(map(self.known.__getitem__, asked), np.int64, len(asked))
        return number

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of whole texts and the number of ids of each, without any special token added."""
        chunks, counts = [], []
        for t in texts:
            found = self._chunks(t)
            chunks += found
            counts.append(len(found))
        number = self._numbers(chunks)
        sizes = self.size[number]
        ids = self.pool[spans(self.start[number], sizes)]
        edges = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(np.array(counts, np.int64))]]
        return ids, np.diff(edges)


_CODECS: dict[str, WordCodec] = {}


def codec(model_file: str) -> WordCodec:
    """One codec, with its cache, in each Python process."""
    if model_file not in _CODECS:
        _CODECS[model_file] = WordCodec(model_file)
    return _CODECS[model_file]


def forget(model_file: str) -> None:
    """Empty the cache of this process, where there is one."""
    if model_file in _CODECS:
        _CODECS[model_file].forget()
