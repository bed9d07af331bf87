"""SentencePiece encoding and decoding by vectorised merge rounds.

``PieceCodec`` reads the vocabulary of a BPE model with byte fallback, identity normalisation and a dummy
prefix. A text becomes words that start at a run of spaces (no piece goes on over a word's start, which is
checked against the vocabulary); each distinct word of a batch is encoded once by ``merging.merge_words``.
Words are cut further where two neighbouring characters stand together in no piece, so that texts without any
space stay cheap.

Null texts count as empty and give no ids; an empty text decodes to an empty text. Any other column of the
input is passed through, and columns named like the results are replaced by them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import map_batches, spans, text_groups
from leadloom.llm.merging import PairTable, merge_words

SPACE = "▁"
#: Distinct words kept encoded between the batches of a task.
CACHED_WORDS = 300_000
#: Characters of new words merged in one go, so that the arrays stay in the processor's cache.
ROUND_CHARS = 200_000


class PieceCodec:
    def __init__(self, model_file: str, cached_words: int = CACHED_WORDS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.vocab_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.by_text = {self.pieces[i]: i for i in plain}
        self.space_id = self.by_text[SPACE]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in plain):
            raise ValueError("a piece reaches over the start of a word")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self._load_pairs(model, plain)
        self._load_characters(plain)
        self._load_bytes(model)
        self.cached_words = cached_words
        self.forget()

    def _load_pairs(self, model, plain: list[int]) -> None:
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        rows = [
            (self.by_text[p[:k]], self.by_text[p[k:]], order[model.get_score(i)], i)
            for i in plain for p in (self.pieces[i],) for k in range(1, len(p))
            if p[:k] in self.by_text and p[k:] in self.by_text
        ]
        self.table = PairTable(*(np.array(c) for c in zip(*rows)))
        runs = [i for i in plain if len(self.pieces[i]) > 1 and set(self.pieces[i]) == {SPACE}]
        self.longest_run = max([1, *(len(self.pieces[i]) for i in runs)])
        # long runs of spaces fall into whole pieces from the left, if runs rank alike and last of all, and no
        # piece has two spaces before other characters
        self.even_runs = (
            {model.get_score(i) for i in runs} == {scores[-1]}
            and not any(re.match(f"{SPACE}{SPACE}+[^{SPACE}]", self.pieces[i]) for i in plain)
            and all(
                merge_words(self.table, np.full(n, self.space_id), np.array([n]))[0][:2].tolist()
                == [self.by_text[SPACE * self.longest_run]] * 2
                for n in range(2 * self.longest_run, 4 * self.longest_run)
            )
        )

    def _load_characters(self, plain: list[int]) -> None:
        self.char_id = np.full(0x110000, -1, np.int32)
        seen = set()
        for i in plain:
            p = self.pieces[i]
            if len(p) == 1:
                self.char_id[ord(p)] = i
            seen.update(zip(p, p[1:]))
        pairs = np.array(sorted((ord(a) << 21) | ord(b) for a, b in seen), np.int64)
        self.neighbours = pairs

    def _load_bytes(self, model) -> None:
        out = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                out.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i):
                out.append(b"")
            elif model.is_unknown(i):
                out.append(" ⁇ ".encode())
            else:
                out.append(p.replace(SPACE, " ").encode())
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.piece_size = np.array([len(x) for x in out], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size

    def forget(self) -> None:
        """An empty cache: word -> number; the ids of word n lie at start[n] in the pool."""
        self.known: dict[str, int] = {}
        self.pool, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.learned: list[tuple[np.ndarray, np.ndarray]] = []

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        words = [f" {w}" for w in text.replace(SPACE, " ").split(" ")]
        if " " in words:  # runs of spaces: the empty parts belong to the next word
            joined, held = [], ""
            for w in words:
                held += " "
                if len(w) > 1:
                    joined.append(held + w[1:])
                    held = ""
            words = joined + ([held] if held else [])
            if self.even_runs:
                words = [part for w in words for part in self._cut_run(w)]
        return words

    def _cut_run(self, word: str) -> list[str]:
        run, whole = len(word) - len(word.lstrip(" ")), self.longest_run
        blocks = max(0, (run - whole - 1) // whole)
        return [" " * whole] * blocks + [word[blocks * whole:]]

    def _learn(self, words: list[str]) -> None:
        """Encode new words and append them to the pool."""
        text = "".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(text, np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        sym = self.char_id[chars]
        # cut words between characters that no piece has side by side
        pair = (chars[:-1].astype(np.int64) << 21) | chars[1:]
        slot = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
        cut = np.r_[True, self.neighbours[slot] != pair]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        out, sizes = merge_words(self.table, sym, np.diff(np.r_[starts, len(chars)]))
        # characters outside the vocabulary stand alone in their part: their bytes replace them
        part_at = np.cumsum(sizes) - sizes
        odd = np.flatnonzero(sym[starts] < 0)
        width = np.ones(len(out), np.int64)
        odd_bytes = [chr(c).encode("utf-8", "replace") for c in chars[starts[odd]]]
        width[part_at[odd]] = [len(b) for b in odd_bytes]
        at = np.cumsum(width) - width
        ids = np.empty(int(width.sum()), np.int32)
        ids[at] = out
        if len(odd):
            where = spans(at[part_at[odd]], width[part_at[odd]])
            ids[where] = self.byte_ids[np.frombuffer(b"".join(odd_bytes), np.uint8)]
        owner = np.repeat(np.repeat(np.searchsorted(ends, starts, side="right"), sizes), width)
        count = np.bincount(owner, minlength=len(words))
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))
        self.learned.append((ids, count))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The number of each of the words; one lookup each, and a second one for those that were new."""
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if not len(new):
            return number
        if len(self.known) > self.cached_words:
            self.forget()
            new = np.arange(len(words))
        asked = [words[k] for k in new.tolist()]
        part, chars = [], 0
        for w in dict.fromkeys(asked):
            part.append(w)
            chars += len(w)
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
        """Flat ids and the number of ids of each text."""
        words, counts = [], []
        for t in texts:
            w = self._words(t)
            words += w
            counts.append(len(w))
        number = self._numbers(words)
        sizes = self.size[number]
        ids = self.pool[spans(self.start[number], sizes)]
        edges = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(np.array(counts, np.int64))]]
        return ids, np.diff(edges)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of ids, as UTF-8; the dummy prefix goes, broken byte sequences become U+FFFD."""
        sizes = self.piece_size[ids]
        flat = self.piece_bytes[spans(self.piece_start[ids], sizes)].tobytes()
        edges = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        out = []
        for a, b in zip(edges, edges[1:]):
            text = flat[a + 1:b] if flat[a:a + 1] == b" " else flat[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode("utf-8", "replace").encode()
            out.append(text)
        return out


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec, with its cache, in each Python process."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def forget(model_file: str) -> None:
    """Empty the cache of this process, where there is one."""
    if model_file in _CODECS:
        _CODECS[model_file].forget()


def encode(df: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The frame with a column of ids, without begin and end ids."""
    kept = [c for c in df.columns if c.lower() != ids_col.lower()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [codec(model_file).encode(texts) for _, texts in text_groups(batch.column(len(kept)))]
        counts = np.concatenate([c for _, c in parts])
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([i for i, _ in parts]), pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*kept, ids_col])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{ids_col}` array<int>"
    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("▁text")), run, schema, lambda: forget(model_file))


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The frame with the text of a column of ids; null ids give an empty text."""
    kept = [c for c in df.columns if c.lower() != text_col.lower()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [x or [] for x in batch.column(len(kept)).to_pylist()]
        ids = np.array([i for x in lists for i in x], np.int64)
        texts = codec(model_file).decode(ids, np.array([len(x) for x in lists], np.int64))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t.decode() for t in texts])], names=[*kept, text_col])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{text_col}` string"
    return map_batches(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias("▁ids")), run, schema)


def round_trip_digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and keep only the number of ids and the SHA-256 of ids and decoded text.

    The ids never leave the Python worker, which spares Spark several bytes per byte of text.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(model_file)
        n, ids_sha, text_sha = [], [], []
        for _, texts in text_groups(batch.column(1)):
            ids, counts = own.encode(texts)
            decoded = own.decode(ids, counts)
            at = 0
            for count, text in zip(counts.tolist(), decoded):
                joined = ",".join(map(str, ids[at:at + count].tolist()))
                at += count
                n.append(count)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(text).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(df.select(f"`{id_col}`", f"`{text_col}`"), run, schema, lambda: forget(model_file))
