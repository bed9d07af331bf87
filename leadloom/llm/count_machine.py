"""Token counts of a byte-pair encoding by a deterministic transducer over bytes.

The encoding of a word's every prefix ends in one token, and it is the only token t there that the encoding of the bytes
before t may be followed by: merging the two side by side must leave them as they are (``apart``). So a state need only
know, for each place from which a token may still reach beyond the present byte, which tokens may begin there and how many
tokens fewer the prefix up to there has. While many tokens could begin, the last token before the place stands for
them; once the bytes since leave few, they are told apart and a place without any is dropped. Each transition carries by how many tokens the prefix's encoding grows or shrinks
with its byte; the sum over a word is its number of tokens.

There are finitely many states, but far more than any text meets, so transitions are compiled when first met and kept up
to ``MOST_STATES`` and ``MOST_TRANSITIONS``; beyond that the machine starts anew. Results do not depend on it.
"""

from __future__ import annotations

import numpy as np

MOST_STATES, MOST_TRANSITIONS = 60_000, 300_000
#: Bytes of words that advance together; they add at most as many states.
PART_BYTES = 1 << 16
#: Words of more bytes run alone.
LONG = 64
#: Possible tokens up to which a place lists them.
FEW = 64


class Merges:
    """Tokens as bytes, and the merge that makes each. Tokens that merging can never reach are left out."""

    def __init__(self, pairs: list[tuple[bytes, bytes]]) -> None:
        self.token = {bytes([b]): b for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(-1, -1)] * 256
        self.made: list[int] = [-1] * 256
        for r, (a, b) in enumerate(pairs):
            if a + b in self.token:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[self.token[a], self.token[b]] = r
            self.token[a + b] = len(self.parts)
            self.parts.append((self.token[a], self.token[b]))
            self.made.append(r)
        reached = [True] * 256
        for (a, b), r in zip(self.parts[256:], self.made[256:]):
            reached.append(reached[a] and reached[b] and self.apart(a, b, r))
        self.token = {t: k for t, k in self.token.items() if reached[k]}
        self.longer: dict[bytes, list[bytes]] = {}  # tokens that go on after these bytes
        for t in self.token:
            for k in range(len(t)):
                self.longer.setdefault(t[:k], []).append(t)

    def apart(self, a: int, b: int, taken: int | None = None) -> bool:
        """Whether merging the bytes of a and b together gives just a and b, at least until the merge ``taken``.

        Undo their merges, the latest first, and look at the two symbols that meet: they must not merge before one
        of them is taken by its own side. Of equal merges the left one goes first.
        """
        if taken is None:
            taken = len(self.rank)
        while True:
            if self.rank.get((a, b), taken) < taken:
                return False
            if self.made[a] > self.made[b]:
                taken, a = self.made[a], self.parts[a][1]
            elif self.made[b] >= 0:
                taken, b = self.made[b] + 1, self.parts[b][0]
            else:
                return True


class CountMachine:
    def __init__(self, merges: Merges, most_states: int = MOST_STATES) -> None:
        self.merges, self.most_states = merges, most_states
        self.forget()

    def forget(self) -> None:
        """Drop all compiled states but the first."""
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, 256), -1, np.int32)
        self.gain = np.zeros((1024, 256), np.int16)
        self.opened: dict[tuple[int, bytes], tuple | None] = {}
        self.transitions = 0
        self.first = self._id((b"", ((-1, 0),)))

    def _id(self, state: tuple) -> int:
        at = self.ids.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
            if at == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
        return at

    def _compile(self, at: int, byte: int) -> None:
        """A state is the bytes since its first place, and for each place (last token or tuple of tokens, count) or None."""
        merges = self.merges
        tail, places = self.states[at]
        whole = tail + bytes([byte])
        for begin, place in enumerate(places):
            own = whole[begin:]
            token = merges.token.get(own)
            if token is None or place is None:
                continue
            before, count = place
            if own in before if isinstance(before, tuple) else before < 0 or merges.apart(before, token):
                break
        gain = count + 1
        kept: list[tuple | None] = []
        for k, place in enumerate(places):
            before = None if place is None else self._open(place[0], whole[k:])
            kept.append(None if before is None else (before, place[1] - gain))
        first = next((k for k, place in enumerate(kept) if place is not None), len(kept))
        after = self._id((whole[first:], (*kept[first:], (token, 0))))
        self.next[at, byte], self.gain[at, byte] = after, gain
        self.transitions += 1

    def _open(self, before: int | tuple, head: bytes) -> int | tuple | None:
        """What may still begin at a place that ``head`` follows: given by the token before it, or as the tokens."""
        if isinstance(before, tuple):
            return tuple(t for t in before if len(t) > len(head) and t.startswith(head)) or None
        tokens = self.merges.longer.get(head, ())
        if len(tokens) > FEW:
            return before
        if (before, head) not in self.opened:
            ids = self.merges.token
            self.opened[before, head] = tuple(t for t in tokens if before < 0 or self.merges.apart(before, ids[t])) or None
        return self.opened[before, head]

    def _full(self) -> bool:
        return len(self.states) > self.most_states or self.transitions > MOST_TRANSITIONS

    def _alone(self, word: bytes) -> int:
        at, total = self.first, 0
        for byte in word:
            after = self.next.item(at, byte)
            if after < 0:
                if self._full():
                    state = self.states[at]
                    self.forget()
                    at = self._id(state)
                self._compile(at, byte)
                after = self.next.item(at, byte)
            total += self.gain.item(at, byte)
            at = after
        return total

    def _together(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Counts of words by falling length."""
        if self._full():
            self.forget()
        at = np.full(len(starts), self.first, np.int64)
        total = np.zeros(len(starts), np.int64)
        for k in range(int(lengths[0]) if len(lengths) else 0):
            m = int(np.searchsorted(-lengths, -k, "left"))  # words of more than k bytes
            key = at[:m] * 256 + data[starts[:m] + k]
            after = self.next.reshape(-1)[key]
            if (missing := after < 0).any():
                for state, byte in zip(*divmod(np.unique(key[missing]), 256)):
                    self._compile(int(state), int(byte))
                after = self.next.reshape(-1)[key]
            total[:m] += self.gain.reshape(-1)[key]
            at[:m] = after
        return total

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every word (start, length) of ``data``."""
        out = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(lengths > LONG):
            out[k] = self._alone(data[starts[k]:starts[k] + lengths[k]].tobytes())
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        ends = np.cumsum(lengths[short])
        part = 0
        while part < len(short):
            done = ends[part - 1] if part else 0
            upto = max(part + 1, int(np.searchsorted(ends, done + PART_BYTES, "right")))
            own = short[part:upto]
            own = own[np.argsort(-lengths[own], kind="stable")]
            out[own] = self._together(data, starts[own], lengths[own])
            part = upto
        return out
