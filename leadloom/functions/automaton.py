"""Many words looked for in one pass over a text: Aho-Corasick automata, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class WordFinder:
    """Words with places in a list; the same word may stand at several places, and the first counts."""

    def __init__(self, words: Sequence[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.empty: int | None = None  # the empty word is in every text
        for place, word in enumerate(words):
            if not word:
                self.empty = place if self.empty is None else self.empty
            elif word not in self.automaton:
                self.automaton.add_word(word, place)
        self.automaton.make_automaton()
        self.none = not len(self.automaton)

    def _places(self, text: str) -> Iterable[int]:
        return () if self.none else (place for _, place in self.automaton.iter(text))

    def first(self, text: str) -> int | None:
        """The least place of a word that occurs in the text."""
        best = self.empty
        for place in self._places(text):
            if best is None or place < best:
                best = place
                if not best:
                    break
        return best

    def all(self, text: str) -> set[int]:
        """The places of all words that occur in the text."""
        found = set(self._places(text))
        if self.empty is not None:
            found.add(self.empty)
        return found

    def any(self, text: str) -> bool:
        return self.empty is not None or next(iter(self._places(text)), None) is not None
