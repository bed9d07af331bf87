"""A deterministic transducer for the word pattern of byte-level BPE tokenizers, run over all texts of a group at once.

The pattern cuts contractions, runs of letters, digits or marks with one space before them, and white space, whose last
character stays apart if something follows. ``step`` states that as a transducer over eleven classes of characters:
which state follows, and whether a word begins at this character or at the one before (so much delay is needed).

Characters are dealt into chunks of equal length. All chunks advance together from every state, which gives each chunk's
map from the state before it to the state after it. Maps compose by a prefix scan in a logarithmic number of passes, so
every chunk's first state is known, and one more pass marks the words. Ends of texts lead from any state to the first one,
so texts need not be told apart.
"""

from __future__ import annotations

import numpy as np

LETTER, NUMBER, MARK, SPACE, WHITE, APOSTROPHE, END, SHORT, RV, L, E = range(11)
START, LETTERS, NUMBERS, MARKS, AP, AP_RV, AP_L, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE = range(11)
CLASSES = STATES = 11
#: Code points are probed up to here; the planes above hold no letters, digits or white space.
PROBED = 0x40000
#: Stands for the end of a text.
END_POINT = 0x110000
CHUNK = 128
_LETTERS = (LETTER, SHORT, RV, L, E)


def _first(kind: int) -> int:
    """State after the first character of a word."""
    if kind in _LETTERS:
        return LETTERS
    return {NUMBER: NUMBERS, MARK: MARKS, APOSTROPHE: AP, SPACE: ONE_SPACE, WHITE: ONE_WHITE, END: START}[kind]


def step(state: int, kind: int) -> tuple[int, bool, bool]:
    """(next state, a word begins here, a word begins at the character before)."""
    letter, cut = kind in _LETTERS, (_first(kind), True, False)
    if state == LETTERS:
        return (LETTERS, False, False) if letter else cut
    if state == NUMBERS:
        return (NUMBERS, False, False) if kind == NUMBER else cut
    if state == MARKS:
        return (MARKS, False, False) if kind in (MARK, APOSTROPHE) else cut
    if state == AP:  # a word that begins with an apostrophe: contraction or marks
        after = {SHORT: START, RV: AP_RV, L: AP_L, MARK: MARKS, APOSTROPHE: MARKS}.get(kind)
        return cut if after is None else (after, False, False)
    if state in (AP_RV, AP_L):
        if kind == (E if state == AP_RV else L):
            return START, False, False
        return _first(kind), not letter, True
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if kind in (SPACE, WHITE):
            return (RUN_SPACE if kind == SPACE else RUN_WHITE), False, False
        if kind == END or state == ONE_WHITE:
            return cut
        if state == RUN_WHITE:
            return _first(kind), True, True
        return (MARKS if kind == APOSTROPHE else _first(kind)), False, state == RUN_SPACE
    return cut


_STEPS = [[step(s, k) for k in range(CLASSES)] for s in range(STATES)]
#: Flat by state * CLASSES + class: next state * CLASSES, and 1 (here) + 2 (before).
NEXT = np.array([x[0] * CLASSES for row in _STEPS for x in row], np.uint8)
BEGINS = np.array([x[1] + 2 * x[2] for row in _STEPS for x in row], np.uint8)


def probed_classes(library) -> np.ndarray:
    """Class of every code point, as the tokenizer library's own pre-tokenizer sees it.

    Between two letters only a letter makes no cut, between digits only a digit, between marks only a mark.
    """
    points = [c for c in range(PROBED) if not 0xD800 <= c < 0xE000]
    kinds = np.full(END_POINT + 1, MARK, np.uint8)
    probed = np.full(len(points), WHITE, np.uint8)
    for between, kind in (("!", MARK), ("1", NUMBER), ("a", LETTER)):
        text = between + between.join(map(chr, points)) + between
        cuts = np.zeros(len(text) + 1, bool)
        cuts[[span[0] for _, span in library.pre_tokenizer.pre_tokenize_str(text)]] = True
        at = 2 * np.arange(len(points)) + 1
        probed[~cuts[at] & ~cuts[at + 1]] = kind
    kinds[points] = probed
    for kind, letters in ((SHORT, "stmd"), (RV, "rv"), (L, "l"), (E, "e"), (APOSTROPHE, "'"), (SPACE, " ")):
        kinds[[ord(c) for c in letters]] = kind
    kinds[END_POINT] = END
    return kinds


def scanned(maps: np.ndarray) -> np.ndarray:
    """Row k becomes the composition of rows 0 to k of (chunk, state) maps."""
    far = 1
    while far < len(maps):
        maps = np.concatenate([maps[:far], np.take_along_axis(maps[far:], maps[:-far], axis=1)])
        far *= 2
    return maps


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Marks the first character of every word, and every end of a text, in a sequence of classes."""
    n = len(kinds)
    padded = np.full(-(-max(n, 1) // CHUNK) * CHUNK, END, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)  # one row per place in a chunk
    maps = np.tile(np.arange(0, STATES * CLASSES, CLASSES, dtype=np.uint8), (columns.shape[1], 1))
    for place in columns:
        maps = NEXT[maps + place[:, None]]
    ends = scanned((maps // CLASSES).astype(np.intp))
    state = np.full(columns.shape[1], START * CLASSES, np.uint8)
    state[1:] = ends[:-1, START] * CLASSES
    begins = np.empty_like(columns)
    for k, place in enumerate(columns):
        at = state + place
        begins[k] = BEGINS[at]
        state = NEXT[at]
    flat = begins.T.reshape(-1)
    marks = (flat & 1).astype(bool)
    marks[:-1] |= (flat[1:] & 2) > 0
    return marks[:n]
