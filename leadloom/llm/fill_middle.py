"""Fill-in-the-middle: a text is cut in three at unit boundaries and written with its middle last.

Units are runs of ASCII letters and single other characters. Their ends make a ``BoundarySet``; two draws from a hash of
the id say after how many units to cut, and two selects give the cuts as character offsets.

Forms: ``psm`` is prefix, suffix, middle, each after its mark; ``spm`` is suffix, prefix, middle; ``plain`` is the text as it
is, for empty texts, texts that hold a mark, and a drawn share. ``restore`` gives the text back from output and form.

Null texts count as empty. A null id is hashed as no digits at all, so all rows without an id draw alike. Rows that repeat
an id draw alike, whatever their texts; each keeps its row. Very long texts are cut anywhere, not only near their start.
An empty table gives an empty result. The result has the kept columns and the new ones; a kept column of a new one's
name, in any letter case, is an error, so other ``names`` must be given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.boundary_set import BoundarySet
from leadloom.llm.common import map_batches, text_groups, unused_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of a hundred draws: left plain, and of the others suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
SEED = 1
DRAWS = 4
RESULTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def unit_ends(text: str) -> np.ndarray:
    """Offsets, in code points, of the last character of every unit."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((points | 32) - 97) < 26
    last = np.ones(len(points), bool)
    last[:-1] = ~(letter[:-1] & letter[1:])
    return np.flatnonzero(last)


def cut(ends: BoundarySet, units: int) -> int:
    """Characters of the first ``units`` units."""
    return ends.select(units - 1) + 1 if units else 0


def transform(text: str, draws: Sequence[int]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, characters of prefix and middle (none if plain), output."""
    ends = BoundarySet(unit_ends(text))
    n = len(ends)
    if not text or draws[2] % 100 >= 100 - PLAIN_PERCENT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = (cut(ends, u) for u in sorted(d % (n + 1) for d in draws[:2]))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if draws[3] % 100 < SUFFIX_FIRST_PERCENT:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text from its output. Marks are found by their first place: no part holds one, and none can begin within
    a part and end in a mark, since a mark has its opening bracket only at its start."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    head, _, rest = output[len(PREFIX):].partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


def draws_of(id_col: Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight hexadecimal digits of a hash of seed and id, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(DRAWS)]


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",), seed: int = SEED,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """The kept columns of every row with units, form, cuts and output; ``names`` renames these."""
    results = {(names or {}).get(c, c): t for c, t in RESULTS.items()}
    if clash := {c.lower() for c in keep} & {c.lower() for c in results}:
        raise ValueError(f"name the results otherwise than {sorted(clash)}")
    types = dict(df.dtypes)
    drawn = unused_name(df, "_draws")
    rows = df.select(
        *[F.col(f"`{c}`") for c in keep], F.array(*draws_of(F.col(f"`{id_col}`"), seed)).alias(drawn),
        F.col(f"`{text_col}`").alias(unused_name(df, "_text")),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        draws = batch.column(len(keep)).flatten().to_numpy().reshape(-1, DRAWS).tolist()
        made = []
        for start, texts in text_groups(batch.column(len(keep) + 1)):
            group = [transform(t, d) for t, d in zip(texts, draws[start:start + len(texts)])]
            made.append(pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string() if t == "string" else pa.int64()) for x, t in zip(zip(*group), results.values())],
                names=list(results),
            ))
        whole = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *whole.columns], names=[*keep, *results])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{c}` {t}" for c, t in results.items())])
    return map_batches(rows, run, schema)


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form") -> Column:
    """The text from output and form, as an expression: the same rule as ``restore``."""
    out, form = F.col(output_col), F.col(form_col)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    body = F.substr(out, F.lit(len(PREFIX) + 1))
    at = F.position(second, body)
    head, rest = F.left(body, at - 1), F.substr(body, at + len(SUFFIX))
    mid = F.position(F.lit(MIDDLE), rest)
    tail, middle = F.left(rest, mid - 1), F.substr(rest, mid + len(MIDDLE))
    return F.when(form == "plain", out).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))
