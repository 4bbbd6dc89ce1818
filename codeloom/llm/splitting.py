"""Cutting oversized texts into pieces under a size limit.

Sizes are tokens counted as characters divided by 4, rounded down. Every candidate cut has a strength (a plain blank,
a line end, a blank line, the start of a top-level definition ...). A sparse table of range maxima over the
strengths answers "the strongest cut between these two lengths" in two look-ups; equal strengths resolve to the
rightmost cut. The next piece starts ``overlap`` characters before the cut.

Defined cases
    * null, empty and small texts give no rows: they need no cutting.
    * The last piece ends at the end of the text; pieces cover the text without gaps; each is within the limit.
    * Where a window holds no natural boundary (no blanks, no line breaks) the cut is at the limit, but never
      between a carriage return and its line feed.
    * A very long text is processed in sections, so memory grows with the section and not with the text.
    * Repeated rows are cut each on their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTION = 1 << 17
_BLANKS = re.compile(r"[ \t]+|\n")
_TOP = re.compile(r"(?:def|class|async|func|fn|pub|function|export|impl|public|private|protected|module|type|struct|interface|const|let|var|@|#\[|/\*\*|//|#)")


class SparseTable:
    """Range maximum over integer keys; a key is strength * 2**32 + index, so ties resolve to the right."""

    def __init__(self, strength: np.ndarray, longest: int):
        n = len(strength)
        keys = (strength.astype(np.int64) << 32) | np.arange(n, dtype=np.int64)
        self.levels = [keys]
        width = 1
        while 2 * width <= min(n, longest):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """Index of the largest key in [lo, hi)."""
        level = (hi - lo).bit_length() - 1
        row = self.levels[level]
        return int(max(row[lo], row[hi - (1 << level)]) & 0xFFFFFFFF)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a cut is natural (text[:p] | text[p:]) and their strengths 1..6."""
    ends = [(m.end(), m.group() == "\n") for m in _BLANKS.finditer(text)]
    at = np.fromiter((p for p, _ in ends), np.int64, len(ends))
    how = np.ones(len(ends), np.int8)
    last_blank = False
    start = 0
    for i, (p, is_line) in enumerate(ends):
        if not is_line:
            continue
        blank = not text[start : p - 1].strip()
        nxt = text[p : p + 1]
        s = 2
        if nxt not in " \t)]}":
            s = 3  # back at the left margin
        if blank or last_blank:
            s = 4 if s == 2 else 5
        if s >= 3 and nxt not in " \t" and _TOP.match(text, p):
            s = 6 if blank or last_blank else max(s, 4)
        how[i] = s
        last_blank = blank
        start = p
    return at, how


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece: at most ``limit`` characters, ``overlap`` of them shared with the piece before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    n, shortest = len(text), max(limit // 2, overlap + 1)
    out, start, base, seen, at, table = [], 0, 0, 0, None, None
    while n - start > limit:
        if at is None or start + limit > seen:
            base, seen = start, min(n, start + max(SECTION, 2 * limit))
            at, how = boundaries(text[base:seen])
            at = at + base
            table = SparseTable(how, limit + 1) if len(at) else None
        lo, hi = np.searchsorted(at, [start + shortest, start + limit + 1])
        if lo < hi:
            cut = int(at[table.argmax(int(lo), int(hi))])
        else:
            cut = start + limit
            if text[cut - 1] == "\r" and text[cut : cut + 1] == "\n" and cut - 1 > start + overlap:
                cut -= 1
        out.append((start, cut))
        start = cut - overlap
    out.append((start, n))
    return out


def split_oversized(df: DataFrame, max_tokens: int, overlap_tokens: int, id_col: str = "module_id", text_col: str = "content") -> DataFrame:
    """Pieces (id, piece_no, start_char, end_char, tokens, piece) of every text larger than ``max_tokens``."""
    limit, overlap = 4 * int(max_tokens), 4 * int(overlap_tokens or 0)
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    big = df.where(F.floor(F.length(text_col) / 4) > int(max_tokens)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))

    def cut(batches):
        for b in batches:
            for i, t in zip(b["id"], b["t"]):
                p = cut_points(t, limit, overlap)
                yield pd.DataFrame(
                    {"id": [i] * len(p), "piece_no": range(len(p)), "start_char": [s for s, _ in p], "end_char": [e for _, e in p],
                     "tokens": [(e - s) // 4 for s, e in p], "piece": [t[s:e] for s, e in p]}
                )

    kind = dict(df.dtypes)[id_col]
    return big.mapInPandas(cut, "id string, piece_no int, start_char long, end_char long, tokens int, piece string").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
