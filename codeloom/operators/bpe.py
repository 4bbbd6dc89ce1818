"""Token counts by a public tokenizer's vocabulary file (a parameter; the file is never copied here).

Texts are encoded in slices that end only where the split pattern itself must break, so a count never depends on the slices: before
white space after a visible character, after the last letter of a run of letters, after the last digit of a run of digits.

Defined cases: null and empty texts have 0 tokens; special tokens have no meaning; a single run of letters longer than a slice is one slice.
"""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 1 << 20


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _breaks():
    import regex

    return regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


def slices(text: str, size: int = SLICE):
    """Slices of at least ``size`` characters (but the last), cut at the first place from there on where every tokenization breaks."""
    at = 0
    while len(text) - at > size:
        m = _breaks().search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_count(text: str | None, path: str, size: int = SLICE) -> int:
    return sum(len(encoding(path).encode_ordinary(s)) for s in slices(text, size)) if text else 0


def _here(path: str) -> str:
    """The vocabulary on this worker: at its path, or as a file shipped with the session."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def count_tokens(df: DataFrame, vocab: str | None = None, text: str = "text") -> DataFrame:
    """Replace the text column by tokens; other columns stay. The vocabulary file is shipped to the workers."""
    path = vocab or DEFAULT_VOCAB
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        local = _here(path)
        for b in batches:
            yield pd.DataFrame({**{f.name: b[f.name] for f in keep}, "tokens": [token_count(t, local) for t in b[text]]})

    return df.mapInPandas(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["tokens long"]))
