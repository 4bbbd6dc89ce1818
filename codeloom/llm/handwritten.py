"""Files nobody wrote by hand: tool output, minified bundles, third-party copies, lock files, data literals.

Third-party copies are found by their content. Every file is fingerprinted by winnowing its normalized token stream
(white space dropped; identifiers, numbers and signs kept): hashes of all runs of ``gram`` tokens, of which the minimum
of every ``window`` neighbours is kept. A fingerprint counts as common when files of at least ``min_repos``
unrelated repositories hold it; a file is a copy if at least two of its fingerprints (or its only one), and the
share ``share`` of them, are common. Vendor folders and notices in the head comment only support this: with one of them, half of the
fingerprints in two repositories are enough. Files of fewer than ``FEW`` fingerprints share idioms by chance: without support they are
copies only if all their tokens after the head comment recur, as one more fingerprint, in ``min_repos`` repositories. Distinct repositories are counted exactly: distinct (fingerprint, repository) pairs first, then
pairs per fingerprint. Both steps are aggregated before their shuffle, so a fingerprint shared by a third of all files costs
no more rows than there are repositories.

The other kinds show in a file alone: a marker in its head comment, its name, its line lengths, its share of literals.

Defined cases
    * null and empty content is never a case; null paths and repositories are allowed (a null repository is one of its own).
    * Files with fewer than 16 tokens after the head comment are never copies.
    * The same file delivered again under another id is judged alike and adds nothing to the count of repositories.
    * Very long texts are read in blocks of about a million bytes; no part is skipped.
    * Backslashes in paths count as ``/``. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut, spread

GRAM, WINDOW, BLOCK = 32, 16, 1 << 20
#: Files of fewer fingerprints are judged as a whole, from so many tokens on.
FEW, SHORT = 16, 16

_U = np.uint64
_rng = np.random.default_rng(0xC0DE)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_POS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_C = [_U(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(8)]
_KIND = np.zeros(256, np.uint8)  # 0 blank, 1 sign, 2 word
_KIND[33:127] = 1
for _c in range(256):
    if chr(_c).isalnum() and _c < 128 or _c == 95 or _c >= 128:
        _KIND[_c] = 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def token_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start offset, 64-bit hash) of every token of a byte array."""
    kind = _KIND[raw]
    start = kind == 1
    word = kind == 2
    start[0] |= word[0]
    start[1:] |= word[1:] & ~word[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return at, np.empty(0, np.uint64)
    owner = np.cumsum(start) - 1
    used = kind > 0
    offset = np.arange(len(raw)) - at[np.maximum(owner, 0)]
    value = np.where(used, _BYTE[raw] * _POS[offset & 63] + (offset >> 6).astype(np.uint64), _U(0))
    value[: at[0]] = 0
    return at, _mix(np.add.reduceat(value, at))


def winnow(tokens: np.ndarray, owner: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(owner, fingerprint) pairs of the token streams laid end to end; both sizes are powers of two."""
    n = len(tokens) - gram + 1
    if n <= 0:
        return np.empty(0, owner.dtype), np.empty(0, np.uint64)
    g, width, i = tokens, 1, 0
    while width < gram:
        g = g[:-width] * _C[i] + g[width:]
        width, i = width * 2, i + 1
    g = _mix(g)
    whole = owner[:n] == owner[gram - 1 :]
    g, who = g[whole], owner[:n][whole]
    if not len(g):
        return who, g
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    size = np.diff(np.r_[first, len(who)])
    short = size < window
    out_o, out_f = [who[first[short]]], [np.minimum.reduceat(g, first)[short]]
    if len(g) >= window:
        m, width = g, 1
        while width < window:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        inside = who[: len(m)] == who[window - 1 :]
        m, w = m[inside], who[: len(inside)][inside]
        if len(m):
            new = np.r_[True, (m[1:] != m[:-1]) | (w[1:] != w[:-1])]
            out_o.append(w[new])
            out_f.append(m[new])
    return np.concatenate(out_o), np.concatenate(out_f)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Distinct fingerprints of each text."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    at = 0
    while at < len(texts):
        block, sizes, total = [], [], 0
        first = at
        while at < len(texts) and (total < BLOCK or not block):
            b = (texts[at] or "").encode("utf-8", "replace")
            block.append(b)
            sizes.append(len(b) + 1)
            total += len(b) + 1
            at += 1
        streams, lo = [], 0
        raw = b"\n".join(block) + b"\n"
        ends = np.cumsum(sizes)
        while lo < len(raw):  # only a single long text needs more than one step
            piece = raw[lo : lo + 4 * BLOCK]
            if lo + len(piece) < len(raw):
                blank = max(piece.rfind(b"\n"), piece.rfind(b" "))
                piece = piece[: blank + 1] if blank > 0 else piece
            s, h = token_hashes(np.frombuffer(piece, np.uint8))
            streams.append((s + lo, h))
            lo += len(piece)
        starts = np.concatenate([s for s, _ in streams])
        hashes = np.concatenate([h for _, h in streams])
        owner = np.searchsorted(ends, starts, "right").astype(np.int32)
        who, fp = winnow(hashes, owner)
        if len(who):
            order = np.lexsort((fp, who))
            who, fp = who[order], fp[order]
            new = np.r_[True, (fp[1:] != fp[:-1]) | (who[1:] != who[:-1])]
            who, fp = who[new], fp[new].view(np.int64)
            cuts = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                out[first + int(who[a])] = fp[a:b]
    return out


_COMMENT = re.compile(r"^\s*(?://+|#+|/\*+!?|\*+|--|;+|<!--|\"\"\"|'''|%)\s?(.*)$")
_MARKER = re.compile(
    r"(?i)@generated\b|<auto-?generated\b|code generated .{0,60}do not edit|auto-?generated (?:file|by|from|code|on\b)|automatically (?:generated|created)|(?:this (?:file|code)|file) (?:is|was|has been) (?:auto|automatically |machine[- ])?-?(?:generated|created|written|produced)\b"
    r"|^\W*(?:was )?generated (?:from|by|with|using|on|automatically)\b|do not (?:edit|modify|change)(?: this file)?(?: by hand| manually)|(?:edits?|changes?|modifications?) (?:is|are|will be|gets?) (?:overwritten|lost|discarded)|(?:machine|tool|computer|auto|robot)[- ]?(?:written|generated|created|made|produced) (?:file|code|source)|automatisch (?:erzeugt|generiert)|nicht von hand"
    r"|généré automatiquement|ne pas modifier|generado autom[aá]ticamente|no (?:editar|modificar)"
)
# What a notice of origin or licence at the head of a third-party file speaks of.
_NOTICE = re.compile(r"(?i)vendored|bundled copy|upstream|(?:copied|imported|adapted|taken|ported) (?:\w+ ){0,2}from|^[\w.@/-]+(?: -)? (?:version |v)?\d+\.\d+(?:\.\d+)?\b|permission is hereby granted|licen[sc]e|released under|copyright|\(c\)")
_VENDOR_DIR = re.compile(r"(?i)(?:^|/)(?:vendor|_vendor|vendored|third[_-]?party|3rdparty|node_modules|bower_components|site-packages|external|extern|deps|contrib/bundled|bundled|jspm_packages|Pods|Carthage)/")
_LOCK = re.compile(r"(?i)(?:^|/)(?:package-lock|npm-shrinkwrap|composer-lock|[\w.-]+\.lock)\.json$|(?:^|/)(?:yarn|cargo|poetry|gemfile|composer|pipfile|flake|mix|pubspec|uv|podfile|packages?|bun)\.lockb?$|(?:^|/)pnpm-lock\.ya?ml$|(?:^|/)go\.sum$|\.lock$")
_GEN_NAME = re.compile(r"(?i)(?:\.pb\.(?:go|cc|h|rb)|_pb2?(?:_grpc)?\.(?:pyi?|[jt]s|rb|d\.ts)|_grpc\.\w+|\.(?:generated|gen|g)\.\w+|(?:^|/)zz_generated[\w.]*|_generated\.\w+|(?:^|/)__generated__/.*|(?:^|/)generated/.*|(?:^|/)gen/.*)$")
_SERIES = re.compile(r"[A-Za-z]_?(0\d\d)\b")
_MIN_NAME = re.compile(r"(?i)[.-]min\.(?:js|css|mjs)$|(?:^|/)[\w-]+\.(?:bundle|chunk)\.js$")


_CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}


def _lines(text: str):
    """The lines of a text, one at a time."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


def head_comment(text: str) -> list[str]:
    """All comment lines at the very top of a file (before the first code), without comment signs."""
    out, close = [], ""
    for raw in _lines(text):
        line = raw.strip()
        if not line or line.startswith(("#!", "<?php", "package ", "'use strict'", '"use strict"')):
            continue
        m = _COMMENT.match(line)
        if not m and not close:
            break
        out.append((m.group(1) if m else line).strip().rstrip("*/").strip())
        rest = line
        if not close:
            opened = next((o for o in _CLOSE if line.startswith(o)), None)
            close, rest = (_CLOSE[opened], line[len(opened) :]) if opened else ("", line)
        if close and close in rest:
            close = ""
    return out


def body_start(text: str) -> int:
    """Where the first code begins, after the head comment."""
    at, close = 0, ""
    for raw in _lines(text):
        line = raw.strip()
        if line:
            if not close and not _COMMENT.match(line):
                return at
            rest = line
            if not close:
                opened = next((o for o in _CLOSE if line.startswith(o)), None)
                close, rest = (_CLOSE[opened], line[len(opened) :]) if opened else ("", line)
            if close and close in rest:
                close = ""
        at += len(raw) + 1
    return min(at, len(text))


def whole_print(text: str) -> int | None:
    """The one fingerprint of all tokens after the head comment, or None for a text of hardly any."""
    raw = text[body_start(text) :].encode("utf-8", "replace")
    h = token_hashes(np.frombuffer(raw + b"\n", np.uint8))[1]
    if len(h) < SHORT:
        return None
    at = np.arange(len(h), dtype=np.uint64) + _U(1)
    return int(_mix((h * (_mix(at) | _U(1))).sum(keepdims=True)).view(np.int64)[0])


def line_stats(text: str) -> tuple[float, float, float]:
    """(share of characters on lines over 300, mean length of non-blank lines, share of blanks)."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = sum(map(len, lines)) or 1
    blanks = sum(x.count(" ") + x.count("\t") for x in lines)
    return sum(len(x) for x in lines if len(x) > 300) / n, n / max(len(lines), 1), blanks / n


_STRING = re.compile(r"(?:\b[rRbBuUfF]{1,2})?(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')")
_NUMBERS = re.compile(r"[-+\d.,\s_xXa-fA-F]{100,}")
_LETTERS = re.compile(r"(?<!\w)(?!(?:true|false|null|None|True|False|nil)\b)[A-Za-z_$]")
_BASE64 = re.compile(r"\s*[A-Za-z0-9+/=]{40,}\s*\Z")


def data_share(text: str) -> float:
    """Share of the visible characters on lines of literals only, or in literals over 200 characters that are no prose."""
    total = inside = 0
    for line, rest in zip(text.split("\n"), _STRING.sub(lambda m: '"', text).split("\n")):
        n = len(line) - line.count(" ")
        total += n
        if n == 0:
            continue
        long_ = [x for x in map(re.Match.group, _STRING.finditer(line)) if len(x) > 200] if n > 200 else []
        prose = any(x.count(" ") >= 0.05 * len(x) for x in long_)
        if not prose and not _LETTERS.search(rest) and ('"' in rest or any(c.isdigit() for c in rest)) or _BASE64.match(line):
            inside += n
        else:
            inside += sum(len(x) for x in long_ if x.count(" ") < 0.05 * len(x))
            if n > 200:
                inside += sum(len(x) - x.count(" ") for x in _NUMBERS.findall(line) if x.count(",") > 20)
    return inside / total if total else 0.0


def numbered_bodies(text: str) -> bool:
    """Whether names numbered 001 to 008 follow each other, each with the same text but for its numbers."""
    at: dict[int, int] = {}
    for m in _SERIES.finditer(text):
        at.setdefault(int(m.group(1)), m.start())
    if not all(k in at for k in range(1, 9)):
        return False
    starts = [at[k] for k in range(1, 9)]
    return starts == sorted(starts) and len({re.sub(r"\d+", "0", text[a:b]) for a, b in zip(starts, starts[1:])}) == 1


def supported(path: str | None, text: str) -> bool:
    """Whether folder or head comment speak of a third party."""
    return _VENDOR_DIR.search((path or "").replace("\\", "/")) is not None or any(map(_NOTICE.search, head_comment(text)))


def kinds(path: str | None, text: str) -> str | None:
    """The kind of non-hand-written file that path and text alone show, or None."""
    p = (path or "").replace("\\", "/")
    if _LOCK.search(p):
        return "lock"
    head = head_comment(text)
    joined = " ".join(head)
    if any(_MARKER.search(h) for h in head) or _MARKER.search(joined):
        return "generated"
    if _GEN_NAME.search(p):
        return "generated"
    if "001" in text and numbered_bodies(text):
        return "generated"
    data = data_share(text)
    if data > 0.8 and not re.search(r"(?i)\.(?:md|txt|ya?ml|toml|env|ini|rst|json)$|(?:^|/)\.env$", p):
        return "data"
    if re.search(r"(?i)\.(?:[mc]?jsx?|tsx?|css)$", p) and data < 0.5:
        long_share, mean, blanks = line_stats(text)
        if _MIN_NAME.search(p) and mean > 120 or long_share > 0.6 and blanks < 0.12 and mean > 150:
            return "minified"
    return None


def classify(df: DataFrame, min_repos: int = 3, share: float = 0.75, id_col: str = "module_id", few_repos: int = 2, few_share: float = 0.5) -> DataFrame:
    """(id, kind) of every file that was not written by hand."""
    kind = dict(df.dtypes)[id_col]
    src = df.where(F.length("content") > 0).select(F.col(id_col).cast("string").alias("id"), F.col("repo").cast("string"), F.col("path").cast("string"), "content")

    def run(batches):
        for b in batches:
            texts, paths = b["content"].tolist(), b["path"].tolist()
            prints = fingerprints(texts)
            whole = pd.array([whole_print(t) if len(f) < FEW else None for f, t in zip(prints, texts)], dtype="Int64")
            yield pd.DataFrame({"id": b["id"], "repo": b["repo"], "kind": list(map(kinds, paths, texts)), "support": list(map(supported, paths, texts)), "fps": prints, "whole": whole})

    read = cut(spread(src).mapInPandas(run, "id string, repo string, kind string, support boolean, fps array<long>, whole long"))
    all_prints = F.concat("fps", F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.array().cast("array<bigint>")))
    grams = read.select("id", "kind", "repo", "whole", F.explode(all_prints).alias("fp"))
    spread_ = grams.select("fp", "repo").distinct().groupBy("fp").agg(F.count("*").alias("repos")).where(F.col("repos") >= min(min_repos, few_repos))
    part = ~F.col("fp").eqNullSafe(F.col("whole"))
    held = grams.where("kind is null").select("id", "fp", "whole").join(spread_, "fp").groupBy("id").agg(
        F.count_if(part & (F.col("repos") >= min_repos)).alias("common"), F.count_if(part & (F.col("repos") >= few_repos)).alias("some"), F.count_if(~part & (F.col("repos") >= min_repos)).alias("as_whole"))
    left = read.where("kind is null").select("id", "support", F.size("fps").alias("n"))
    many = (F.col("n") >= FEW) & (F.col("common") >= share * F.col("n"))
    copied = many | (F.col("as_whole") > 0) | F.col("support") & (F.col("some") > 0) & (F.col("some") >= few_share * F.col("n"))
    copies = left.join(held, "id").where(copied).select("id", F.lit("copied").alias("kind")).distinct()
    told = read.where("kind is not null").select("id", "kind").distinct()
    return told.unionByName(copies).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
