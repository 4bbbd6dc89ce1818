"""Evaluation passages inside training texts: CGK embedding, bit-sampling LSH, exact verification.

Both sides are cut into windows of ``window`` words. The CGK random walk maps each window to a longer string such that a small
edit distance becomes a small Hamming distance: at step j the walk writes the word under its pointer and moves on if a
random bit of (j, word) says so. Each of several tables of several independent walks hashes a random sample of positions of that string;
windows that share a table's hash are candidates, which are verified by their exact edit distance: the document's passage may be shorter or
longer than the item's by the edits allowed. Windows without an edit agree in every table, so for verbatim passages the recall is 1; for
replaced, inserted and dropped words the number of tables sets it (measured in tests, 0.9 or more for each).

Equal windows of the items are one class: they are searched for and verified once and told apart only where they match. The item side is
indexed by the workers, once per worker, in blocks of bounded size; one block at a time passes through the driver, and documents stream
past each block without a shuffle. A passage with more than ``max_edits`` words that occur in no item cannot be within reach and is skipped.

Defined cases
    * Words are runs of ASCII letters and digits in lower case. Markup (tags, entities, emphasis), escaped line
      breaks, invisible characters and line prefixes are dropped; a word hyphenated at a line end is joined.
    * null and empty texts, and items of fewer than ``window`` words, give no rows.
    * A passage is a maximal run; it counts for an item unless another item holds that whole run as well.
    * Repeated documents are reported under each of their ids. Result rows are distinct. Empty tables give empty results.
    * An item longer than a block is a block of its own.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import spread

WINDOW = 12
#: Most item windows held in memory at once; more items are handled in several blocks.
BLOCK_WINDOWS = 1_000_000
_U = np.uint64

_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFE0E, 0xFE0F, 0xFEFF])
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--|-->|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,6});")
_ESCAPE = re.compile(r"\\[nrt]|\\u00a0|\\(?=[\"'/\\])")
_LINK = re.compile(r"\]\((?:https?:|/|#)[^)\s]*\)")
_PREFIX = re.compile(r"(?m)^[ \t]*(?:(?:>|\*(?!\*)|//+|/\*+|#+|--+|-|;+|%+|\|+|\+|•|\"\"\"|\d{1,4}[:|)](?!\d)|\d{1,4}\t)[ \t]*)+")
_HYPHEN = re.compile(r"(?<=[A-Za-z])[-‐‑][ \t]*\r?\n[ \t]*(?=[A-Za-z])")
_EMPHASIS = re.compile(r"[`*~]+|(?<![A-Za-z0-9])_+|_+(?![A-Za-z0-9])")
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = text.translate(_INVISIBLE)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(" ", text)
    if "\n" in text:
        text = _HYPHEN.sub("", _PREFIX.sub("", text))
    return _WORD.findall(_EMPHASIS.sub("", text).lower())


class Walk:
    """CGK embeddings of windows of word ids and their sampled hashes.

    A single walk may lose step with an edited twin early on; ``repeats`` independent walks with ``tables`` samples each make that rare.
    """

    def __init__(self, window: int, tables: int, sample: int, seed: int, repeats: int = 1):
        rng = np.random.default_rng(seed)
        self.window, self.steps, self.tables = window, 3 * window, tables
        self.runs = []
        for _ in range(repeats):
            salt = rng.integers(1, 1 << 63, self.steps, dtype=np.uint64) | _U(1)
            weight = np.zeros((tables, self.steps), np.uint64)
            for t in range(tables):
                at = rng.choice(self.steps, min(sample, self.steps), replace=False)
                weight[t, at] = rng.integers(1, 1 << 63, len(at), dtype=np.uint64) | _U(1)
            self.runs.append((salt, weight))

    def hashes(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray | None = None) -> np.ndarray:
        """(repeats * tables, windows) hash of the window of ``ids`` at each start, up to its stop where given."""
        out = np.zeros((len(self.runs) * self.tables, len(starts)), np.uint64)
        value = (ids.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
        value ^= value >> _U(29)
        value = np.concatenate([value, np.zeros(self.window + 1, np.uint64)])
        stop = starts + self.window if stops is None else np.minimum(starts + self.window, stops)
        for k, (salt, weight) in enumerate(self.runs):
            at = starts.astype(np.int64).copy()
            for j in range(self.steps):
                sym = np.where(at < stop, value[at], _U(0x5851F42D4C957F2D))
                for t in np.flatnonzero(weight[:, j]):
                    out[k * self.tables + t] += sym * weight[t, j] ^ (sym >> _U(17))
                at += ((sym * salt[j]) >> _U(61) & _U(1)).astype(np.int64)
                np.minimum(at, stop, out=at)
        return out


class ItemBlock:
    """Index of one block of items: word ids, the classes of equal windows, and a sorted hash list per table."""

    def __init__(self, items: list[tuple], walk: Walk):
        self.vocab: dict[str, int] = {}
        self.item_ids = [i for i, _ in items]
        ids, starts, owner = [], [], []
        for k, (_, text) in enumerate(items):
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)]
            starts += range(len(ids), len(ids) + len(w) - walk.window + 1)
            owner += [k] * max(0, len(w) - walk.window + 1)
            ids += w
        self.ids = np.array(ids, np.int64)
        starts, owner = np.array(starts, np.int64), np.array(owner, np.int64)
        self.walk, self.keys, self.order = walk, [], []
        if not len(starts):
            self.starts = starts
            return
        grid = self.ids[starts[:, None] + np.arange(walk.window)]
        _, first, klass, count = np.unique(grid, axis=0, return_index=True, return_inverse=True, return_counts=True)
        self.starts = starts[first]  # of one window per class
        by_class = np.argsort(klass.ravel(), kind="stable")
        self.at, self.owner = starts[by_class], owner[by_class]  # all windows, class by class
        self.bounds = np.r_[0, np.cumsum(count)]
        for h in walk.hashes(self.ids, self.starts):
            o = np.argsort(h, kind="stable")
            self.order.append(o)
            self.keys.append(h[o])

    def candidates(self, doc: np.ndarray, at: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document start, window class) pairs that share a hash in some table."""
        pairs = []
        for h, keys, order in zip(self.walk.hashes(doc, at, stops), self.keys, self.order):
            lo = np.searchsorted(keys, h, "left")
            some = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == h)
            if len(some):
                n = np.searchsorted(keys, h[some], "right") - lo[some]
                d = np.repeat(some, n)
                k = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n)
                pairs.append(d * len(self.starts) + order[k])
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p = np.unique(np.concatenate(pairs))
        return at[p // len(self.starts)], p % len(self.starts)

    def members(self, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``klass``, position in the class lists) of every window of these classes."""
        n = self.bounds[klass + 1] - self.bounds[klass]
        which = np.repeat(np.arange(len(klass)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[klass], n)


def window_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word windows, or ``most`` + 1 if it is larger."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def passage_edits(doc: np.ndarray, p: np.ndarray, ends: np.ndarray, item: np.ndarray, q: np.ndarray, w: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, words) of the best passage at each document start ``p`` against the item's window at ``q``: words up to ``ends``, edits up to most + 1."""
    span = np.arange(w + 1)
    room = ends - p
    left = np.where(span < room[:, None], doc[np.minimum(p[:, None] + span, len(doc) - 1)], -1)
    right = item[q[:, None] + span[:w]]
    same = left[:, :w] == right
    edits, length = np.full(len(p), most + 1), np.full(len(p), w)
    exact = same.all(axis=1)
    edits[exact] = 0
    if most == 0 or exact.all():
        return edits, length
    prefix = np.logical_and.accumulate(same, axis=1).sum(axis=1)  # words before the first difference

    def rest(eq: np.ndarray) -> np.ndarray:
        """From which column on all are equal."""
        return eq.shape[1] - np.logical_and.accumulate(eq[:, ::-1], axis=1).sum(axis=1)

    longer = rest(left[:, 1:] == right) <= prefix  # the passage holds one word more
    shorter = rest(left[:, : w - 1] == right[:, 1:]) <= prefix  # or one less
    replaced = rest(same) <= prefix + 1
    for ok, n in ((shorter, w - 1), (longer, w + 1), (replaced, w)):
        k = ok & ~exact & (room >= n)
        edits[k], length[k] = 1, n
    if most > 1:
        for k in np.flatnonzero(edits > 1):
            for n in range(w - most, min(w + most, int(room[k])) + 1):
                e = window_edits(doc[p[k] : p[k] + n], right[k], min(most, edits[k] - 1)) if n > 0 else most + 1
                if e < edits[k]:
                    edits[k], length[k] = e, n
    return edits, length


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int):
    """The items in blocks of at most ``limit`` words each (or one longer item), of which one at a time is here."""
    listed = items.where((F.length(text_col) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sized = listed.withColumn("n", F.length("t") - F.length(F.replace("t", F.lit(" "))) + 1)
    total, count = sized.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n = max(1, -(-total // limit))
    while count and n < count:
        block = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n))
        fullest = sized.groupBy(block.alias("b")).agg(F.sum("n").alias("words"), F.count("*").alias("items")).where("items > 1").agg(F.max("words")).first()[0]
        if fullest is None or fullest <= limit:
            break
        n *= 2
    for k in range(n if count else 0):
        block = [(r[0], r[1]) for r in listed.where(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)) == k).orderBy("id", "t").collect()]
        if block:
            yield block


def _slices(texts: list[str], chars: int = 4_000_000):
    """(from, to) of runs of texts of about ``chars`` characters, to bound what is worked on at once."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_INDEXES: dict[str, ItemBlock] = {}  # of this worker, the last few blocks


def _index(key: str, shared, walk: Walk) -> ItemBlock:
    if key not in _INDEXES:
        while len(_INDEXES) > 1:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[key] = ItemBlock(shared.value, walk)
    return _INDEXES[key]


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_edits: int = 0, tables: int | None = None, sample: int | None = None, repeats: int | None = None, seed: int = 7,
                  doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS, only_exact: bool = False) -> DataFrame:
    """(doc, item, start_word, end_word, edits, windows): verified passages; runs of verbatim windows come out as one row, others window by window.

    ``only_exact`` searches within ``max_edits`` and keeps of the verified passages the verbatim ones.
    """
    walk = Walk(window, tables or (2 if max_edits == 0 else 3), sample or window, seed, repeats or (1 if max_edits == 0 else 10 * max_edits))
    src = spread(docs.where(F.length(doc_text) > 0).select(F.col(doc_id).cast("string").alias("d"), F.col(doc_text).alias("t")))
    schema = f"d string, i {dict(items.dtypes)[item_id]}, start_word long, end_word long, edits int, windows long"
    out, name = None, uuid.uuid4().hex
    for no, block in enumerate(_blocks(items, item_id, item_text, block_windows)):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_windows words

        def run(batches, shared=shared, key=f"{name}/{no}"):
            index = _index(key, shared, walk)
            for b in batches:
                rows, docs_, texts = [], b["d"].tolist(), b["t"].tolist()
                for lo, hi in _slices(texts):
                    rows += [(docs_[lo + k], *r) for k, *r in match_documents(texts[lo:hi], index, max_edits, only_exact)]
                yield pd.DataFrame(rows, columns=["d", "i", "start_word", "end_word", "edits", "windows"])

        part = src.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("d", F.col("d").cast(dict(docs.dtypes)[doc_id])).withColumnsRenamed({"d": doc_id, "i": item_id})


def match_documents(texts: list[str], index: ItemBlock, max_edits: int, only_exact: bool = False) -> list[tuple]:
    """(document position, item, start_word, end_word, edits, windows) of documents against one block of items.

    The documents' words are laid end to end, so that each step works on many documents at once.
    """
    w, get = index.walk.window, index.vocab.get
    parts, sizes = [], []
    for t in texts:
        x = [get(v, 0) for v in words(t)]
        parts.append(np.array(x, np.int64))
        sizes.append(len(x))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    least = max(1, w - max_edits)
    if len(ids) < least or not len(index.starts):
        return []
    sizes = np.array(sizes)
    ends = np.cumsum(sizes)
    owner_doc = np.repeat(np.arange(len(sizes)), sizes)
    stop = ends[owner_doc]  # of each word's document
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    n = len(ids) - least + 1
    at = np.flatnonzero((unknown[least:] - unknown[:-least] <= max_edits) & (np.arange(n) + least <= stop[:n]))
    if not len(at):
        return []
    p, c = index.candidates(ids, at, stop[at])
    if not len(p):
        return []
    edits, length = passage_edits(ids, p, stop[p], index.ids, index.starts[c], w, max_edits)
    ok = edits <= (0 if only_exact else max_edits)
    which, k = index.members(c[ok])
    p, edits, length = p[ok][which], edits[ok][which], length[ok][which]
    owner, q = index.owner[k], index.at[k]
    rows = []

    def put(p, owner, end, edits, windows):
        doc = owner_doc[p]
        base = (ends - sizes)[doc]
        rows.extend(zip(doc.tolist(), [index.item_ids[o] for o in owner], (p - base).tolist(), (end - base).tolist(), edits.tolist(), windows.tolist()))

    near = edits > 0
    if near.any():
        put(p[near], owner[near], p[near] + length[near], edits[near], np.ones(near.sum(), np.int64))
    p, owner, q, edits = p[~near], owner[~near], q[~near], edits[~near]
    if len(p):  # runs of windows on one diagonal are one passage
        diagonal = q - p
        order = np.lexsort((p, diagonal, owner))
        p, diagonal, owner = p[order], diagonal[order], owner[order]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (p[1:] != p[:-1] + 1)]
        first = np.flatnonzero(new)
        last = p[np.r_[first[1:] - 1, len(p) - 1]]
        put(p[first], owner[first], last + w, edits[first], last - p[first] + 1)
    return rows


def leaks(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Distinct (doc, item) where the document holds a run of the item that no other item holds whole."""
    d, i = kw.get("doc_id", "doc_id"), kw.get("item_id", "item_id")
    runs = find_passages(docs, items, **{"max_edits": 1, **kw}, only_exact=True)
    spans = runs.groupBy(d, "start_word", "end_word").agg(F.min(i).alias("lo"), F.max(i).alias("hi"))
    # Sorted by start, longest first, an earlier span that ends no sooner covers a later one.
    before = Window.partitionBy(d).orderBy("start_word", F.col("end_word").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("covered", F.max("end_word").over(before) >= F.col("end_word"))
        .where((F.col("lo") == F.col("hi")) & ~F.coalesce("covered", F.lit(False)))
        .select(d, F.col("lo").alias(i)).distinct()
    )


def near_leaks(docs: DataFrame, items: DataFrame, max_edits: int = 1, **kw) -> DataFrame:
    """(doc, item, edits, windows): how near a document comes to each item; passages that fit several items come out once, with a null item."""
    d, i = kw.get("doc_id", "doc_id"), kw.get("item_id", "item_id")
    spans = find_passages(docs, items, max_edits=max_edits, **kw).groupBy(d, "start_word", "end_word").agg(F.min(i).alias("lo"), F.max(i).alias("hi"), F.min("edits").alias("edits"), F.max("windows").alias("windows"))
    return spans.groupBy(d, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(i)).agg(F.min("edits").alias("edits"), F.sum("windows").alias("windows"))


def leak_report(found: DataFrame, items: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """(suite, items, leaked_items, documents) per suite."""
    per = found.groupBy(item_id).agg(F.count(doc_id).alias("documents"))
    return items.select(item_id, "suite").join(per, item_id, "left").groupBy("suite").agg(
        F.count("*").alias("items"), F.count("documents").alias("leaked_items"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
