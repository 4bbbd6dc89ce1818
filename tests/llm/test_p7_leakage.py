import collections
import random

import numpy as np
import pytest

from codeloom.llm import leakage as L
from tests.conftest import rows

VOCAB = [f"w{i}" for i in range(60)]


def make(r, n):
    return [r.choice(VOCAB) for _ in range(n)]


def brute(docs, items, w=12):
    """(doc, item) where a maximal run of at least w words of the item is in no other item."""
    iw = {i: L.words(t) for i, t in items}
    text = {i: " " + " ".join(x) + " " for i, x in iw.items()}
    out = set()
    for d, t in docs:
        dw = L.words(t)
        for i, x in iw.items():
            at = collections.defaultdict(list)
            for k in range(len(x) - w + 1):
                at[tuple(x[k : k + w])].append(k)
            for p in range(len(dw) - w + 1):
                for k in at.get(tuple(dw[p : p + w]), ()):
                    n = w
                    while p + n < len(dw) and k + n < len(x) and dw[p + n] == x[k + n]:
                        n += 1
                    run = " " + " ".join(x[k : k + n]) + " "
                    if not any(j != i and run in o for j, o in text.items()):
                        out.add((d, i))
    return sorted(out)


def corpus(seed=1):
    r = random.Random(seed)
    shared = make(r, 18)
    items = [(i, " ".join(make(r, 40) + shared + make(r, 20))) for i in range(12)] + [(99, "too short")]
    docs = []
    for d in range(60):
        body = make(r, 30)
        kind = d % 6
        it = items[d % 12][1].split()
        s = r.randrange(0, 20)
        part = {0: it[s : s + 14], 1: it[s : s + 11], 2: shared, 3: it[30:70], 4: [], 5: it[s : s + 12]}[kind]
        docs.append((d, " ".join(body + part + make(r, 10))))
    return docs, items


def test_found_equals_brute_force(spark):
    docs, items = corpus()
    docs += [(100, None), (101, ""), (0, docs[0][1]), (2**60 + 1, items[3][1]), (None, "x")]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, "s") for x in items] + [(50, None, "s"), (51, "", "s")], "item_id long, text string, suite string")
    want = brute([x for x in docs if x[0] is not None], items)
    assert sorted(rows(L.leaks(d, i))) == want and len(want) > 20
    assert sorted(rows(L.leaks(d, i, block_windows=80))) == want  # several blocks of items
    assert rows(L.leaks(d.where("false"), i)) == [] and rows(L.leaks(d, i.where("false"))) == []
    rep = L.leak_report(L.leaks(d, i), i).first()
    assert rep["items"] == 15 and rep["leaked_items"] == len({b for _, b in want})


@pytest.mark.parametrize("text", [
    "One <b>two</b> **three** `four` fi​ve, six!", "> One two\n> three four\n> five six", "// one two three\n// four five six", "ONE TWO THREE\xa0FOUR FIVE SIX", "one two thr-\nee four five six", "# one two th-\n# ree four\n# five six", "{\"a\": 1}"[:0] + "one\\ntwo three four\\nfive six", "  * one_two three.four five/six", "12: one two\n13: three four\n14: five six", "one&nbsp;two three four five six"])
def test_normal_form(text):
    assert L.words(text) == ["one", "two", "three", "four", "five", "six"]


def test_walk_is_equal_for_equal_windows_and_bounded():
    r = np.random.default_rng(0)
    ids = r.integers(1, 50, 500)
    w = L.Walk(12, 3, 12, 5)
    h = w.hashes(np.concatenate([ids, ids]), np.array([7, 507, 488]))
    assert (h[:, 0] == h[:, 1]).all() and not (h[:, 0] == h[:, 2]).any()


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_recall_of_edited_passages(spark, kind):
    """One edit in a passage of only a window: recall against the exact distance, wherever the passage stands in its document."""
    r = random.Random(9)
    items = [(i, " ".join(make(r, 12))) for i in range(400)]
    docs = []
    for i, t in items:
        w = t.split()
        k = r.randrange(1, 11)
        w[k : k + (kind != "insert")] = [] if kind == "delete" else [r.choice(VOCAB)]
        docs.append((i, " ".join(make(r, i % 3) + w + make(r, i % 2))))
    got = L.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_edits=1).toPandas()
    hit = got[got.doc_id == got.item_id]
    assert hit.doc_id.nunique() / len(items) >= 0.9
    text, item = dict(docs), dict(items)
    for x in got.itertuples():  # every reported passage is as near as it says
        a = np.array(L.words(text[x.doc_id])[x.start_word : x.end_word])
        assert L.window_edits(a, np.array(L.words(item[x.item_id])), 3) == x.edits <= 1


def test_two_edits_and_passage_lengths():
    r = np.random.default_rng(3)
    item = r.integers(1, 40, 12)
    for _ in range(300):
        d = list(item)
        for _ in range(r.integers(0, 4)):
            k = r.integers(0, len(d))
            d[k : k + r.integers(0, 2)] = [] if r.random() < 0.4 else [int(r.integers(1, 40))]
        doc = np.array([*d, *r.integers(1, 40, 3)])
        for most in (0, 1, 2):
            e, n = L.passage_edits(doc, np.array([0]), np.array([len(doc)]), item, np.array([0]), 12, most)
            best = min(L.window_edits(doc[:m], item, 9) for m in range(12 - most, min(12 + most, len(doc)) + 1))
            assert e[0] == min(best, most + 1) and (e[0] > most or L.window_edits(doc[: n[0]], item, 9) == e[0])


def test_equal_windows_of_items_are_one_class():
    shared = " ".join(f"s{i}" for i in range(20))
    items = [(i, f"{shared} own{i} " + " ".join(f"x{i}y{k}" for k in range(15))) for i in range(50)]
    b = L.ItemBlock(items, L.Walk(12, 3, 12, 7, 2))
    assert len(b.starts) == 9 + 50 * (36 - 11 - 9) and b.bounds[-1] == 50 * 25
    assert sorted(set(m[1] for m in L.match_documents([shared], b, 1))) == list(range(50))


def test_near_leaks_name_one_item_or_none(spark):
    r = random.Random(4)
    common = make(r, 14)
    items = [(i, " ".join(make(r, 15) + common + make(r, 5))) for i in range(6)]
    own = items[2][1].split()[:13]
    docs = [(1, " ".join(common)), (2, " ".join(own[:6] + ["zz"] + own[6:])), (3, "nothing " * 20), (4, None)]
    got = rows(L.near_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "edits")
    assert (1, None, 0) in got and (2, 2, 1) in got and {g[0] for g in got} == {1, 2}


def test_window_edits():
    a = np.array([1, 2, 3, 4])
    assert L.window_edits(a, a, 2) == 0 and L.window_edits(a, np.array([1, 3, 4, 5]), 2) == 2 and L.window_edits(a, np.array([9, 8, 7, 6]), 1) == 2
