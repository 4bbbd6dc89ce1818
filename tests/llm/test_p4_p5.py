import collections
import random

import numpy as np
import pytest

from codeloom.llm import packing as K
from codeloom.llm import splitting as P
from tests.conftest import rows


def check_cover(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e), (s2, _) in zip(pieces, pieces[1:]):
        assert e - s <= limit and s2 == e - overlap
    assert all(e - s <= limit for s, e in pieces)
    assert "".join(text[s + (overlap if i else 0) : e] for i, (s, e) in enumerate(pieces)) == text


def test_round_trip_on_many_texts():
    r = random.Random(4)
    for n in range(40):
        words = ["def f():", "    x = 1", "", "class A:", "y " * r.randrange(30), "z" * r.randrange(400)]
        text = "\n".join(r.choice(words) for _ in range(r.randrange(1, 400)))
        limit = r.randrange(50, 900)
        check_cover(text, P.cut_points(text, limit, o := r.randrange(0, limit // 3)), limit, o)
    for text in ("x" * 5000, "a b" * 3000, "\r\n" * 3000, "\n" * 4000, "é" * 3001):
        check_cover(text, P.cut_points(text, 600, 48), 600, 48)


def test_sections_do_not_show(monkeypatch):
    text = "\n\n".join(f"def f{i}():\n    return {i}\n" for i in range(3000))
    whole = P.cut_points(text, 600, 48)
    monkeypatch.setattr(P, "SECTION", 1500)
    assert P.cut_points(text, 600, 48) == whole


def test_cut_is_the_strongest_and_rightmost():
    text = "a = 1\n" * 60 + "\ndef g():\n" + "    b = 2\n" * 60
    s, e = P.cut_points(text, 500, 0)[0]
    assert text[e:].startswith("def g")
    at, how = P.boundaries(text)
    t = P.SparseTable(how, 400)
    r = np.random.default_rng(1)
    for _ in range(200):
        lo = int(r.integers(0, len(at) - 2))
        hi = int(r.integers(lo + 1, min(len(at), lo + 300) + 1))
        best = max(range(lo, hi), key=lambda i: (how[i], i))
        assert t.argmax(lo, hi) == best


def test_split_operator(spark):
    big = "line\n" * 2000
    df = spark.createDataFrame([(1, big, 9), (2, "x" * 6003, 9), (3, "x" * 6004, 9), (4, None, 9), (5, "", 9), (1, big, 9)], "module_id long, content string, piece_no int")
    got = P.split_oversized(df, 1500, 120)
    assert {r[0] for r in rows(got, "module_id")} == {1, 3}
    assert got.where("tokens > 1500").count() == 0
    assert rows(got.where("module_id = 3"), "start_char", "end_char") == [(0, 6000), (5520, 6004)]
    assert P.split_oversized(df.where("false"), 1500, 120).count() == 0
    with pytest.raises(ValueError):
        P.split_oversized(df, 10, 10)


def best_sum(sizes, room):
    reach = {0}
    for s in sizes:
        reach |= {x + s for x in reach if x + s <= room}
    return max(reach)


def test_fullest_is_optimal():
    r = random.Random(2)
    for _ in range(200):
        room = r.randrange(1, 60)
        counts = collections.Counter(r.randrange(1, 25) for _ in range(r.randrange(0, 9)))
        use = K.fullest(sorted(counts, reverse=True), counts, room)
        assert all(use[s] <= counts[s] for s in use) and sum(s * k for s, k in use.items()) == best_sum(counts.elements(), room)


def test_histogram_is_used_up_exactly():
    r = random.Random(3)
    hist = collections.Counter(r.randrange(1, 101) for _ in range(5000))
    bins = K.pack_histogram(dict(hist), 100)
    used = collections.Counter()
    for use, times in bins:
        assert sum(s * k for s, k in use.items()) <= 100
        for s, k in use.items():
            used[s] += k * times
    assert used == hist
    assert sum(s * c for s, c in hist.items()) / (100 * sum(t for _, t in bins)) > 0.99


def test_pack_operator(spark):
    r = random.Random(6)
    data = [(i, f"p{i}", "x" * (4 * r.choice([7, 7, 7, 30, 55, 99, 100]) + r.randrange(4)), 1) for i in range(600)]
    data += [(1000, None, "x" * 1030, 1), (1001, "n", None, 1), (1002, "e", "", 1), (1002, "e", "", 1), (None, "q", "x" * 40, 1), (2**60 + 1, "h", "x" * 40, 1)]
    df = spark.createDataFrame(data, "module_id long, path string, content string, bin_id int")
    got = K.pack(df, 100).collect()
    per = collections.Counter()
    for g in got:
        per[g["bin_id"]] += g["tokens"]
    assert max(per.values()) <= 100 and sum(per.values()) == sum(len(c or "") // 4 for _, _, c, _ in data)
    parts = sorted((g["part_no"], g["tokens"]) for g in got if g["module_id"] == 1000)
    assert parts == [(0, 100), (1, 100), (2, 57)]
    assert collections.Counter(g["module_id"] for g in got if g["module_id"] != 1000) == collections.Counter(i for i, *_ in data if i != 1000)
    assert K.fill_report(K.pack(df, 100), 100).first()["fill"] > 0.97
    assert K.pack(df.where("false"), 100).count() == 0
