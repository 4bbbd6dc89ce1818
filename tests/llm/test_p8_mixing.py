import random

import pytest

from codeloom.llm import mixing as M
from tests.conftest import rows

TARGETS = "source string, target_share double, max_repeats int"


def test_duel_keeps_mass_and_probabilities():
    r = random.Random(1)
    size = [r.randrange(1, 50) for _ in range(200)]
    p = [r.random() for _ in size]
    seen = [0.0] * len(p)
    for t in range(400):
        q = M.duel(p, size, random.Random(t))
        assert sum(0 < x < 1 for x in q) <= 1 and all(0 <= x <= 1 for x in q)
        assert abs(sum(x * s for x, s in zip(q, size)) - sum(x * s for x, s in zip(p, size))) < 1e-6
        seen = [a + b for a, b in zip(seen, q)]
    assert max(abs(a / 400 - b) for a, b in zip(seen, p)) < 0.12
    assert M.duel([], [], r) == [] and M.duel([0.3], [5], r) == [0.3]


def test_totals():
    assert M.plan_totals({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 1)}) == {"a": 1.0, "b": 1.0}
    x = M.plan_totals({"a": 100, "b": 1000, "c": 0}, {"a": (0.4, 2), "b": (0.4, 1), "c": (0.2, 9)})
    assert x == {"a": 2.0, "b": 0.2}
    assert M.plan_totals({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1)}, total_tokens=1000) == {"a": 2.0, "b": 0.5}
    assert M.plan_totals({}, {"a": (1.0, 1)}) == {}


def docs(spark, n=900):
    r = random.Random(3)
    data = [(i, " ".join(["word"] * r.randrange(1, 60)), r.choice(["A-b", " a_b", "C", "c ", None, "unlisted"]), 7) for i in range(n)]
    data += [(5000, None, "c", 7), (5001, "", "c", 7), (None, "word word", "c", 7), (2**60 + 1, "word", "c", 7), (1, data[1][1], data[1][2], 7)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, tokens int")


@pytest.mark.parametrize("group", [20_000, 40])
def test_shares_caps_and_tree(spark, monkeypatch, group):
    monkeypatch.setattr(M, "GROUP", group)
    monkeypatch.setattr(M, "FAN_IN", 3)
    t = spark.createDataFrame([("a b", 0.7, 3), ("C", 0.2, 1), ("void", 0.1, 2), (None, 0.5, 1), ("C", None, None)], TARGETS)
    rec, rep = M.mix(docs(spark), t)
    rep = {r["source"]: r for r in rep.collect()}
    assert set(rep) == {"a_b", "c", "void"} and rep["void"]["used_tokens"] == 0
    assert abs(rep["a_b"]["actual_share"] - 0.7 / 0.9) < 0.01 and abs(rep["c"]["actual_share"] - 0.2 / 0.9) < 0.01
    assert rep["a_b"]["most_copies"] <= 3 and rep["c"]["most_copies"] <= 1
    got = rec.collect()
    assert {r["source"] for r in got} == {"a_b", "c"} and all(r["copies"] >= 1 for r in got)
    assert sum(r["tokens"] * r["copies"] for r in got if r["source"] == "c") == rep["c"]["used_tokens"]
    if group == 40:
        assert rows(M.mix(docs(spark), t)[0]) == rows(rec)  # the same again


def test_total_given_and_empty(spark):
    t = spark.createDataFrame([("c", 1.0, 1)], TARGETS)
    rec, rep = M.mix(docs(spark), t, total_tokens=10**9)
    assert rep.first()["used_tokens"] == rep.first()["source_tokens"]
    e = docs(spark).where("false")
    assert M.mix(e, t)[0].count() == 0 and M.mix(e, t)[1].first()["actual_share"] == 0.0
    assert M.mix(docs(spark), t.where("false"))[0].count() == 0


def test_small_sources_are_repeated_up_to_their_cap(spark):
    t = spark.createDataFrame([("a b", 0.5, 3), ("C", 0.5, 4)], TARGETS)
    words = {r["source"]: r["source_tokens"] for r in M.mix(docs(spark), t)[1].collect()}
    rec, rep = M.mix(docs(spark), t, total_tokens=int(4.2 * words["c"]))
    rep = {r["source"]: r for r in rep.collect()}
    assert rep["c"]["most_copies"] == 3 and rep["a_b"]["most_copies"] <= 3 and rep["c"]["used_tokens"] > 2 * words["c"]
    copies = sorted({r["copies"] for r in rec.where("source = 'c'").collect()})
    assert copies == [2, 3]  # 2.1 copies of each on average
