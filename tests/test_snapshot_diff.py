import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom.operators.snapshot_diff import snapshot_changes
from tests.conftest import rows

SCHEMA = "snapshot_id long, repo string, branch string, timestamp string, files array<string>, hashes array<string>, links array<array<string>>, delivered_at timestamp_ntz, extra string"
T = dt.datetime(2025, 1, 1)


def snap(i, ts, files, hashes=None, links=None, at=T, repo="r", branch="b"):
    return (i, repo, branch, ts, files, hashes, links, at, "x")


def norm(p):
    p = p.replace("\\", "/")
    return p[2:] if p.startswith("./") else p


def brute(data):
    valid = {}
    for r in sorted(data, key=lambda r: r[7]):
        valid[r[0]] = r
    chains = {}
    for i, repo, branch, ts, files, hashes, links, _, _ in valid.values():
        if files is None:
            continue
        f = {}
        for k, p in enumerate(files):
            if p is not None:
                h = hashes[k] if hashes is not None and k < len(hashes) else None
                f[norm(p)] = max([x for x in (f.get(norm(p)), h.lower() if h else None) if x], default=None)
        l = {f"{norm(x[0])} -> {norm(x[1])}" for x in links or [] if len(x) > 1 and x[0] is not None and x[1] is not None}
        chains.setdefault((repo, branch), []).append((dt.datetime.fromisoformat(ts.replace("Z", "+00:00")), i, f, l))
    out = set()
    for c in chains.values():
        c.sort(key=lambda x: x[:2])
        for (_, _, f0, l0), (_, i, f1, l1) in zip(c, c[1:]):
            out |= {(i, "file", p, "added") for p in f1.keys() - f0.keys()} | {(i, "file", p, "removed") for p in f0.keys() - f1.keys()}
            out |= {(i, "file", p, "changed") for p in f0.keys() & f1.keys() if f0[p] and f1[p] and f0[p] != f1[p]}
            out |= {(i, "link", p, "added") for p in l1 - l0} | {(i, "link", p, "removed") for p in l0 - l1}
    return sorted(out)


def run(spark, data):
    return rows(snapshot_changes(spark.createDataFrame(data, SCHEMA)))


def test_every_kind_of_change_and_spelling(spark):
    data = [
        snap(3, "2025-01-03T00:00:00+02:00", ["./a.py", "d\\x.py", "d/x.py"], ["AA", None, "cc"], [["a.py", "d/x.py"], ["a.py"], ["a.py", None]]),
        snap(1, "2025-01-01 00:00:00Z", ["a.py", "b.py"], ["aa", "bb"], [["a.py", "b.py"], ["a.py", "b.py"]]),
        snap(2, "2025-01-02T00:00:00Z", ["a.py", "b.py"], ["AB", "BB"], None),
        snap(9, "2025-01-01T12:00:00Z", None),
    ]
    got = run(spark, data)
    assert got == brute(data)
    assert (2, "file", "a.py", "changed") in got and (2, "link", "a.py -> b.py", "removed") in got and (3, "file", "d/x.py", "added") in got


def test_last_delivery_wins_and_failed_last_delivery_removes_the_snapshot(spark):
    late = T + dt.timedelta(days=1)
    data = [snap(1, "2025-01-01T00:00:00Z", ["a"]), snap(2, "2025-01-02T00:00:00Z", ["a", "z"]), snap(2, "2025-01-02T00:00:00Z", ["a", "b"], at=late), snap(3, "2025-01-03T00:00:00Z", ["a"]), snap(3, "2025-01-03T00:00:00Z", None, at=late), snap(4, "2025-01-04T00:00:00Z", ["b"])]
    assert run(spark, data) == [(2, "file", "b", "added"), (4, "file", "a", "removed")]


def test_nulls_empty_and_first_snapshots(spark):
    assert run(spark, []) == []
    data = [snap(1, "2025-01-01T00:00:00Z", []), snap(2, "2025-01-02T00:00:00Z", [None, "a"], [None, None]), snap(5, "bad", ["q"]), snap(None, "2025-01-02T00:00:00Z", ["q"]), snap(6, None, ["q"]), snap(7, "2025-01-02T00:00:00Z", ["q"], repo=None)]
    assert run(spark, data) == [(2, "file", "a", "added")]


def test_ties_in_time_follow_the_id(spark):
    data = [snap(2, "2025-01-01T00:00:00Z", ["b"]), snap(1, "2025-01-01T00:00:00Z", ["a"]), snap(1, "2025-01-01T00:00:00Z", ["a"])]
    assert run(spark, data) == [(2, "file", "a", "removed"), (2, "file", "b", "added")]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 3), st.lists(st.tuples(st.sampled_from(["a", "./a", "d\\e", "d/e", "f"]), st.sampled_from([None, "A", "a", "b"])), max_size=4), st.integers(0, 5)), max_size=14))
def test_random_chains_agree_with_brute_force(spark, spec):
    data, seen = [], set()
    for i, day, files, at in spec:
        if (i, at) not in seen:
            seen.add((i, at))
            data.append(snap(i, f"2025-01-0{i}T0{day}:00:00Z", [f for f, _ in files], [h for _, h in files], [[f, "t"] for f, _ in files], at=T + dt.timedelta(hours=at), repo="r" if i % 3 else "q"))
    assert run(spark, data) == brute(data)


def test_the_merge_is_ranged_and_stays_in_the_jvm(spark):
    plan = snapshot_changes(spark.createDataFrame([snap(1, "2025-01-01T00:00:00Z", ["a"])], SCHEMA))._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan


def test_store_merges_deliveries_like_a_full_run(spark, tmp_path):
    import random

    from codeloom.operators import snapshot_store as T
    from codeloom.operators.snapshot_diff import snapshot_changes

    r = random.Random(12)
    schema = "snapshot_id long, repo string, branch string, timestamp string, files array<string>, hashes array<string>, links array<array<string>>, delivered_at timestamp"
    import datetime as dt

    def snap(i, repo, day):
        names = [f"{r.choice('abc')}/f{k}.py" for k in range(12) if r.random() < 0.7]
        links = [[r.choice(names), r.choice(names)] for _ in range(6)] if names else []
        return (i, repo, "main", f"2025-01-{day:02d}T00:00:00Z", names, [r.choice(["H1", "h1", "h2", None]) for _ in names], links, dt.datetime(2025, 2, 1))

    data = [snap(10 * d + k, f"r{k}", d) for d in range(1, 10) for k in range(3) if r.random() < 0.9 and not (k == 2 and d < 4)]
    data += [(900, "r0", "main", "2025-01-20T00:00:00Z", None, None, None, dt.datetime(2025, 2, 1))]  # failed
    full = spark.createDataFrame(data, schema)
    want = rows(snapshot_changes(full))
    store = str(tmp_path / "store")
    T.create(spark, store, full, ranges=5)
    got = []
    for lo, hi in ((1, 3), (4, 4), (5, 8), (9, 20)):
        part = full.where(f"cast(substring(timestamp, 9, 2) as int) between {lo} and {hi}")
        got += rows(T.merge(spark, store, part))
    assert sorted(got, key=repr) == want and len(want) > 60
    assert rows(T.merge(spark, store, full.where("false"))) == []
    late = full.where("timestamp < '2025-01-03'")
    assert rows(T.merge(spark, store, late)) == []
    before = rows(T.listing(spark, store))
    assert len(T.vacuum(spark, store)) >= 4 and rows(T.listing(spark, store)) == before and T.vacuum(spark, store) == []
    held = T.listing(spark, store)
    last = {}
    for x in data:
        if x[4] is not None:
            last[x[1]] = x
    assert {(x["repo"], x["record_key"]) for x in held.where("record_kind = 'file'").collect()} == {(k, p) for k, x in last.items() for p in x[4]}
    one = held.where("repo = 'r0'").select("record_kind", "record_key").collect()
    assert len(one) == len({tuple(x) for x in one})
