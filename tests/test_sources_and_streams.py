import datetime as dt
import json

from pyspark.sql import functions as F

from codeloom import schema
from codeloom.operators import limits
from codeloom.sources import repo as R
from codeloom.streaming import operators as ST
from tests.conftest import rows


def test_scan_prunes_and_caps(spark, tmp_path):
    tree = {"a.py": "x = 1\n", "node_modules/z.js": "1", ".git/config": "c", "img.PNG": "p", "big.py": "x" * 1_000_001, "src/b.ts": "let a = 1", "build/o.js": "1", "skip/me.py": "1", ".env": "K=1", "gen/k.tmp.py": "1", "pkg/__init__.py": ""}
    for p, t in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = R.scan(spark, str(tmp_path), "skip/\n# c\n*.tmp.*\n")
    assert rows(got, "path", "tokens") == [(".env", 0), ("a.py", 1), ("pkg/__init__.py", 0), ("src/b.ts", 2)]
    assert got.where("path = 'a.py'").first()["abs_path"] == str(tmp_path / "a.py")


def test_gitignore_rules(spark):
    pats = R.gitignore_patterns("*.log\n!keep.log\n/root.txt\nd/**/e\n")
    df = spark.createDataFrame([("a/x.log",), ("keep.log",), ("root.txt",), ("s/root.txt",), ("d/q/r/e",)], "path string")
    assert rows(df.where(R.ignored(F.col("path"), pats))) == [("a/x.log",), ("d/q/r/e",), ("root.txt",)]


def test_artifacts(spark, tmp_path):
    g = {"nodes": [{"id": 0, "path": "a.py", "tokens": 5, "functions": ["f"]}], "links": [{"source": 0, "target": 0, "bidirectional": True}]}
    (tmp_path / "g.json").write_text(json.dumps(g, indent=1))
    nodes, links = R.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first()["functions"] == ["f"] and links.first()["bidirectional"] is True
    html = R.fill_template("N=__NODES__;L=__LINKS__", nodes.select("id", "path"), links)
    assert html == 'N=[{"id":0,"path":"a.py"}];L=[{"source":0,"target":0,"bidirectional":true}]'
    (tmp_path / "s.json").write_text(json.dumps({"timestamp": "2025-01-01T00:00:00Z", "files": ["a"], "links": [["a", "b"]]}))
    assert R.read_snapshot(spark, str(tmp_path / "s.json")).first()["links"] == [["a", "b"]]
    (tmp_path / "c.json").write_text(json.dumps({"files": [{"path": "a", "tokens": 1, "functions": [], "classes": [], "imports": [], "snippet": "s"}]}))
    assert R.read_context_index(spark, str(tmp_path / "c.json")).first()["snippet"] == "s"
    assert R.changed_files(spark, str(tmp_path)).count() == 0
    assert R.write_text("x", str(tmp_path / "d" / "r.md")) and (tmp_path / "d" / "r.md").read_text() == "x"
    for name in schema.RELATIONS:
        assert len(schema.schema(name).fields) > 0


def stream_of(spark, path, data, schema_):
    for k, part in enumerate(data):
        spark.createDataFrame(part, schema_).coalesce(1).write.mode("append").parquet(path)
    return ST.events_stream(spark, path, spark.createDataFrame([], schema_).schema)


E = "key string, event_id long, ts timestamp, n long, status string"
T0 = dt.datetime(2025, 1, 1)


def ev(i, sec, n=0, s="a", k="m"):
    return (k, i, T0 + dt.timedelta(seconds=sec), n, s)


def test_stream_debounce(spark, tmp_path):
    s = stream_of(spark, str(tmp_path / "in"), [[ev(0, 0), ev(1, 1), ev(2, 10)], [ev(3, 4000)]], E)
    got = ST.run_once(ST.debounce(s, "key"), str(tmp_path / "ck"), "bursts")
    assert sorted(r["events"] for r in got.collect()) == [1, 2]


def test_stream_admission_equals_batch(spark, tmp_path):
    data = [[ev(0, 0, 10), ev(1, 1, 50), ev(2, 2, 5)], [ev(3, 61, 5), ev(4, 62, 5, k="x")]]
    s = stream_of(spark, str(tmp_path / "in"), data, E)
    got = rows(ST.run_once(ST.admission(s, "key", rpm=4, tpm=60, rpd=16), str(tmp_path / "ck"), "adm"), "event_id", "admitted")
    batch = limits.rate_admission(spark.createDataFrame(sum(data, []), E), "key", "ts", "n", "event_id", 4, 60, 16)
    assert got == rows(batch, "event_id", "admitted")


def test_stream_progress(spark, tmp_path):
    s = stream_of(spark, str(tmp_path / "in"), [[ev(0, 0, s="a"), ev(1, 1, s="a"), ev(2, 2, s="b"), ev(3, 3, s="a"), ev(4, 4, s="done"), ev(5, 5, s="a")]], E)
    got = rows(ST.run_once(ST.progress(s, "key", "status"), str(tmp_path / "ck"), "prog"), "event_id", "status")
    assert got == [(0, "a"), (2, "b"), (3, "a"), (4, "done")]


def test_exclusive_runs(spark, tmp_path):
    seen = []
    call = ST.exclusive(lambda df, i: (seen.append(i), call(df, 99)), str(tmp_path / "busy"))
    call(spark.range(1), 1)
    assert seen == [1] and not (tmp_path / "busy").exists()


def test_stream_of_requests_and_reports_equals_batch(spark, tmp_path):
    import random

    r = random.Random(3)
    data, t = [[], []], 0
    for i in range(80):
        t += r.randrange(0, 14)
        data[i >= 40].append(ev(i, t, r.randrange(1, 30), s=r.choice(["request", "request", "report"]), k=r.choice("kx")))
    s = stream_of(spark, str(tmp_path / "in"), data, E)
    got = rows(ST.run_once(ST.recorded(s, "key", kind="status", rpm=3, tpm=60, rpd=25, tpd=400), str(tmp_path / "ck"), "rec"), "key", "event_id", "admitted")
    batch = limits.recorded_admission(spark.createDataFrame(sum(data, []), E), "key", "ts", "status", "n", "event_id", 3, 60, 25, 400)
    assert got == rows(batch, "key", "event_id", "admitted") and {g[2] for g in got} == {True, False}
    gate = limits.Gate(2, 50, 10, 10**6)
    assert [gate.take(0, "request", 99), gate.take(1, "report", 40), gate.take(2, "request", 9), gate.take(3, "request", 1), gate.take(61_000_000, "request", 49)] == [True, None, True, False, True]


def test_stream_daily_usage(spark, tmp_path):
    day = 86_400
    s = stream_of(spark, str(tmp_path / "in"), [[ev(0, 10, 5), ev(1, 20, 7)], [ev(2, day + 5, 1)], [ev(3, 3 * day, 1)]], E)
    got = rows(ST.run_once(ST.daily_usage(s, "key"), str(tmp_path / "ck"), "daily"), "requests", "amount")
    assert got == [(1, 1), (2, 12)]  # the third day is still open
