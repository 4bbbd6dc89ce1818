import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.operators import bpe, limits, search, security
from codeloom.options import Options, options, read_env
from codeloom.sources import exports as X
from codeloom.sources import repo as R
from codeloom.streaming import operators as ST
from tests.conftest import rows


def test_options_later_sources_win(tmp_path):
    a, b = tmp_path / ".env", tmp_path / "options.env"
    a.write_text("# c\nexport CODELOOM_IMPACT=yes\nCODELOOM_BASE_BRANCH='dev'\nCODELOOM_MAX_RUNNING_JOBS=5 # five\nbad line\n")
    b.write_text("CODELOOM_BASE_BRANCH=\"release\"\nCODELOOM_SECURITY=\n")
    got = options([str(a), str(b), str(tmp_path / "none")], {"CODELOOM_MAX_RUNNING_JOBS": "7"}, refactor=True)
    assert (got.impact, got.base_branch, got.max_running_jobs, got.refactor, got.security) == (True, "release", 7, True, False)
    assert options([], {}) == Options() and read_env(str(tmp_path)) == {}
    with pytest.raises(ValueError):
        options([], {"CODELOOM_IMPACT": "maybe"})


def test_clone_and_tree(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n")
    git = lambda *c: subprocess.run(["git", "-C", str(src), "-c", "user.name=a", "-c", "user.email=a@b", *c], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    with R.cloned(f"file://{src}") as folder:
        assert rows(R.scan(spark, folder), "path") == [("a.py",)]
    assert not __import__("os").path.exists(folder)
    with R.cloned(str(src)) as folder:
        assert folder == str(src)
    with pytest.raises(ValueError), R.cloned("file:///nowhere/at/all"):
        pass
    files = spark.createDataFrame([("a/b.py", "é\n"), ("../out.py", "x"), ("/abs.py", "x"), ("node_modules/x.js", "x"), ("n.py", None)], "path string, content string")
    assert rows(R.write_tree(files, str(tmp_path / "out"))) == [("a/b.py", 3), ("n.py", 0)]
    assert (tmp_path / "out/a/b.py").read_text() == "é\n"


def test_archives_documents_and_job_records(spark, tmp_path):
    (tmp_path / "job").mkdir()
    (tmp_path / "job/r.md").write_text("x")
    X.write_meta({"job_id": "j1", "status": "done", "url": "u", "outputs": [{"name": "r.md", "label": "R"}]}, str(tmp_path / "job"))
    assert X.write_zip(str(tmp_path / "job"), str(tmp_path / "o.zip")) == ["r.md"]
    disk = X.read_meta(spark, str(tmp_path / "*/meta.json"))
    memory = spark.createDataFrame([("j1", "running", None), ("j2", "running", "v")], "job_id string, status string, url string")
    assert rows(X.known_jobs(memory, disk)) == [("j1", "running", "u"), ("j2", "running", "v")]
    assert rows(limits.running_now(memory)) == [(2, 2)]
    md = spark.createDataFrame(list(enumerate(["# T & <b>", "", "- **one** `x`", "2. two", "plain"])), "line_no int, line string")
    assert X.write_docx(md, str(tmp_path / "d.docx")) == 4
    body = zipfile.ZipFile(tmp_path / "d.docx").read("word/document.xml").decode()
    assert "T &amp; &lt;b&gt;" in body and 'w:val="ListBullet"/></w:pPr><w:r><w:t xml:space="preserve">one x<' in body and ">two<" in body


def test_vulture_opinion(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a.py:3: unused function 'f' (90% confidence)\nnoise\na.py:9: unused class 'C' (80% confidence)\n")
    unused = security.read_vulture(spark, str(tmp_path / "v.txt"))
    d = spark.createDataFrame([("a.py", "f"), ("a.py", "g"), ("b.js", "h")], "path string, symbol string")
    assert rows(unused) == [("C",), ("f",)] and rows(security.live_by_vulture(d, unused)) == [("g",)]


def test_token_counts_do_not_depend_on_slices(spark):
    import random

    r = random.Random(1)
    texts = ["".join(r.choice([" ", "  ", "\n", "\t ", "é", "word", "12", "'s", "...", "日本", "I've", "a1b2", " "]) for _ in range(r.randrange(400))) for _ in range(60)] + ["", "x" * 5000, " " * 5000, "1" * 3000 + "a" * 3000]
    for t in texts:
        whole = len(bpe.encoding(bpe.DEFAULT_VOCAB).encode_ordinary(t))
        for size in (1, 7, 64, 1000):
            assert bpe.token_count(t, bpe.DEFAULT_VOCAB, size) == whole, (t, size)
            assert "".join(bpe.slices(t, size)) == t
    df = spark.createDataFrame([(1, "one two", "k"), (2, None, "k"), (3, "", "k")], "tokens_id int, text string, keep string")
    assert rows(bpe.count_tokens(df)) == [(1, "k", 2), (2, "k", 0), (3, "k", 0)]


def test_embedding_choice_and_search(spark):
    other = lambda texts: [[1.0] * 4 for _ in texts]
    assert search.choose_embedder({})[0] == "local" and search.choose_embedder({"openai": other})[0] == "openai" and search.choose_embedder({"openai": other, "gemini": other})[0] == "gemini"
    df = search.embed(spark.createDataFrame([(1, "load the voucher cache"), (2, "parse a tree of files"), (3, ""), (4, None)], "id int, text string"), "text")
    assert search.semantic_search(df, "voucher cache", k=1).first()["id"] == 1
    assert search.semantic_search(df.where("false"), "x").count() == 0


def test_job_admission(spark):
    m = 60_000_000
    data = [("h", "c1", 1, 0, 10 * m), ("h", "c1", 2, m, 10 * m), ("h", "c2", 3, 2 * m, 10 * m), ("h", "c3", 4, 3 * m, m), ("h", "c3", 5, 11 * m, m), ("h", "c1", 6, 12 * m, 1), ("h", "c1", 7, 13 * m, 1), ("h", "c1", 8, 14 * m, 1), ("h", "c1", 9, 15 * m, 1), ("h", "c1", 10, 61 * m, 1), ("g", "c1", 11, 0, 1)]
    df = spark.createDataFrame(data, "host string, client string, id int, us long, took long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"]: r["outcome"] for r in limits.job_admission(df, "host", "client", "ts", "took", "id").collect()}
    assert got == {1: "started", 2: "started", 3: "started", 4: "busy", 5: "started", 6: "started", 7: "started", 8: "started", 9: "rate", 10: "started", 11: "started"}


def test_dispatch_sums_waits_beyond_a_long(spark, tmp_path):
    import __spark_entry__ as E
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * i AS ts, i AS user_id, CASE WHEN i = 12 THEN 'view' ELSE 'click' END AS event_type, 2e12 AS value FROM range(13) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {r["event_type"]: (r["calls"], r["longest_us"], int(r["waited_us"]), r["done_us"]) for r in E.queries()["dispatch"](spark, str(tmp_path)).collect()}
    want = {k: v for k, *v in con.execute(f"SELECT event_type, calls, longest_us, waited_us, done_us FROM ({E.oracle_sql()['dispatch']})").fetchall()}
    assert {k: list(v) for k, v in got.items()} == want
    assert got["click"][2] > 2**63 and got["view"][2] == 0


def test_cooldown_state(spark):
    have = spark.createDataFrame([("a", 5), ("b", 6)], "model string, cool_until long")
    new = spark.createDataFrame([("a", 3), ("c", 9)], "model string, cool_until long")
    assert rows(limits.set_cooling(have, new)) == [("a", 3), ("b", 6), ("c", 9)]
    kept, day, ran = limits.reset_daily(have, "2025-01-01", "2025-01-01")
    assert kept.count() == 2 and not ran
    kept, day, ran = limits.reset_daily(have, "2025-01-01", "2025-01-02")
    assert kept.count() == 0 and day == "2025-01-02" and ran


def test_windows_split_over_spans(spark):
    import random

    r = random.Random(4)
    data = [(i, "k", r.randrange(0, 40 * limits.MINUTE), r.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(data, "id int, k string, us long, n long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = {x["id"]: (x["requests_60s"], x["amount_60s"]) for x in limits.sliding_usage(df, "k", span=3 * limits.MINUTE).collect()}
    for i, _, t, _ in data:
        live = [n for _, _, u, n in data if t - limits.MINUTE < u <= t]
        assert got[i] == (len(live), sum(live))


def test_callbacks_of_file_events(spark, tmp_path):
    seen, busy = [], str(tmp_path / "busy")
    call = ST.on_changes(lambda df, i: seen.append((i, rows(df))), busy_path=busy)
    df = spark.createDataFrame([("a.py",), ("a.py",), ("docs/b.py",), ("c.md",), ("d.rs",)], "path string")
    call(df, 1)
    call(df.where("path = 'c.md'"), 2)
    (tmp_path / "busy").touch()
    call(df, 3)
    assert seen == [(1, [("a.py",), ("d.rs",)])]
    told = []
    ST.Progress(lambda b, n: told.append((b, n))).onQueryProgress(type("E", (), {"progress": type("P", (), {"batchId": 4, "numInputRows": 7})}))
    assert told == [(4, 7)]


def test_fast_rewriting(spark):
    from codeloom.operators import summarize as S

    doc = '"""Doc."""\n\n\ndef f():\n    """Doc."""\n    return 1\n'
    data = [("r", "a.py", "x = 1\n" * 3, [], 5), ("r", "b.py", "y = 2\n" * 3, [], 5), ("r", "c.py", doc, ["f"], 14), ("r", "d.py", "z = 3\n" * 900, [], 1350), ("r", "e.py", "lost = 1\n", [], 3)]
    df = spark.createDataFrame(data, "repo string, path string, content string, functions array<string>, tokens int")

    def model(prompt):
        head, body = prompt.split("\n", 1)
        if "[FILE:" in prompt:
            import re

            got = re.findall(r"\[FILE: ([^\]]+)\]\n(.*?)\n\[END\]", prompt, re.S)
            return "noise\n" + "\n".join(f"[FILE: {p}]\n```python\n# better\n{t}\n```\n[END]" for p, t in got if p != "e.py")
        return ("# header\n" if "header" in head else "# alone\n") + body

    got = {r["path"]: r for r in S.refactor_fast(df, model, ["repo"], batch_tokens=100).collect()}
    assert {p: (r["way"], r["changed"]) for p, r in got.items()} == {"a.py": ("batch", True), "b.py": ("batch", True), "c.py": ("header", True), "d.py": ("alone", True), "e.py": ("batch", False)}
    assert got["a.py"]["content"].startswith("# better\nx = 1") and got["c.py"]["content"].startswith("# header\n") and got["e.py"]["content"] == "lost = 1\n"


def test_caches_of_addresses_and_indexes(spark, tmp_path):
    from codeloom.operators import cache

    a, b = cache.of_url(str(tmp_path), "https://x/a"), cache.of_url(str(tmp_path) + "/", "https://x/b")
    assert a != b and a == cache.of_url(str(tmp_path), "https://x/a")
    schema = "file_path string, content_hash string, analysis string"
    assert cache.load_or(spark, a, schema).count() == 0
    cache.save(spark.createDataFrame([("p", "h", "t")], schema), a)
    assert rows(cache.load_or(spark, a, schema)) == [("p", "h", "t")] and cache.load_or(spark, b, schema).count() == 0
    path = str(tmp_path / "index")
    assert not search.index_exists(spark, path)
    search.save_index(search.embed(spark.createDataFrame([(1, "abc")], "id int, text string"), "text"), path)
    assert search.index_exists(spark, path) and search.semantic_search(spark.read.parquet(path), "abc").first()["id"] == 1


def test_watching_a_tree(spark, tmp_path):
    import os
    import threading

    from codeloom.sources import watch as W

    root, events = tmp_path / "tree", str(tmp_path / "events")
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("1")
    (root / "src/b.py").write_text("1")
    before = W.look(str(root))
    (root / "src/a.py").write_text("12")
    (root / "c.md").write_text("x")
    os.remove(root / "src/b.py")
    (root / ".git").mkdir()
    (root / ".git/x").write_text("x")
    got = W.differences(before, W.look(str(root)))
    assert got == [("c.md", "created"), ("src/a.py", "modified"), ("src/b.py", "deleted")]
    W.write_events(got, events, 1_700_000_000.25)
    assert W.write_events([], events, 0) is None
    left = [2]
    t = threading.Thread(target=W.watch, args=(str(root), events, lambda: left.__setitem__(0, left[0] - 1) or left[0] >= 0, 0.2))
    t.start()
    __import__("time").sleep(0.05)
    (root / "new.rs").write_text("x")
    t.join()
    seen = ST.run_once(ST.source_changes(ST.change_stream(spark, events)), str(tmp_path / "ck"), "watched")
    assert rows(seen, "path", "kind") == [("new.rs", "created"), ("src/a.py", "modified"), ("src/b.py", "deleted")]
