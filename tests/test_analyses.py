import datetime as dt

from pyspark.sql import functions as F

from codeloom.functions.text import token_estimate
from codeloom.operators import batching, cache, context, limits, parse, reports, search, symbols
from tests.conftest import rows

A = '''__all__ = ["exported"]
def used(): pass
def lonely(): pass
def looped(): pass
looped()
def _priv(): pass
def exported(): pass
def called(): pass
@app.get("/")
def routed(): pass
class Orphan: pass
'''
B = "def main():\n    called()\nused\n"


def files(spark, *rows_):
    return spark.createDataFrame([("r", p, t) for p, t in rows_], "repo string, path string, content string")


def test_dead_code_fixture(spark):
    f = files(spark, ("a.py", A), ("b.py", B), ("tests/test_x.py", "def test_y(): pass\n"), ("n.py", None))
    parsed = parse.parse_files(f, ["repo", "path"])
    defs = parse.definitions(parsed, ["repo", "path"])
    callees = parse.call_pairs(parsed, ["repo"]).select("repo", F.col("callee").alias("symbol"))
    exports = parsed.select("repo", F.explode("exports").alias("symbol"))
    got = rows(symbols.dead_symbols(defs, f, ["repo"], callees, exports), "kind", "symbol")
    assert got == [("class", "Orphan"), ("function", "lonely"), ("function", "main")]
    vetoed = symbols.dead_symbols(defs, f, ["repo"], callees, exports, spark.createDataFrame([("lonely",)], "symbol string"))
    assert rows(vetoed, "symbol") == [("Orphan",), ("main",)]
    assert rows(reports.dead_code_report(vetoed)) == [("r", 0, "## Dead symbols in r"), ("r", 2, "- `Orphan` in a.py"), ("r", 3, "- `main` in b.py")]


def test_symbols_that_are_no_words(spark):
    f = files(spark, ("a.rb", "def foo?\nend\n"), ("b.rb", "x.foo?\n"), ("c.rb", "def bar!\nend"))
    d = spark.createDataFrame([("r", "a.rb", "function", "foo?"), ("r", "c.rb", "function", "bar!")], "repo string, path string, kind string, symbol string")
    assert rows(symbols.odd_references(d, f, ["repo"]), "symbol", "in_path") == [("bar!", "c.rb"), ("foo?", "a.rb"), ("foo?", "b.rb")]


def test_coverage_fixture(spark):
    f = files(spark, ("app.py", "def run():\n    helper()\ndef helper(): pass\ndef orphan(): pass\ndef _hid(): pass\n"), ("tests/test_app.py", "def test_run():\n    run()\n"), ("app_test.py", "orphan"))
    p = parse.parse_files(f, ["repo", "path"])
    s = symbols.coverage(parse.definitions(p, ["repo", "path"]), f, ["repo"], parse.call_pairs(p, ["repo"]))
    assert rows(s, "fn", "status") == [("helper", "indirect"), ("orphan", "gap"), ("run", "covered")]
    t = symbols.coverage_totals(s, ["repo"]).first()
    assert (t["total"], t["covered"], t["indirect"], t["gaps"], t["pct"]) == (3, 1, 1, 1, 66)


def test_import_resolution_fixture(spark):
    paths = {"util.py": "from . import z\nfrom .. import z\nimport util, pkg.sub.b\n", "pkg/__init__.py": "", "pkg/a.py": "from util import f\nfrom .sub.b import g\nimport os.path\nfrom pkg import sub\n", "pkg/sub/__init__.py": "", "pkg/sub/b.py": "from ..a import h\nfrom . import z\n",
             "web/index.js": "import {x} from './lib/x'\nimport React from 'react'\nimport './side.css'\n", "web/lib/x.ts": "import c from '../comp'\n", "web/comp/index.tsx": ""}
    f = files(spark, *paths.items())
    got = rows(parse.resolve_imports(parse.parse_files(f, ["repo", "path"]), f, ["repo"]), "path", "position", "target")
    assert got == [("pkg/a.py", 0, "util.py"), ("pkg/a.py", 1, "pkg/sub/b.py"), ("pkg/a.py", 3, "pkg/__init__.py"), ("pkg/sub/b.py", 0, "pkg/a.py"), ("pkg/sub/b.py", 1, "pkg/sub/__init__.py"), ("util.py", 2, "util.py"), ("web/index.js", 0, "web/lib/x.ts"), ("web/lib/x.ts", 0, "web/comp/index.tsx")]


def test_parsers_of_other_languages():
    assert parse.parse("go", "package a\nimport \"fmt\"\ntype T struct {}\nfunc (t *T) Do() {}\nfunc F() {}\n")["functions"] == ["Do", "F"]
    assert parse.parse("js", "class A { go(x) {} }\nfunction f() {}\nconst g = (a) => a;\n")["classes"] == ["A"]
    assert parse.parse("rs", "pub struct S; fn f() {}")["functions"] == ["f"]
    assert parse.parse("rb", "class A\n  def b?\n  end\nend")["functions"] == ["b?"]
    assert parse.parse("java", "class A { public int f(int a) { return 1; } }")["classes"] == ["A"]
    assert parse.parse("py", "def broken(:") == parse.EMPTY and parse.parse("xx", "a") == parse.EMPTY and parse.parse("py", None) == parse.EMPTY
    got = parse.parse_python("class C:\n  def m(self):\n    self.a.go()\n    def inner():\n      deep()\n@deco()\ndef f():\n  pass\n")
    assert got["calls"] == {"m": ["go"], "inner": ["deep"], "f": []} and got["functions"] == ["m", "inner", "f"]


INDEX = [("main.py", 500, ["run", "cli"], [], "async def run(repo_path)...", 0, 0), ("config/settings.py", 300, ["get_model"], [], "GROQ_API_KEY = os.getenv(...)", 1, 2), ("config/llm_client.py", 800, ["llm_call_async"], ["LLMClient"], "class LLMClient: ...", 2, 1), ("agents/analyst.py", 600, ["analyze_parallel"], [], "async def analyze_parallel(modules)...", 3, 0), ("agents/parser.py", 400, ["parse_modules"], [], "def parse_modules(files)...", 4, 1)]


def ranked(spark, task="llm client"):
    from codeloom.operators.graph import boost

    f = spark.createDataFrame(INDEX, "path string, tokens int, functions array<string>, classes array<string>, snippet string, id int, indeg int")
    s = f.withColumn("score", context.keyword_score(task, F.col("snippet"))["score"] + context.centrality(F.col("indeg")))
    e = spark.createDataFrame([(0, 1), (2, 1), (3, 2), (3, 4)], "src int, dst int")
    return f.join(boost(s.select("id", "score"), e), "id").withColumn("ord", F.col("id"))


def test_context_ranking_fixture(spark):
    got = [(r["path"], round(r["boosted"], 2)) for r in context.within_budget(ranked(spark), 8000, "boosted").orderBy("rank").collect()]
    assert got == [("config/llm_client.py", 7.39), ("config/settings.py", 4.04), ("agents/parser.py", 1.39), ("main.py", 0.5), ("agents/analyst.py", 0.0)]


def test_budget_overshoot_scales_snippets(spark):
    top = context.fit_snippets(context.within_budget(ranked(spark), 400, "boosted"), 400).collect()
    assert [(r["path"], r["snippet"], r["tokens_share"]) for r in top] == [("config/llm_client.py", "class LLMC", 1.0)]
    assert context.within_budget(ranked(spark), 0, "boosted").count() == 5


def test_context_filters(spark):
    f = ranked(spark)
    assert context.with_filters(f, ["rs"]).count() == 0 and context.with_filters(f, [" py"]).count() == 5
    assert rows(context.with_filters(f, None, "agents/"), "path") == [("agents/analyst.py",), ("agents/parser.py",)]


def test_greedy_batches(spark):
    assert batching.greedy([600, 700, 300, 1400, 100], 1500, 6) == [0, 0, 1, 2, 2]
    assert batching.greedy([10] * 7, 1500, 6) == [0] * 6 + [1]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate([600, 700, 300, 1400, 100])] + [("q", 0, 5000)], "repo string, path int, tokens int")
    assert rows(batching.greedy_batches(df, 1500, ["repo"], ["path"]), "repo", "path", "batch") == [("q", 0, 0), ("r", 0, 0), ("r", 1, 0), ("r", 2, 1), ("r", 3, 2), ("r", 4, 2)]
    assert rows(batching.chunks(df, 2, ["repo"], ["path"]), "repo", "path", "chunk")[-1] == ("r", 4, 2)


def test_rate_admission_fixture(spark):
    s = 1_000_000
    assert limits.admit([0, s, 2 * s, 3 * s, 4 * s, 60 * s], [0] * 6, 4, 200_000, 16) == [True, True, True, True, False, True]
    assert limits.admit([i * 60 * s for i in range(20)], [0] * 20, 4, 200_000, 16) == [True] * 16 + [False] * 4
    t0 = dt.datetime(2025, 1, 1)
    ev = spark.createDataFrame([("m", i, t0 + dt.timedelta(seconds=x), 0) for i, x in enumerate([0, 1, 2, 3, 4, 60])] + [("m", 9, None, 1)], "k string, event_id long, ts timestamp, n long")
    assert rows(limits.rate_admission(ev, "k", "ts", "n", "event_id", 4, 200_000, 16), "event_id", "admitted") == [(0, True), (1, True), (2, True), (3, True), (4, False), (5, True)]


def test_cascade_and_cooldowns(spark):
    pools = spark.createDataFrame([("tier1", "groq", "a", 1), ("tier0", "groq", "a", 1), ("tier0", "gemini", "b", 2), ("tier2", "nvidia", "c", 1)], "tier string, provider string, model string, pool_pos int")
    got = rows(limits.cascade(pools, spark.createDataFrame([("groq",), ("gemini",)], "provider string")).where("primary = 'tier1'"), "pos", "model")
    assert got == [(0, "a"), (1, "b")]
    q = spark.createDataFrame([("m", 5), ("m", 20), ("x", 5)], "model string, us long")
    c = spark.createDataFrame([("m", 1, 10)], "model string, start_us long, until_us long")
    assert rows(limits.cooldown_asof(q, c, "model"), "model", "us", "cooling", "remaining_us") == [("m", 20, False, 0), ("m", 5, True, 5), ("x", 5, False, 0)]


def test_cache_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", "h1", 1, "{bad", "x"), ("b", "h2", 2, None, "")], "file_path string, content_hash string, tokens int, structure string, analysis string")
    f = spark.createDataFrame([("a", "h1"), ("a", "h9"), ("b", "h2"), (None, None)], "file_path string, content_hash string")
    assert rows(cache.look_up(f, c), "file_path", "content_hash", "hit") == sorted([("a", "h1", True), ("a", "h9", False), ("b", "h2", False), (None, None, False)], key=repr)
    u = cache.upsert(c, spark.createDataFrame([("a", "h1", 7), ("n", "h3", 3)], "file_path string, content_hash string, tokens int"), ["tokens"])
    assert rows(u, "file_path", "tokens", "analysis") == [("a", 7, "x"), ("b", 2, ""), ("n", 3, None)]
    cache.save(u, str(tmp_path / "c"))
    cache.save(c, str(tmp_path / "c"))
    assert cache.load(spark, str(tmp_path / "c")).count() == 2
    assert cache.decode(c, "structure", "functions array<string>").where("file_path = 'a'").first()["structure"]["functions"] is None


def test_vector_search(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in search.top_k(v, [1.0, 0.0], 2).collect()] == [0, 1]
    assert rows(search.top_k_of(v.where("vec_id = 0"), v.where("embedding is not null"), 1), "query_id", "vec_id", "rank") == [(0, 1, 1)]


def test_estimates(spark):
    assert spark.range(1).select(token_estimate(F.lit("x" * 9))).first()[0] == 2
