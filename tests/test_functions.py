import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import scoring as S
from codeloom.functions import text as T


def one(spark, *values, fn):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
    return row.select(fn(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize("path,module,want", [
    ("pkg/a.py", "util", ["util.py", "util/__init__.py"]), ("pkg/a.py", ".sub.b", ["pkg/sub/b.py", "pkg/sub/b/__init__.py"]), ("pkg/sub/b.py", "..a", ["pkg/a.py", "pkg/a/__init__.py"]),
    ("pkg/sub/b.py", ".", ["pkg/sub.py", "pkg/sub/__init__.py"]), ("util.py", ".", None), ("util.py", "..", None), ("util.py", ".x", ["x.py", "x/__init__.py"])])
def test_python_candidates(spark, path, module, want):
    assert one(spark, path, module, fn=T.python_candidates) == want


@pytest.mark.parametrize("path,module,first", [("web/index.js", "./lib/x", "web/lib/x.js"), ("web/lib/x.ts", "../comp", "web/comp.js"), ("a.js", "../../q", "q.js"), ("web/index.js", "react", None)])
def test_js_candidates(spark, path, module, first):
    got = one(spark, path, module, fn=T.js_candidates)
    assert (got and got[0]) == first


@pytest.mark.parametrize("stmt,py,js", [("from util import f", "util", None), ("from .sub.b import g", ".sub.b", None), ("import util, pkg.sub.b", "util", None), ("import {x} from './lib/x'", None, "./lib/x"), ("const a = require(\"./y\")", None, "./y"), ("from . import z", ".", None)])
def test_import_statements(spark, stmt, py, js):
    if py:
        assert one(spark, stmt, fn=T.python_import) == py
    assert one(spark, stmt, fn=T.js_import) == js


@pytest.mark.parametrize("text,want", [("<think>x</think> hi", "hi"), ("a <THINK>never closed", "a"), ("plain", "plain"), ("", ""), (None, None)])
def test_strip_think(spark, text, want):
    assert one(spark, text, fn=T.strip_think) == want


def test_fences_blocks_and_inline(spark):
    assert one(spark, "```py\nx = 1\n```", fn=T.strip_fences) == "x = 1"
    assert one(spark, "x = 1", fn=T.strip_fences) == "x = 1"
    got = one(spark, "[FILE: a.py]\nA\n[END] [FILE:b]B[END]", fn=T.marked_blocks)
    assert [(b["name"], b["body"]) for b in got] == [("a.py", "A"), ("b", "B")]
    assert one(spark, "**b** *i* `c`", fn=T.strip_inline) == "b i c"
    assert [one(spark, x, fn=T.markdown_class) for x in ("# a", " ## b", "### c", "- d", "1. e", "", "f")] == ["h1", "h2", "h3", "bullet", "numbered", "blank", "text"]


def test_urls(spark):
    r = one(spark, "https://www.github.com/o/r.git", fn=P.repo_of_url)
    assert (r["clean_url"], r["repo"]) == ("https://github.com/o/r", "o/r")
    for bad in ("https://bitbucket.org/o/r", "ftp://github.com/o/r", "https://github.com/o", "https://github.com/o/r/tree/x", "", None):
        assert one(spark, bad, fn=P.repo_of_url) is None
    assert one(spark, "https://tok@host/x", fn=P.redact_url) == "https://host/x"


def test_provider_chains(spark):
    f = lambda c: T.parse_chain(c)
    assert one(spark, "groq:m:k:1,bad,zzz:m:k, gemini : a : b", fn=lambda c: F.to_json(f(c))) == '[{"provider":"groq","model":"m","key":"k:1"},{"provider":"gemini","model":"a","key":"b"}]'
    for none in ("", None, "zzz:m:k", "groq:m", "groq::k"):
        assert one(spark, none, fn=f) is None
    assert [one(spark, m, fn=T.provider_of) for m in ("gemini-2", "gemma-3", "nvidia/x", "llama")] == ["gemini", "gemini", "nvidia", "groq"]
    assert one(spark, "a.py:3: unused function 'foo' (60% confidence)", fn=T.unused_name) == "foo"


def test_three_extension_rules(spark):
    got = {p: tuple(one(spark, p, fn=f) for f in (P.suffix, P.splitext, P.after_last_dot)) for p in ("a/b.PY", ".gitignore", "a.b/c", "x.tar.gz", "n")}
    assert got == {"a/b.PY": (".py", ".py", ".py"), ".gitignore": ("", "", ".gitignore"), "a.b/c": ("", "", ".b/c"), "x.tar.gz": (".gz", ".gz", ".gz"), "n": ("", "", "")}


def test_path_predicates(spark):
    assert [one(spark, p, fn=P.is_test_file) for p in ("tests/a.py", "test_a.py", "app_test.py", "x.spec.ts", "a\\tests\\b.ts")] == [True, True, False, False, True]
    assert not one(spark, "docs/x.py", fn=P.is_analysis_target) and one(spark, "src/x.py", fn=P.is_analysis_target)
    assert not one(spark, "latest.py", "x", fn=P.is_audited) and one(spark, "a.py", "x", fn=P.is_audited)
    assert one(spark, "a/.git/b", fn=P.ignored_dir) and not one(spark, "a/.env", fn=P.ignored_dir)


@pytest.mark.parametrize("tokens,tier", [(499, "tier1"), (500, "tier2"), (2999, "tier2"), (3000, "tier3"), (7999, "tier3"), (8000, "tier4")])
def test_tiers(spark, tokens, tier):
    assert one(spark, ".py", tokens, fn=lambda e, t: S.file_tier(e, t, [".md"])) == tier
    assert one(spark, ".md", tokens, fn=lambda e, t: S.file_tier(e, t, [".md"])) == "tier0"


def test_numbers(spark):
    assert [one(spark, n, fn=S.out_tokens) for n in (299, 300, 999, 1000)] == [512, 768, 768, 1024]
    assert one(spark, 100, fn=S.refactor_budget) == 662 and one(spark, 9000, fn=S.refactor_budget) == 8192
    assert [one(spark, n, fn=S.capacity) for n in (5, 250000, 20)] == [4, 200000, 16]
    assert [one(spark, s, fn=S.severity) for s in ("error", "WARNING", "info", None)] == ["HIGH", "MEDIUM", "LOW", "MEDIUM"]
    assert one(spark, 1500, fn=S.k_format) == "1.5k" and one(spark, 12, fn=S.k_format) == "12"
    assert one(spark, "abcd", "efgh", fn=T.token_estimate) == 2 and one(spark, None, fn=T.token_estimate) == 0


def test_answer_quality(spark):
    df = spark.createDataFrame([("x" * 49, ["f"], [], 10), ("This file has function f. " + "y" * 60, ["f", "g"], [], 10), (None, [], [], 1)], "a string, f array<string>, c array<string>, t int")
    got = [round(r[0], 6) for r in df.select(S.answer_quality(F.col("a"), F.col("f"), F.col("c"), F.col("t"))).collect()]
    assert got == [0.0, 0.75, 0.0]
