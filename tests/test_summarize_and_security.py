import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import parse, security, summarize
from tests.conftest import rows


def flaky(prompt):
    if "boom" in prompt:
        raise RuntimeError("429 rate limit")
    if "slow" in prompt:
        raise TimeoutError("timed out")
    return "<think>x</think>Purpose: function " + prompt * 3


def test_calls_classify_errors(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "slow"), (4, None)], "id int, prompt string")
    got = summarize.call(df, flaky, ["id"])
    assert rows(got, "id", "error", "tries") == [(1, None, 1), (2, "rate_limit", 1), (3, "transient", 3), (4, None, 1)]
    assert got.where("id = 1").first()["answer"] == "Purpose: function okokok"
    assert summarize.outcome(got).first()["failures"] == 2 and not summarize.outcome(got).first()["all_failed"]
    assert [summarize.error_class(RuntimeError(m)) for m in ("404 not found", "bad key")] == ["missing", "fatal"]


def test_analysis_uses_the_cache_and_synthesis_batches(spark):
    files = spark.createDataFrame([("r", f"p{i}", f"h{i % 3}", "word " * 20, ["f"], [], 10) for i in range(12)], "repo string, path string, content_hash string, prompt string, functions array<string>, classes array<string>, tokens int")
    cached = spark.createDataFrame([("h0", "old f"), ("h1", ""), (None, "z")], "content_hash string, analysis string")
    a = summarize.analyse(files, cached)
    assert a.where("from_cache").count() == 4 and a.count() == 12
    assert rows(summarize.synthesis(a), "repo", "batches") == [("r", 2)]
    assert summarize.synthesis(a.limit(3)).first()["batches"] == 1


def test_refactoring_keeps_bad_rewrites_out(spark):
    df = spark.createDataFrame([("a", "x = 1\n" * 10), ("b", "")], "path string, content string")
    good = rows(summarize.refactor(df, lambda p: "```py\n" + p + "\n```", ["path"]), "path", "changed")
    assert good == [("a", True), ("b", True)]
    assert rows(summarize.refactor(df, lambda p: "", ["path"]), "path", "changed") == [("a", False), ("b", False)]
    doc = spark.createDataFrame([(".py", '"""m"""\ndef f(a):\n    """d"""\n', ["f"]), (".py", "def f(): pass", ["f"]), (".py", '"""m"""\n', []), (".js", '"""m"""', [])], "e string, c string, f array<string>")
    assert [r[0] for r in doc.select(summarize.well_documented(F.col("e"), F.col("c"), F.col("f"))).collect()] == [True, False, True, False]


def test_models():
    cheap, premium = {"g": {"report": "c", "traversal": "c", "refactor": "c"}}, {"g": {"report": "p"}}
    assert summarize.model_for("report", "g", cheap, premium, True) == ("g", "p") and summarize.model_for("traversal", "g", cheap, premium, True) == ("g", "c")
    assert summarize.model_for("report", "g", cheap, premium, override="z") == ("g", "z")


def test_complexity(spark):
    assert parse.cyclomatic("py", "def f(a):\n    if a and b:\n        for x in a:\n            pass\n    return [y for y in a]\n") == 5
    assert parse.cyclomatic("py", "def (") == 0 and parse.cyclomatic("js", "function f(a) { if (a && b) { return 1 } }") == 3 and parse.cyclomatic("js", None) == 0
    f = spark.createDataFrame([("a.py", "import os\ndef f():\n    pass\n", 7)], "path string, content string, tokens int")
    assert parse.complexity(parse.parse_files(f, ["path"]), f, ["path"]).first()["complexity"] == 7 + 10 + 5 + 3


def test_external_findings(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"filename": "/s/a.py", "issue_severity": "LOW", "issue_text": "t", "line_number": 3, "code": "c", "test_id": "B1"}, {"filename": "/s/z.py", "issue_severity": "HIGH", "issue_text": "u", "line_number": 4, "code": "c", "test_id": "B2"}]}))
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"path": "/s/a.py", "check_id": "r", "start": {"line": 9}, "extra": {"severity": "ERROR", "message": "m\nmore"}}]}))
    known = spark.createDataFrame([("/s/a.py", "a.py")], "abs_path string, path string")
    b, s = security.read_bandit(spark, str(tmp_path / "b.json"), known), security.read_semgrep(spark, str(tmp_path / "s.json"), "/s")
    assert rows(b, "file", "severity") == [("/s/z.py", "HIGH"), ("a.py", "LOW")] and rows(s, "file", "severity", "issue") == [("a.py", "HIGH", "m")]
    assert security.sections(b, s).count() == 3 and security.by_file(s).first()["section"].startswith("FILE: a.py\nSEVERITY: HIGH")


def test_budgets_roles_and_sections(spark):
    from codeloom.operators import security, summarize
    from codeloom.sources import repo as R

    df = spark.createDataFrame([("a/big-x",), ("other",), ("big-x-0905",)], "model string")
    assert rows(df.select(summarize.safe_budget(F.col("model"), [("big-x", 8000), ("big-x-0905", 1)]))) == [(5000,), (8000,), (8000,)]
    cheap, premium = {"p": {"report": "c1", "traversal": "c2", "refactor": "c3"}}, {"p": {"report": "x1"}}
    assert summarize.model_for("report", "p", cheap, premium) == ("p", "c1") and summarize.model_for("report", "p", cheap, premium, True) == ("p", "x1")
    assert summarize.model_for("traversal", "p", cheap, premium, True) == ("p", "c2") and summarize.model_for("refactor", "p", cheap, premium, override="m") == ("p", "m")
    with pytest.raises(ValueError):
        summarize.model_for("other", "p", cheap, premium)
    one = spark.createDataFrame([("f", "s")], "file string, section string")
    assert rows(security.sections(one, one.where("false"), one)) == [("f", "s", 0), ("f", "s", 2)]
    assert rows(R.visible(spark.createDataFrame([("a.md",), ("meta.json",)], "name string"), ["meta.json"])) == [("a.md",)]


def test_steps_side_by_side(spark):
    from codeloom.operators import summarize as S

    got = S.gather({"a": lambda: spark.range(5).count(), "b": None, "c": lambda: 1 / 0})
    assert got["a"] == 5 and got["b"] is None and isinstance(got["c"], ZeroDivisionError)
    assert S.route("synthesis")[0] == "heavy" and S.key_for("p", {"p": "k"}) == "k"
    for bad in (lambda: S.route("x"), lambda: S.key_for("groq", {})):
        with pytest.raises(ValueError):
            bad()
