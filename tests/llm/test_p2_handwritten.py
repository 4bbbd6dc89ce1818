import random

import numpy as np

from codeloom.llm import handwritten as H
from tests.conftest import rows

S = "module_id long, repo string, path string, content string, kind string, id string"


def brute_fingerprints(text, gram=H.GRAM, window=H.WINDOW):
    raw = np.frombuffer((text + "\n").encode(), np.uint8)
    _, t = H.token_hashes(raw)
    grams = [int(H.winnow(t[i : i + gram], np.zeros(gram, np.int32), gram, 1)[1][0]) for i in range(len(t) - gram + 1)]
    if not grams:
        return set()
    if len(grams) < window:
        return {min(grams)}
    return {min(grams[i : i + window]) for i in range(len(grams) - window + 1)}


def code(seed, n=120):
    r = random.Random(seed)
    return "\n".join(f"value_{r.randrange(10**6)} = call_{r.randrange(10**6)}({r.randrange(999)}, name)" for _ in range(n))


def test_winnowing_equals_brute_force_and_ignores_layout():
    texts = [code(1, 30), "x", "", code(2, 6), code(3, 40)]
    got = H.fingerprints(texts)
    for t, g in zip(texts, got):
        assert {int(np.uint64(x)) for x in g.view(np.uint64)} == brute_fingerprints(t)
    a, b = H.fingerprints([code(1, 30), code(1, 30).replace(" = ", "   =\n  ")])
    assert set(a) == set(b)


def test_kinds_by_path_and_text():
    k = H.kinds
    assert k("package-lock.json", "{}") == "lock" and k("a/go.sum", "x") == "lock"
    assert k("a.py", "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n") == "generated"
    assert k("a.js", "/*\n * @generated by x from y.idl\n */\nlet a") == "generated"
    assert k("a.py", 'banner = "Code generated by our emitter. DO NOT EDIT."\n') is None
    assert k("a.py", "# The report is generated by the nightly job, edit the template instead.\nx = 1\n") is None
    assert k("a.py", "x = 1\n# TODO: stop copying the vendor list by hand, third_party changes\n") is None
    assert k("vendor\\lib\\a.go", "package a\n") is None and H.supported("vendor\\lib\\a.go", "package a\n")
    assert H.supported(None, "/*\n * foo v1.2.3\n * Permission is hereby granted ...\n */\nx") and not H.supported("src/a.py", "# The vendor table.\nx = 1\n")
    assert k("x/app.js", "function a(b){return b}" * 200) == "minified"
    assert k("x/app.py", "q = '" + "SELECT a b c FROM t WHERE x AND " * 60 + "'\nprint(q)\n") is None
    assert k("t.py", "D = [\n" + "  1, 2, 3, 4, 5,\n" * 80 + "]\n") == "data"
    assert k("t.py", "def f(x):\n    return x\n" * 30 + "ICON = '" + "QUJD" * 80 + "'\n") is None
    assert k(None, "x = 1") is None
    assert k("a_pb.js", "let a = 1\n") == "generated" and k("a.js", "".join(f"function getX{i:03d}() {{ return {i} }}\n" for i in range(1, 30))) == "generated"


def test_copies_need_many_repositories(spark):
    lib, own = code(7), code(8)
    data = [(i, f"r{i}", f"util/x{i}.py", f"# header {i}\n{lib}", "k", "i") for i in range(4)]
    data += [(10, "r1", "a.py", own, None, None), (11, "r1", "b.py", own, None, None), (12, "r2", "a.py", own, None, None)]
    data += [(20, "r1", "c.py", None, None, None), (21, None, None, "", None, None), (22, None, None, code(9), None, None), (0, "r0", "util/x0.py", f"# header 0\n{lib}", "k", "i")]
    got = rows(H.classify(spark.createDataFrame(data, S)))
    assert got == [(0, "copied"), (1, "copied"), (2, "copied"), (3, "copied")]
    assert rows(H.classify(spark.createDataFrame([], S))) == []


def test_long_text_is_read_in_full():
    t = code(5, 60_000)
    assert len(t) > 2 * H.BLOCK
    whole = set(H.fingerprints([t])[0])
    tail = set(H.fingerprints([t[-20_000:]])[0])
    assert len(tail & whole) > 0.9 * len(tail)


def test_repositories_are_counted_exactly(spark):
    same = [r[0] for r in spark.sql("select concat('r', id) from range(2000) where pmod(xxhash64(concat('r', id)), 64) = 5 limit 3").collect()]
    data = [(i, r, f"util/x{i}.py", code(7), "k", "i") for i, r in enumerate(same)]
    assert rows(H.classify(spark.createDataFrame(data, S))) == [(0, "copied"), (1, "copied"), (2, "copied")]
    assert rows(H.classify(spark.createDataFrame(data[:2] + [(5, None, "y.py", code(7), "k", "i")], S))) == [(0, "copied"), (1, "copied"), (5, "copied")]  # a null repository is one of its own
    assert rows(H.classify(spark.createDataFrame(data[:2] + [(5, same[0], "y.py", code(7), "k", "i")], S))) == []


def test_the_whole_head_comment_is_read():
    licence = "".join(f"// line {i} of a licence that goes on and on\n" for i in range(120))
    assert H.kinds("a.go", licence + "\n// Code generated by protoc-gen-go. DO NOT EDIT.\n\npackage a\n") == "generated"
    assert H.supported("a.js", "/*\n" + licence.replace("//", " *").replace("licence", "text") + " */\n\n// vendored from upstream\nlet a = 1\n")
    assert H.kinds("a.go", licence + "\npackage a\nvar x = 1\n// Code generated by protoc-gen-go. DO NOT EDIT.\n") is None
    assert H.kinds("a.py", "'''One line.'''  # note\nx = 1\n# Code generated by y. DO NOT EDIT.\n") is None


def test_small_helpers_are_copies(spark):
    texts = [code(31, 3), code(32, 6), code(33, 9)]
    assert 16 <= min(len(H.token_hashes(np.frombuffer(t.encode(), np.uint8))[0]) for t in texts) < 64
    data = [(10 * k + i, f"r{i}", f"util/x{i}.py", t, "k", "i") for k, t in enumerate(texts) for i in range(3)]
    assert [r[0] for r in rows(H.classify(spark.createDataFrame(data, S)))] == sorted((10 * k + i for k in range(3) for i in range(3)), key=lambda x: repr((x,)))


def test_no_byte_of_a_long_text_is_skipped():
    body = ";".join(code(6, 1).replace(" ", "").replace("_", str(i)) for i in range(150_000))
    assert len(body) > 4 * H.BLOCK and " " not in body
    whole = set(H.fingerprints(["header line\n" + body])[0])
    for part in (body[100_000:200_000], body[3_000_000:3_100_000], body[-100_000:]):
        some = set(H.fingerprints([part])[0])
        assert len(some & whole) > 0.9 * len(some)


def test_fingerprints_judge_vendored_files_too(spark):
    data = [(i, f"r{i}", f"vendor/x{i}.py", code(7), "k", "i") for i in range(3)] + [(9, "r1", "vendor/own.py", code(8), "k", "i")]
    assert rows(H.classify(spark.createDataFrame(data, S))) == [(0, "copied"), (1, "copied"), (2, "copied")]
    tests = "".join(f"def test_{i:03d}():\n    assert {w}(x) == {w!r}\n\n" for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1))
    assert H.kinds("t.py", tests) is None


def test_folders_and_notices_only_support(spark):
    lib, other, own = code(70), code(71), code(72)
    head = "# frob v1.2.3, released under the MIT terms\n"
    data = [(1, "r1", "vendor/frob/a.py", lib, None, None), (2, "r2", "util/a.py", head + lib, None, None), (3, "r3", "vendor/mine/b.py", own, None, None), (4, "r4", "src/c.py", "# copyright of our house\n" + code(73), None, None),
            (5, "r1", "d.py", other, None, None), (6, "r2", "d.py", other, None, None), (7, "r5", "half.py", head + "\n".join(lib.split("\n")[:70]) + "\n" + code(74, 40), None, None)]
    got = rows(H.classify(spark.createDataFrame(data, S)))
    assert got == [(1, "copied"), (2, "copied"), (7, "copied")]  # two repositories and a notice or folder; never these alone, nor two repositories alone


def test_small_files_of_shared_idioms_are_no_copies(spark):
    idioms = [f"import logging\nimport module_{k}\n\nlog = logging.getLogger(__name__)\n\n\ndef main(argv):\n    parser = make_parser(argv, default_{k}, retries, timeout)\n    return run(parser.parse(), log)\n" for k in range(4)]
    mixed = ["\n".join(idioms[(i + j) % 4] for j in range(3)) for i in range(4)]  # every gram recurs, no file does
    data = [(10 * i + r, f"r{i}{r}", f"a{i}.py", mixed[i] + f"\nX{i}{r} = {i * 7 + r}\n", None, None) for i in range(4) for r in range(2)]
    assert all(0 < len(f) < H.FEW for f in H.fingerprints([d[3] for d in data]))
    assert rows(H.classify(spark.createDataFrame(data, S))) == []
    same = [(100 + r, f"r{r}", "b.py", f"# our file {r}\n" + mixed[0], None, None) for r in range(3)]
    assert [r[0] for r in rows(H.classify(spark.createDataFrame(data + same, S)))] == [100, 101, 102]
