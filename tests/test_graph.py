import random

from codeloom.operators import graph as G
from tests.conftest import rows

NODES = [(0, "r", "main.py", 500, ["run", "cli"], None, 100), (1, "r", "config/settings.py", 300, ["get_model"], [], 50), (2, "r", "config/llm_client.py", 800, ["llm_call_async"], ["LLMClient"], 200), (3, "r", "agents/analyst.py", 600, ["analyze_parallel"], [], 150), (4, "r", "agents/parser.py", 400, ["parse_modules"], [], 80)]
N = "id int, repo string, path string, tokens int, functions array<string>, classes array<string>, complexity int"
L = "source int, target int, bidirectional boolean"


def graph(spark, links, nodes=NODES):
    n = G.clean_nodes(spark.createDataFrame(nodes, N))
    l = G.clean_links(spark.createDataFrame(links, L))
    return n, l, G.directed(l)


FIVE = [(0, 1, False), (2, 1, False), (3, 2, None), (3, 4, False), (3, 4, False), (2, 2, False), (1, None, True)]


def test_impact_depth_risk_and_direct_dependencies(spark):
    n, _, e = graph(spark, FIVE)
    assert rows(G.impact(n, e).where("origin = 1")) == [(1, 0, 1), (1, 2, 1), (1, 3, 2)]
    got = {r["origin"]: r for r in G.impact_summary(n, n, e).collect()}
    assert (got[1]["direct_count"], got[1]["transitive_count"], got[1]["total_complexity"], got[1]["risk"]) == (2, 1, 450, "MEDIUM")
    assert (got[0]["total_affected"], got[0]["direct_deps"], got[0]["risk"]) == (0, 1, "LOW")
    assert (got[2]["total_affected"], got[2]["risk"], got[4]["direct_count"], got[4]["risk"], got[3]["direct_deps"]) == (1, "LOW", 1, "LOW", 2)


def test_stats_hubs_leaves_isolated(spark):
    n, l, e = graph(spark, FIVE)
    s = G.graph_stats(n, l).first()
    assert (s["total_files"], s["total_edges"], s["avg_in_degree"], s["total_tokens"], s["total_complexity"], s["isolated_count"]) == (5, 4, 0.8, 2600, 580, 0)
    assert [(r["id"], r["in_degree"]) for r in G.hubs(n, e).collect()] == [(1, 2), (2, 1), (4, 1)]
    assert rows(G.leaves(n, e)) == [(1,), (4,)] and rows(G.isolated(n, e)) == []
    assert G.cycle_report(n, l).first()["circular_count"] == 0


def test_bidirectional_links_expand_both_ways(spark):
    n, l, e = graph(spark, [(0, 1, True)], NODES[:2])
    assert rows(e) == [(0, 1), (1, 0)]
    assert rows(G.impact(n, e)) == [(0, 1, 1), (1, 0, 1)]


def test_cycle_example(spark):
    n, l, e = graph(spark, [(0, 1, False), (1, 0, False)], [(0, "r", "a.py", 1, [], [], 1), (1, "r", "b.py", 1, [], [], 1)])
    r = G.cycle_report(n, l).first()
    assert r["circular_count"] == 1 and r["examples"] == ["a.py → b.py → a.py"]
    assert rows(G.components(e)) == [(0, 1), (1, 1)]


def test_edge_flag_modes(spark):
    p = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (2, 0, 3), (0, 2, 4), (1, 1, 5), (3, 0, 6)], "source int, target int, o int")
    assert rows(G.first_seen(p, "o")) == [(0, 1, True), (2, 0, True), (3, 0, False)]
    assert rows(G.first_seen(p, "o", "strict")) == [(0, 1, False), (2, 0, True), (3, 0, False)]


def test_random_graphs_against_brute_force(spark):
    r = random.Random(5)
    links = [(r.randrange(25), r.randrange(25), r.random() < 0.1) for _ in range(34)]
    nodes = [(i, "r", f"f{i}.py", 1, [], [], 1) for i in range(25)]
    n, l, e = graph(spark, links, nodes)
    out = {}
    for a, b, both in links:
        if a != b:
            out.setdefault(a, set()).add(b)
            if both:
                out.setdefault(b, set()).add(a)
    def closure(s):
        seen, todo = set(), [s]
        while todo:
            for x in out.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen
    reach = {i: closure(i) for i in range(25)}
    assert {r[0] for r in rows(G.components(e))} == {i for i in reach if i in reach[i]}
    t = n.select("id")
    got = {(a, b) for a, b, _ in rows(G.reach(t.selectExpr("id as origin", "id as node"), e, reverse=False))}
    assert got == {(i, j) for i in reach for j in reach[i] if i != j}


def test_boost_modes(spark):
    n, l, e = graph(spark, [(0, 1, False), (1, 2, False)])
    s = spark.createDataFrame([(0, "r", 0, 4.0), (1, "r", 1, 1.0), (2, "r", 2, 0.0)], "id int, repo string, ord int, score double")
    assert rows(G.boost(s, e), "id", "boosted") == [(0, 4.0), (1, 2.0), (2, 0.0)]
    assert rows(G.boost_in_order(s, l), "id", "boosted") == [(0, 4.0), (1, 2.0), (2, 0.5)]


def test_architecture_difference(spark):
    o = spark.createDataFrame([("a", "b")], "s string, t string")
    w = spark.createDataFrame([("b", "c")], "s string, t string")
    assert rows(G.set_difference(o, w, ["s", "t"])) == [("a", "b", "removed"), ("b", "c", "added")]


def test_nulls_and_empty_tables(spark):
    n, l, e = graph(spark, [], [(1, None, None, None, None, None, None), (1, None, None, None, None, None, None), (None, "r", "x", 1, [], [], 1)])
    assert rows(n, "id", "tokens", "functions") == [(1, 0, [])]
    assert rows(G.degrees(n, e)) == [(1, 0, 0)] and rows(G.components(e)) == [] and rows(G.impact(n, e)) == []
    assert G.fuzzy_path(graph(spark, FIVE)[0], "client").first()["id"] == 2
    assert G.node_rows(graph(spark, FIVE)[0]).where("id = 1").first()["top"] == "config"


def test_grouped_searches_equal_the_loops(spark, monkeypatch):
    r = random.Random(8)
    links = [(20 * g + r.randrange(20), 20 * g + r.randrange(20), r.random() < 0.1, f"r{g}") for g in range(4) for _ in range(26)]
    e = G.directed(G.clean_links(spark.createDataFrame(links, L + ", repo string"), ["repo"]), ["repo"]).cache()
    seeds = spark.createDataFrame([(i, i, f"r{i // 20}") for i in range(0, 80, 3)] + [(1, 2, "r0"), (900, 900, "r9")], "origin int, node int, repo string")
    plain = e.select("src", "dst")
    for most in (None, 2):
        want = rows(G.reach(seeds.drop("repo"), plain, most=most))
        assert rows(G.reach(seeds, e, most=most, group="repo")) == want and len(want) > 20
    assert rows(G.components(e, "repo")) == rows(G.components(plain))
    monkeypatch.setattr(G, "GROUP_EDGES", 24)  # some groups are now too large for a task
    assert rows(G.reach(seeds, e, group="repo")) == rows(G.reach(seeds.drop("repo"), plain))
    assert rows(G.components(e, "repo")) == rows(G.components(plain))
    none = e.where("false")
    assert rows(G.reach(seeds, none, group="repo")) == [] and rows(G.components(none, "repo")) == [] and rows(G.reach(seeds.where("false"), e, group="repo")) == []
    e.unpersist()


def test_a_long_path_needs_no_recursion():
    a = G.np.arange(200_000)
    node, name = G.strong_components(a, G.np.r_[a[1:], 5])
    assert len(node) == 200_000 - 5 and set(name.tolist()) == {199_999}
    o, n, d = G.walk_breadth_first(G.np.array([7]), G.np.array([0]), a[:3000], a[:3000] + 1)
    assert d.tolist() == list(range(1, 3001)) and n.tolist() == d.tolist() and set(o.tolist()) == {7}


def test_change_sets(spark):
    n, l, e = graph(spark, FIVE)
    edges = e.withColumn("repo", G.F.lit("r"))
    changed = n.where("id in (1, 2)").select("repo", "id", "path")
    assert rows(G.changed_impact(changed, n, edges)) == [("r", 0, "main.py"), ("r", 3, "agents/analyst.py")]
    a = spark.createDataFrame([("r", "config/settings.py", "x" * 600)], "repo string, path string, analysis string")
    got = {x["id"]: x for x in G.changed_context(changed, n, edges, a, importers=2).collect()}
    assert got[1]["note"] == "agents/analyst.py, config/llm_client.py (+1 more)" and got[1]["context"] == "**config/settings.py** (imported by 3 file(s): agents/analyst.py, config/llm_client.py (+1 more))\n" + "x" * 500
    assert got[2]["context"] == "**config/llm_client.py** (imported by 1 file(s): agents/analyst.py)\nNo analysis available."
    from codeloom.operators.reports import impact_report

    lines = [x["line"] for x in impact_report(changed, G.changed_impact(changed, n, edges)).orderBy("section", "line_no").collect()]
    assert lines == ["# PR Impact Analysis", "**Changed files:** 2", "**Downstream files affected:** 2", "## Changed Files", "- `config/llm_client.py`", "- `config/settings.py`", "## Downstream Impact", "- `agents/analyst.py`", "- `main.py`"]
    alone = n.where("id = 0").select("repo", "id", "path")
    assert "_No downstream dependents — isolated change._" in [x["line"] for x in impact_report(alone, G.changed_impact(alone, n, edges)).collect()]


def test_ranks_in_two_levels(spark):
    from codeloom.operators.batching import chunks, first_n, ordered_ranks

    r = random.Random(2)
    data = [(r.choice("ab"), r.choice(["", "x", "xy", "x" * 30, "é", "~"]) + str(r.randrange(30)) * r.randrange(3), i) for i in range(200)] + [("a", None, 500)]
    df = spark.createDataFrame(data, "g string, t string, i int")
    got = {x["i"]: x["rank"] for x in ordered_ranks(df, ["g"], "t", ["i"], prefix=2).collect()}
    for g in "ab":
        order = sorted((x for x in data if x[0] == g), key=lambda x: ((x[1] is not None), (x[1] or "").encode(), x[2]))
        assert [got[x[2]] for x in order] == list(range(1, len(order) + 1))
    assert max(x["chunk"] for x in chunks(df, 10, ["g"], ["t", "i"]).collect()) == (max(sum(x[0] == g for x in data) for g in "ab") - 1) // 10
    assert sorted(x["i"] for x in first_n(df, ["g"], ["i"], 3, salts=2).collect()) == sorted(i for g in "ab" for i in sorted(x[2] for x in data if x[0] == g)[:3])
