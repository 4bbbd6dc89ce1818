"""Graph queries over ``nodes`` and ``links`` and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.paths import slashes
from codeloom.operators import graph as G
from codeloom.operators import reports
from codeloom.operators.batching import first_n, ordered_ranks
from codeloom.session import table


def _nodes(spark, d):
    return G.clean_nodes(table(spark, d, "nodes"))


def _links(spark, d):
    return G.clean_links(table(spark, d, "links"))


def _edges(spark, d):
    return G.directed(_links(spark, d))


def _repo_edges(spark, d):
    return G.directed(G.clean_links(table(spark, d, "links"), ["repo"]), ["repo"])


def _targets(spark, d, most=1):
    """The nodes with most importers of every repository."""
    n = _nodes(spark, d)
    return first_n(G.degrees(n, _edges(spark, d)).join(n.select("id", "repo", "path"), "id"), ["repo"], [F.desc("in_degree"), "id"], most).select("repo", "id", "path")


def graph_links(spark, d):
    return _links(spark, d)


def graph_edges(spark, d):
    return _edges(spark, d)


def edge_first_seen(spark, d):
    p = table(spark, d, "links").withColumn("o", F.struct("loaded_at", "source", "target"))
    return G.first_seen(p, "o").withColumnRenamed("bidirectional", "seen_again")


def edge_strict(spark, d):
    return G.first_seen(table(spark, d, "links").withColumn("o", F.struct("loaded_at", "source", "target")), "o", "strict").withColumnRenamed("bidirectional", "both_ways")


def degrees(spark, d):
    return G.degrees(_nodes(spark, d), _edges(spark, d))


def hubs(spark, d):
    return G.hubs(_nodes(spark, d), _edges(spark, d))


def isolated(spark, d):
    return G.isolated(_nodes(spark, d), _edges(spark, d))


def leaves(spark, d):
    return G.leaves(_nodes(spark, d), _edges(spark, d))


def graph_stats(spark, d):
    return G.graph_stats(_nodes(spark, d), _links(spark, d))


def impact_bfs(spark, d):
    return G.impact(_targets(spark, d), _repo_edges(spark, d), "repo")


def impact_risk(spark, d):
    return G.impact_summary(_targets(spark, d), _nodes(spark, d), _repo_edges(spark, d), "repo")


def impact_affected(spark, d):
    """Affected files with their place in the order of depth and path."""
    n = _nodes(spark, d).select(F.col("id").alias("node"), "path", "tokens", "complexity")
    hit = G.impact(_targets(spark, d), _repo_edges(spark, d), "repo").join(n, "node").withColumn("_by", F.concat(F.format_string("%09d", "depth"), "path"))
    return ordered_ranks(hit, ["origin"], "_by", rank="place").select("origin", "place", "path", "depth", (F.col("depth") == 1).alias("direct"), "tokens", "complexity")


def _analyses(spark, d):
    return table(spark, d, "documents").where("source = 'file_analysis' and text <> ''").select("repo", slashes(F.col("path")).alias("path"), F.col("text").alias("analysis"))


def pr_affected(spark, d):
    """Files downstream of a change to the two most imported files of every repository."""
    return G.changed_impact(_targets(spark, d, 2), _nodes(spark, d), _repo_edges(spark, d))


def pr_context(spark, d):
    c = G.changed_context(_targets(spark, d, 2), _nodes(spark, d), _repo_edges(spark, d), _analyses(spark, d))
    return c.select("repo", "id", "importers", "note", "context")


def pr_report(spark, d):
    changed = _targets(spark, d, 2)
    return reports.impact_report(changed, G.changed_impact(changed, _nodes(spark, d), _repo_edges(spark, d)))


def isolated_head(spark, d):
    return G.isolated_head(_nodes(spark, d), _edges(spark, d))


def forward_reach(spark, d):
    t = _targets(spark, d)
    return G.reach(t.select("repo", F.col("id").alias("origin"), F.col("id").alias("node")), _repo_edges(spark, d), reverse=False, group="repo")


def direct_deps(spark, d):
    return _targets(spark, d).join(_edges(spark, d), F.col("id") == F.col("src")).select("src", "dst")


def reverse_map(spark, d):
    return G.reverse_map(_links(spark, d))


def nodes_in_cycles(spark, d):
    return G.components(_repo_edges(spark, d), "repo").select(F.col("node").alias("id"))


def cycle_count_dfs(spark, d):
    return G.cycle_report(_nodes(spark, d), _links(spark, d))


def link_paths(spark, d):
    return G.link_paths(_links(spark, d), _nodes(spark, d))


def context_boost(spark, d):
    n = _nodes(spark, d).select("id", F.size("functions").cast("double").alias("score"))
    return G.boost(n, _edges(spark, d))


def context_boost_ordered(spark, d):
    n = _nodes(spark, d).select("id", "repo", F.col("id").alias("ord"), F.size("functions").cast("double").alias("score"))
    return G.boost_in_order(n, _links(spark, d))


def fuzzy_match(spark, d):
    return G.fuzzy_path(_nodes(spark, d), "token").select("id", "path")


def node_projection(spark, d):
    return G.node_rows(_nodes(spark, d)).select("id", "path", "name", "top", "depth", "tokens", "complexity")


def complexity_base(spark, d):
    """Base complexity from sizes: tokens + 10 per import + 5 per function."""
    n, e = _nodes(spark, d), _edges(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("imports"))
    return n.join(e, "id", "left").select("id", (F.col("tokens") + 10 * F.coalesce("imports", F.lit(0)) + 5 * F.size("functions")).alias("complexity_base"))


def arch_diff(spark, d):
    """Links known in the first half of the year against all links, by load time."""
    links = table(spark, d, "links").where("source is not null and target is not null")
    mid = F.lit("2025-07-01").cast("timestamp_ntz")
    return G.set_difference(links.where(F.col("loaded_at") < mid), links.where(F.col("loaded_at") >= mid), ["source", "target"])


QUERIES = {f.__name__: f for f in (
    graph_links, graph_edges, edge_first_seen, edge_strict, degrees, hubs, isolated, leaves, graph_stats, impact_bfs, impact_risk, impact_affected, pr_affected, pr_context, pr_report, isolated_head, forward_reach, direct_deps, reverse_map,
    nodes_in_cycles, cycle_count_dfs, link_paths, context_boost, context_boost_ordered, fuzzy_match, node_projection, complexity_base, arch_diff)}

_BASE = """WITH RECURSIVE n AS (
  SELECT id, max(repo) AS repo, max(path) AS path, coalesce(max(tokens), 0) AS tokens, coalesce(max(complexity), 0) AS complexity,
    coalesce(max(len(functions)), 0) AS n_functions FROM nodes WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT source, target, bool_or(coalesce(bidirectional, false)) AS bidirectional FROM links
  WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target GROUP BY source, target),
e AS (SELECT source AS src, target AS dst FROM l UNION SELECT target, source FROM l WHERE bidirectional),
deg AS (SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM n
  LEFT JOIN (SELECT dst, count(*) AS c FROM e GROUP BY dst) i ON i.dst = n.id
  LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY src) o ON o.src = n.id),
t AS (SELECT id FROM (SELECT deg.id, row_number() OVER (PARTITION BY n.repo ORDER BY in_degree DESC, deg.id) AS r FROM deg JOIN n USING (id)) WHERE r = 1)
"""
_WALK = _BASE + """, walk AS (SELECT id AS origin, id AS node, 0 AS depth FROM t
  UNION SELECT w.origin, e.{far}, w.depth + 1 FROM walk w JOIN e ON e.{near} = w.node WHERE w.depth < 60),
hit AS (SELECT origin, node, min(depth) AS depth FROM walk GROUP BY origin, node HAVING node <> origin)
"""
_BACK = _WALK.format(far="src", near="dst")
_PR = _BACK.replace("WHERE r = 1)", "WHERE r <= 2)", 1) + """, hp AS (SELECT hit.origin, n.path FROM hit JOIN n ON n.id = hit.node),
aff AS (SELECT DISTINCT n.repo, n.id, n.path FROM hit JOIN n ON n.id = hit.node WHERE n.id NOT IN (SELECT id FROM t)),
chg AS (SELECT n.repo, n.id, n.path FROM t JOIN n USING (id)), per AS (SELECT repo, count(*) AS c, (SELECT count(*) FROM aff WHERE aff.repo = chg.repo) AS a FROM chg GROUP BY repo)
"""

ORACLES = {
    "graph_links": _BASE + "SELECT * FROM l",
    "graph_edges": _BASE + "SELECT * FROM e",
    "edge_first_seen": """SELECT arg_min(source, k) AS source, arg_min(target, k) AS target, count(*) > 1 AS seen_again
FROM (SELECT source, target, row_number() OVER (ORDER BY loaded_at NULLS FIRST, source, target) AS k FROM links WHERE source <> target)
GROUP BY least(source, target), greatest(source, target)""",
    "edge_strict": """SELECT arg_min(source, k) AS source, arg_min(target, k) AS target, count(DISTINCT source) > 1 AS both_ways
FROM (SELECT source, target, row_number() OVER (ORDER BY loaded_at NULLS FIRST, source, target) AS k FROM links WHERE source <> target)
GROUP BY least(source, target), greatest(source, target)""",
    "degrees": _BASE + "SELECT * FROM deg",
    "hubs": _BASE + "SELECT * FROM (SELECT * FROM deg ORDER BY in_degree DESC, id LIMIT 5) WHERE in_degree > 0",
    "isolated": _BASE + "SELECT id FROM deg WHERE in_degree = 0 AND out_degree = 0",
    "leaves": _BASE + "SELECT id FROM deg WHERE out_degree = 0 AND in_degree > 0",
    "graph_stats": _BASE + """SELECT n.repo, count(*) AS total_files, sum(in_degree) AS degree_sum, sum(in_degree) / greatest(count(*), 1) AS avg_in_degree, sum(tokens) AS total_tokens, sum(complexity) AS total_complexity,
  count(*) FILTER (WHERE in_degree = 0 AND out_degree = 0) AS isolated_count, count(*) FILTER (WHERE out_degree = 0 AND in_degree > 0) AS leaf_count,
  coalesce(any_value(s.c), 0) AS total_edges
FROM deg JOIN n USING (id) LEFT JOIN (SELECT n.repo, count(*) AS c FROM l JOIN n ON n.id = l.source GROUP BY n.repo) s ON s.repo = n.repo GROUP BY n.repo""",
    "impact_bfs": _BACK + "SELECT * FROM hit",
    "pr_affected": _PR + "SELECT * FROM aff",
    "pr_context": _PR + r""", a AS (SELECT repo, replace(path, '\', '/') AS path, max(text) AS text FROM documents WHERE source = 'file_analysis' AND text <> '' GROUP BY 1, 2),
k AS (SELECT origin, count(*) AS c, array_to_string(list_sort(list(path))[1:10], ', ') AS names FROM hp GROUP BY origin),
x AS (SELECT chg.*, coalesce(c, 0) AS importers, CASE WHEN c IS NULL THEN 'none' ELSE names || CASE WHEN c > 10 THEN ' (+' || (c - 10) || ' more)' ELSE '' END END AS note, coalesce(a.text, 'No analysis available.') AS text
  FROM chg LEFT JOIN k ON k.origin = chg.id LEFT JOIN a ON a.repo = chg.repo AND a.path = chg.path)
SELECT repo, id, importers, note, '**' || path || '** (imported by ' || importers || ' file(s): ' || note || ')' || chr(10) || substr(text, 1, 500) AS context FROM x""",
    "pr_report": _PR + """SELECT repo, 0 AS section, 0 AS line_no, '# PR Impact Analysis' AS line FROM per UNION ALL SELECT repo, 0, 1, '**Changed files:** ' || c FROM per UNION ALL SELECT repo, 0, 2, '**Downstream files affected:** ' || a FROM per
UNION ALL SELECT repo, 1, 0, '## Changed Files' FROM per UNION ALL SELECT repo, 2, 0, '## Downstream Impact' FROM per UNION ALL SELECT repo, 2, 1, '_No downstream dependents — isolated change._' FROM per WHERE a = 0
UNION ALL SELECT repo, 1, row_number() OVER (PARTITION BY repo ORDER BY path), '- `' || path || '`' FROM (SELECT DISTINCT repo, path FROM chg)
UNION ALL SELECT repo, 2, row_number() OVER (PARTITION BY repo ORDER BY path), '- `' || path || '`' FROM (SELECT DISTINCT repo, path FROM aff)""",
    "isolated_head": _BASE + "SELECT id FROM deg WHERE in_degree = 0 AND out_degree = 0 ORDER BY id LIMIT 10",
    "impact_affected": _BACK + "SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY depth, path) AS place, path, depth, depth = 1 AS direct, tokens, complexity FROM hit JOIN n ON n.id = hit.node",
    "impact_risk": _BACK + """, agg AS (SELECT t.id AS origin, count(hit.node) FILTER (WHERE depth = 1) AS direct_count, count(hit.node) FILTER (WHERE depth > 1) AS transitive_count, count(hit.node) AS total_affected, coalesce(sum(m.complexity), 0) AS total_complexity
  FROM t LEFT JOIN hit ON hit.origin = t.id LEFT JOIN n m ON m.id = hit.node GROUP BY t.id)
SELECT a.*, deg.out_degree AS direct_deps, CASE WHEN total_affected = 0 THEN 'LOW' WHEN total_affected <= 3 AND (total_complexity + n.complexity) / 100.0 < 5 THEN 'LOW'
  WHEN total_affected <= 10 AND (total_complexity + n.complexity) / 100.0 < 20 THEN 'MEDIUM' ELSE 'HIGH' END AS risk
FROM agg a JOIN n ON n.id = a.origin JOIN deg ON deg.id = a.origin""",
    "forward_reach": _WALK.format(far="dst", near="src") + "SELECT * FROM hit",
    "direct_deps": _BASE + "SELECT src, dst FROM e JOIN t ON t.id = e.src",
    "reverse_map": _BASE + "SELECT DISTINCT target, source AS importer FROM l",
    "nodes_in_cycles": _BASE + """, c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON e.src = c.b) SELECT a AS id FROM c WHERE a = b""",
    "link_paths": _BASE + "SELECT s.path AS source_path, g.path AS target_path, bidirectional FROM l JOIN n s ON s.id = l.source JOIN n g ON g.id = l.target",
    "context_boost": _BASE + """SELECT n.id, CAST(n_functions AS DOUBLE) AS score, n_functions + coalesce(g, 0.0) AS boosted FROM n
LEFT JOIN (SELECT dst, sum(n_functions * 0.25) AS g FROM e JOIN n ON n.id = e.src WHERE n_functions > 1 GROUP BY dst) x ON x.dst = n.id""",
    "context_boost_ordered": _BASE + """, f AS (SELECT repo, id, n_functions, row_number() OVER (PARTITION BY repo ORDER BY id) AS i FROM n),
o AS (SELECT a.repo, a.i, list(b.i) AS tos FROM l JOIN f a ON a.id = l.source JOIN f b ON b.id = l.target AND b.repo = a.repo GROUP BY 1, 2),
g AS (SELECT repo, list(CAST(n_functions AS DOUBLE) ORDER BY i) AS now FROM f GROUP BY repo),
r AS (SELECT repo, CAST(0 AS BIGINT) AS i, now FROM g UNION ALL
  SELECT r.repo, r.i + 1, CASE WHEN r.now[r.i + 1] > 1 AND o.tos IS NOT NULL THEN list_transform(r.now, lambda x, j: x + CASE WHEN list_contains(o.tos, j) THEN r.now[r.i + 1] * 0.25 ELSE 0.0 END) ELSE r.now END
  FROM r LEFT JOIN o ON o.repo = r.repo AND o.i = r.i + 1 WHERE r.i < len(r.now))
SELECT f.repo, f.id, r.now[f.i] AS boosted FROM f JOIN r ON r.repo = f.repo AND r.i = len(r.now)""",
    "cycle_count_dfs": _BASE + """, f AS (SELECT repo, id, path, row_number() OVER (PARTITION BY repo ORDER BY id) AS i FROM n),
dir AS (SELECT l.source AS a, l.target AS b, l.source AS k1, l.target AS k2 FROM l UNION ALL SELECT l.target, l.source, l.source, l.target FROM l WHERE bidirectional),
o AS (SELECT x.repo, x.i, list(y.i ORDER BY k1, k2) AS tos FROM dir JOIN f x ON x.id = dir.a JOIN f y ON y.id = dir.b GROUP BY 1, 2),
g AS (SELECT f.repo, list(coalesce(o.tos, []) ORDER BY f.i) AS adj, list(path ORDER BY f.i) AS names, count(*) AS size FROM f LEFT JOIN o ON o.repo = f.repo AND o.i = f.i GROUP BY f.repo),
r AS (SELECT repo, CAST(0 AS BIGINT) AS step, CAST(1 AS BIGINT) AS root, CAST([] AS BIGINT[]) AS path, CAST([] AS BIGINT[]) AS ptr, list_transform(range(size), lambda x: CAST(0 AS BIGINT)) AS color, CAST(0 AS BIGINT) AS found, CAST([] AS VARCHAR[]) AS shown FROM g
  UNION ALL
  SELECT repo, step + 1, root + CAST(len(path) = 0 AS INT),
    CASE WHEN push > 0 THEN list_append(path, push) WHEN back THEN path[1:len(path) - 1] ELSE path END,
    CASE WHEN len(path) = 0 THEN CASE WHEN push > 0 THEN [CAST(1 AS BIGINT)] ELSE [] END WHEN back THEN ptr[1:len(ptr) - 1]
      ELSE list_concat(ptr[1:len(ptr) - 1], [ptr[len(ptr)] + 1], CASE WHEN push > 0 THEN [CAST(1 AS BIGINT)] ELSE [] END) END,
    CASE WHEN push > 0 THEN list_concat(color[1:push - 1], [CAST(1 AS BIGINT)], color[push + 1:]) WHEN back THEN list_concat(color[1:v - 1], [CAST(2 AS BIGINT)], color[v + 1:]) ELSE color END,
    found + CAST(closes AS INT),
    CASE WHEN closes AND len(shown) < 3 THEN list_append(shown, array_to_string(list_transform(list_append(path[list_position(path, w):], w), lambda x: names[x]), ' → ')) ELSE shown END
  FROM (SELECT *, coalesce(w IS NOT NULL AND color[w] = 1, false) AS closes, CASE WHEN len(path) = 0 THEN CASE WHEN color[root] = 0 THEN root ELSE 0 END WHEN w IS NOT NULL AND color[w] = 0 THEN w ELSE 0 END AS push, len(path) > 0 AND w IS NULL AS back
    FROM (SELECT r.*, g.names, path[len(path)] AS v, CASE WHEN len(path) > 0 THEN g.adj[path[len(path)]][ptr[len(ptr)]] END AS w FROM r JOIN g USING (repo) WHERE len(path) > 0 OR root <= size)))
SELECT repo, arg_max(found, step) AS circular_count, arg_max(shown, step) AS examples FROM r GROUP BY repo""",
    "fuzzy_match": _BASE + "SELECT id, path FROM n WHERE contains(path, 'token') ORDER BY path <> 'token', id LIMIT 1",
    "node_projection": _BASE + """SELECT id, path, string_split(path, '/')[-1] AS name, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END AS top,
  len(string_split(path, '/')) - 1 AS depth, tokens, complexity FROM n""",
    "complexity_base": _BASE + "SELECT n.id, tokens + 10 * out_degree + 5 * n_functions AS complexity_base FROM n JOIN deg USING (id)",
    "arch_diff": """WITH o AS (SELECT DISTINCT source, target FROM links WHERE source IS NOT NULL AND target IS NOT NULL AND loaded_at < TIMESTAMP '2025-07-01'),
w AS (SELECT DISTINCT source, target FROM links WHERE source IS NOT NULL AND target IS NOT NULL AND loaded_at >= TIMESTAMP '2025-07-01')
SELECT *, 'added' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM w)""",
}
