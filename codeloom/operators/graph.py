"""Dependency-graph operators on node and link tables.

Links are stored once with a ``bidirectional`` flag; ``directed`` expands them to plain edges. All operators work on
many repositories at once: node ids are global, so nothing joins across repositories.

Searches know two ways. Given a ``group`` (the repository, which no edge leaves), a group of up to ``GROUP_EDGES`` edges is walked in one
task by a linear-time search, after a single shuffle. Larger groups, and edges without a group, take frontier loops that extend
only new (origin, node) pairs and cut lineage with a reliable checkpoint each round; their number of rounds is the depth of the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.batching import first_n
from codeloom.session import cut

#: Edges of a group, and (origin, edge) pairs of its searches, up to which one task walks it.
GROUP_EDGES = 5_000_000
GROUP_PAIRS = 20_000_000


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id; of repeated rows the largest by value stays. Null numbers count 0, null lists are empty."""
    cols = [c for c in nodes.columns if c != "id"]
    one = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct(*cols)).alias("s")).select("id", "s.*")
    fix = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("tokens", "complexity") if c in cols}
    fix |= {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("functions", "classes") if c in cols}
    return one.withColumns(fix)


def clean_links(links: DataFrame, keep: list[str] = []) -> DataFrame:
    """Distinct (source, target) without self loops and open ends; the flag is true if any repetition says so."""
    return (
        links.where("source is not null and target is not null and source <> target")
        .groupBy("source", "target").agg(F.max(F.coalesce("bidirectional", F.lit(False))).alias("bidirectional"), *[F.max(c).alias(c) for c in keep])
    )


def directed(links: DataFrame, keep: list[str] = []) -> DataFrame:
    """Distinct directed edges (src, dst): every link, and its reverse where it is bidirectional."""
    both = F.when(F.col("bidirectional"), F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst"))))
    one = F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")))
    edges = links.select(F.explode(F.coalesce(both, one)).alias("e"), *keep).select("e.src", "e.dst", *keep).where("src <> dst")
    return edges.groupBy("src", "dst").agg(*[F.max(c).alias(c) for c in keep]) if keep else edges.distinct()


def first_seen(pairs: DataFrame, order: str, mode: str = "compat") -> DataFrame:
    """Collapse (source, target, ``order``) rows to one link per unordered pair in the direction seen first.

    ``compat``: bidirectional as soon as the pair is resolved a second time, in whichever direction;
    ``strict``: only if both directions occur.
    """
    p = pairs.where("source is not null and target is not null and source <> target")
    key = [F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")]
    again = F.count("*") > 1 if mode == "compat" else F.count_distinct("source") > 1
    return p.groupBy(*key).agg(F.min_by(F.struct("source", "target"), order).alias("f"), again.alias("bidirectional")).select("f.source", "f.target", "bidirectional")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node, one shuffle of the edges' ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").join(d, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes imported most (limit first, then in_degree > 0), ties by id."""
    return degrees(nodes, edges).orderBy(F.desc("in_degree"), "id").limit(k).where("in_degree > 0")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that import nothing but are imported."""
    return degrees(nodes, edges).where("out_degree = 0 and in_degree > 0").select("id")


def large_groups(edges: DataFrame, group: str, seeds: DataFrame | None = None) -> DataFrame:
    """The groups that are too large for a task."""
    sizes = edges.groupBy(group).agg(F.count("*").alias("n"))
    if seeds is None:
        return sizes.where(F.col("n") > GROUP_EDGES).select(group)
    both = sizes.join(seeds.groupBy(group).agg(F.count("*").alias("m")), group)
    return both.where((F.col("n") > GROUP_EDGES) | (F.col("n") * F.col("m") > GROUP_PAIRS)).select(group)


def _sorted_edges(tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, heads): the nodes' ids and their edges, node after node, heads as positions in ids."""
    ids, at = np.unique(np.concatenate([tail, head]), return_inverse=True)
    a, b = at[: len(tail)], at[len(tail) :]
    order = np.argsort(a, kind="stable")
    return ids, np.r_[0, np.cumsum(np.bincount(a, minlength=len(ids)))], b[order]


def walk_breadth_first(origins: np.ndarray, starts: np.ndarray, tail: np.ndarray, head: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(origin, node, depth) of all nodes that a search along tail -> head reaches, without the starts of its own origin."""
    ids, offsets, heads = _sorted_edges(tail, head)
    out: list[tuple] = []
    order = np.argsort(origins, kind="stable")
    origins, starts = origins[order], starts[order]
    cuts = np.flatnonzero(np.r_[True, origins[1:] != origins[:-1], True]) if len(origins) else [0]
    seen = np.full(len(ids), -1, np.int64)
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        at = np.searchsorted(ids, starts[lo:hi])
        front = np.unique(at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == starts[lo:hi])]) if len(ids) else np.empty(0, np.int64)
        seen[front] = k
        depth = 0
        while len(front) and (most is None or depth < most):
            depth += 1
            n = offsets[front + 1] - offsets[front]
            nxt = heads[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[front], n)]
            front = np.unique(nxt[seen[nxt] != k])
            seen[front] = k
            out.append((np.full(len(front), origins[lo]), ids[front], np.full(len(front), depth)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def reach(seeds: DataFrame, edges: DataFrame, reverse: bool = True, most: int | None = None, group: str | None = None) -> DataFrame:
    """Breadth-first search from many origins: (origin, node, depth) without the origins themselves.

    ``seeds`` has (origin, node); ``reverse`` follows edges from target to source (who depends on it). With ``group``, a column of both sides,
    groups that are small enough are each searched in a task.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    if group:
        types = dict(seeds.dtypes)
        seeds = cut(seeds.select(group, "origin", "node"))
        large = large_groups(edges, group, seeds)
        some = not large.isEmpty()
        large = cut(large) if some else None
        rest = lambda df: df.join(large, group, "left_anti") if some else df

        def search(s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            o, n, d = walk_breadth_first(s["origin"].to_numpy(), s["node"].to_numpy(), e[a].to_numpy(), e[b].to_numpy(), most)
            if not len(o):
                return pd.DataFrame({"origin": s["origin"].iloc[:0], "node": s["node"].iloc[:0], "depth": pd.Series([], dtype="int32")})
            return pd.DataFrame({"origin": o, "node": n, "depth": d})

        small = rest(seeds).groupBy(group).cogroup(rest(edges).groupBy(group)).applyInPandas(search, f"origin {types['origin']}, node {types['node']}, depth int")
        if not some:
            return small
        return small.unionByName(reach(seeds.join(large, group, "left_semi"), edges.join(large, group, "left_semi"), reverse, most))
    step = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")))
    frontier = cut(seeds.select("origin", "node", F.lit(0).alias("depth")).distinct())
    seen = frontier
    depth = 0
    while most is None or depth < most:
        depth += 1
        new = (
            frontier.join(step, "node").select("origin", F.col("next").alias("node")).distinct()
            .join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth))
        )
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen.where("depth > 0")


def impact(targets: DataFrame, edges: DataFrame, group: str | None = None) -> DataFrame:
    """Transitive dependents of each target id with their shortest depth: (origin, node, depth)."""
    return reach(targets.select(F.col("id").alias("origin"), F.col("id").alias("node"), *([group] if group else [])), edges, group=group)


def risk(affected: F.Column, complexity: F.Column) -> F.Column:
    """Blast-radius class from the number of affected files and their complexity in hundreds (fixed thresholds)."""
    cx = complexity / 100.0
    return F.when(affected == 0, "LOW").when((affected <= 3) & (cx < 5), "LOW").when((affected <= 10) & (cx < 20), "MEDIUM").otherwise("HIGH")


def impact_summary(targets: DataFrame, nodes: DataFrame, edges: DataFrame, group: str | None = None) -> DataFrame:
    """One row per target: direct, transitive and total dependents, their complexity, number of direct imports, risk."""
    hit = impact(targets, edges, group).join(nodes.select(F.col("id").alias("node"), "complexity"), "node").groupBy("origin").agg(
        F.count_if(F.col("depth") == 1).alias("direct_count"), F.count_if(F.col("depth") > 1).alias("transitive_count"), F.count("*").alias("total_affected"), F.sum("complexity").alias("total_complexity"))
    deps = edges.groupBy(F.col("src").alias("origin")).agg(F.count("*").alias("direct_deps"))
    base = targets.select("id").join(nodes.select("id", "complexity"), "id").select(F.col("id").alias("origin"), "complexity")
    full = base.join(hit, "origin", "left").join(deps, "origin", "left").na.fill(0)
    return full.select("origin", "direct_count", "transitive_count", "total_affected", "total_complexity", "direct_deps", risk(F.col("total_affected"), F.col("total_complexity") + F.col("complexity")).alias("risk"))


def reverse_map(links: DataFrame) -> DataFrame:
    """One level only and blind to the flag: (target, importer) as distinct rows, for targets of any number of importers."""
    return links.select("target", F.col("source").alias("importer")).distinct()


def changed_context(changed: DataFrame, nodes: DataFrame, edges: DataFrame, analyses: DataFrame, group: str = "repo", importers: int = 10, excerpt: int = 500) -> DataFrame:
    """(group, id, path, importers, note, context): each changed file with its transitive importers and the start of its analysis.

    ``changed`` has (group, id, path), ``analyses`` (group, path, analysis). The note names the first importers by path and how many more there are.
    """
    hit = impact(changed, edges, group).join(nodes.select(F.col("id").alias("node"), F.col("path").alias("importer")), "node")
    count = hit.groupBy("origin").agg(F.count("*").alias("importers"))
    first = first_n(hit.select("origin", "importer"), ["origin"], ["importer"], importers).groupBy("origin").agg(F.sort_array(F.collect_list("importer")).alias("names"))  # at most ``importers`` each
    n = F.coalesce("importers", F.lit(0))
    more = F.when(n > importers, F.concat(F.lit(" (+"), (n - importers).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    note = F.when(n == 0, "none").otherwise(F.concat(F.array_join("names", ", "), more))
    text = F.coalesce("analysis", F.lit("No analysis available."))
    one = analyses.groupBy(group, "path").agg(F.max("analysis").alias("analysis"))
    out = changed.join(count, changed["id"] == count["origin"], "left").drop("origin").join(first.withColumnRenamed("origin", "_o"), F.col("id") == F.col("_o"), "left").join(one, [group, "path"], "left")
    return out.select(group, "id", "path", n.alias("importers"), note.alias("note"), F.concat(F.lit("**"), "path", F.lit("** (imported by "), n.cast("string"), F.lit(" file(s): "), note, F.lit(")\n"), F.substring(text, 1, excerpt)).alias("context"))


def changed_impact(changed: DataFrame, nodes: DataFrame, edges: DataFrame, group: str = "repo") -> DataFrame:
    """(group, id, path) of the files that depend on a changed one, themselves not changed, each once."""
    hit = impact(changed, edges, group).select(F.col("node").alias("id")).distinct().join(changed.select("id"), "id", "left_anti")
    return hit.join(nodes.select("id", group, "path"), "id").select(group, "id", "path")


def isolated_head(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """The first isolated nodes by id."""
    return isolated(nodes, edges).orderBy("id").limit(n)


def trim(edges: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle: ends without incoming or without outgoing edges, repeatedly."""
    e = cut(edges)
    n = e.count()
    while n:
        kept = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = kept.count()
        if m == n:
            return kept
        e, n = kept, m
    return e


def _push(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """Hand the larger colour on along the edges: (node, c, before)."""
    own = colour.select("node", "c", F.col("c").alias("before"))
    pushed = edges.join(colour.select("node", "c"), F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "c", F.lit(None).cast("int").alias("before"))
    return own.unionByName(pushed).groupBy("node").agg(F.max("c").alias("c"), F.max("before").alias("before"))


def strong_components(tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of the strongly connected components of two nodes and more, in linear time and without recursion; a component is named by its largest node."""
    ids, offsets, heads = _sorted_edges(tail, head)
    n, offsets, heads = len(ids), offsets.tolist(), heads.tolist()
    number, low, held = [0] * n, [0] * n, [False] * n
    nxt = offsets[:-1]
    stack: list[int] = []
    count, nodes, names = 0, [], []
    for root in range(n):
        if number[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not number[v]:
                count += 1
                number[v] = low[v] = count
                stack.append(v)
                held[v] = True
            while nxt[v] < offsets[v + 1]:
                w = heads[nxt[v]]
                nxt[v] += 1
                if not number[w]:
                    path.append(w)
                    break
                if held[w] and number[w] < low[v]:
                    low[v] = number[w]
            else:
                path.pop()
                if path and low[v] < low[path[-1]]:
                    low[path[-1]] = low[v]
                if low[v] == number[v]:
                    k = len(stack)
                    while True:
                        k -= 1
                        held[stack[k]] = False
                        if stack[k] == v:
                            break
                    if len(stack) - k > 1:
                        nodes += stack[k:]
                        names += [max(stack[k:])] * (len(stack) - k)
                    del stack[k:]
    return ids[np.array(nodes, np.int64)], ids[np.array(names, np.int64)]


def components(edges: DataFrame, group: str | None = None) -> DataFrame:
    """Strongly connected components with at least two nodes: (node, component); with ``group``, groups that are small enough take one task each.

    Larger ones take colouring: the largest id that reaches a node is its colour; the nodes that reach their colour's root backwards within
    the colour are the root's component. They are taken out, the rest is trimmed, and so on.
    """
    if group:
        large, kind = large_groups(edges, group), dict(edges.dtypes)["src"]
        some = not large.isEmpty()
        large = cut(large) if some else None

        def search(e: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(("node", "component"), strong_components(e["src"].to_numpy(), e["dst"].to_numpy()))))

        small = (edges.join(large, group, "left_anti") if some else edges).groupBy(group).applyInPandas(search, f"node {kind}, component {kind}")
        return small if not some else small.unionByName(components(edges.join(large, group, "left_semi").select("src", "dst")))
    left, done = trim(edges.select("src", "dst")), None
    while not left.isEmpty():
        colour = cut(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            nxt = cut(_push(colour, left))
            colour = nxt.select("node", "c")
            if nxt.where("c <> before").isEmpty():
                break
        inner = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst")
        roots = colour.where("node = c").select(F.col("c").alias("origin"), "node")
        found = cut(reach(roots, inner).select("node", F.col("origin").alias("component")).unionByName(roots.select("node", F.col("origin").alias("component"))))
        members = found.join(found.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("node", "component")
        done = members if done is None else done.unionByName(members)
        gone = found.select("node")
        left = trim(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return done if done is not None else edges.sparkSession.createDataFrame([], "node int, component int")


def cycle_report(nodes: DataFrame, links: DataFrame, group: str = "repo", examples: int = 3) -> DataFrame:
    """Depth-first back edges per group in stored order: (group, circular_count, examples).

    This count depends on the visiting order by definition, so a group's graph is walked in one task; the order-free form
    is ``components``. A group is one repository's graph.
    """
    order = nodes.select(F.col(group), F.col("id"), F.col("path")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("id", "path"))).alias("nodes"))
    edges = links.join(nodes.select(F.col("id").alias("source"), group), "source").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("source", "target", "bidirectional"))).alias("links"))
    both = order.join(edges, group, "left")
    kind = dict(nodes.dtypes)[group]

    def walk(batches):
        for b in batches:
            rows = []
            for g, ns, ls in zip(b[group], b["nodes"], b["links"]):
                path_of = {n["id"]: n["path"] for n in ns}
                out: dict[int, list[int]] = {}
                for e in ls if ls is not None else []:
                    out.setdefault(e["source"], []).append(e["target"])
                    if e["bidirectional"]:
                        out.setdefault(e["target"], []).append(e["source"])
                rows.append((g, *back_edges(list(path_of), out, path_of, examples)))
            yield pd.DataFrame(rows, columns=[group, "circular_count", "examples"])

    return both.mapInPandas(walk, f"`{group}` {kind}, circular_count long, examples array<string>")


def back_edges(order: list[int], out: dict[int, list[int]], name: dict[int, str], examples: int) -> tuple[int, list[str]]:
    """Edges into the current depth-first path, without recursion."""
    state: dict[int, int] = {}
    found, shown = 0, []
    for root in order:
        if root in state:
            continue
        state[root] = 1
        path, todo = [root], [iter(out.get(root, ()))]
        while todo:
            for nxt in todo[-1]:
                s = state.get(nxt, 0)
                if s == 1:
                    found += 1
                    if len(shown) < examples:
                        loop = [*path[path.index(nxt) :], nxt]
                        shown.append(" → ".join(str(name.get(x, x)) for x in loop))
                elif s == 0:
                    state[nxt] = 1
                    path.append(nxt)
                    todo.append(iter(out.get(nxt, ())))
                    break
            else:
                state[path.pop()] = 2
                todo.pop()
    return found, shown


def graph_stats(nodes: DataFrame, links: DataFrame, group: str = "repo") -> DataFrame:
    """Totals per group: files, edges, degree sum per file, tokens, complexity, isolated, leaves."""
    edges = directed(links)
    d = degrees(nodes, edges).join(nodes.select("id", group, "tokens", "complexity"), "id")
    per = d.groupBy(group).agg(
        F.count("*").alias("total_files"), F.sum("in_degree").alias("degree_sum"), (F.sum("in_degree") / F.greatest(F.count("*"), F.lit(1))).alias("avg_in_degree"),
        F.sum("tokens").alias("total_tokens"), F.sum("complexity").alias("total_complexity"),
        F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("isolated_count"), F.count_if((F.col("out_degree") == 0) & (F.col("in_degree") > 0)).alias("leaf_count"))
    stored = links.join(nodes.select(F.col("id").alias("source"), group), "source").groupBy(group).agg(F.count("*").alias("total_edges"))
    return per.join(stored, group, "left").na.fill(0, ["total_edges"])


def link_paths(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links as paths of both ends."""
    n = nodes.select("id", "path")
    return links.join(n.select(F.col("id").alias("source"), F.col("path").alias("source_path")), "source").join(n.select(F.col("id").alias("target"), F.col("path").alias("target_path")), "target").select("source_path", "target_path", "bidirectional")


def boost(scores: DataFrame, edges: DataFrame, share: float = 0.25, above: float = 1.0) -> DataFrame:
    """One hop: every file with a score above ``above`` passes ``share`` of it to each file it imports: (id, score, boosted)."""
    gain = scores.where(F.col("score") > above).join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * share).alias("gain"))
    return scores.join(gain, F.col("id") == F.col("dst"), "left").select("id", "score", (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("boosted"))


def boost_in_order(scores: DataFrame, links: DataFrame, group: str = "repo", share: float = 0.25, above: float = 1.0) -> DataFrame:
    """The order-dependent form: scores raised earlier in the list pass on their raised value. One task per group."""
    have = scores.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("ord", "id", "score"))).alias("files"))
    edge = links.join(scores.select(F.col("id").alias("source"), group), "source").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("links"))
    kind = dict(scores.dtypes)[group]

    def fold(batches):
        for b in batches:
            rows = []
            for g, fs, ls in zip(b[group], b["files"], b["links"]):
                now = {f["id"]: f["score"] for f in fs}
                out: dict = {}
                for e in ls if ls is not None else []:
                    out.setdefault(e["source"], []).append(e["target"])
                for f in fs:
                    if now[f["id"]] > above:
                        for t in out.get(f["id"], ()):
                            if t in now:
                                now[t] += now[f["id"]] * share
                rows += [(g, i, s) for i, s in now.items()]
            yield pd.DataFrame(rows, columns=[group, "id", "boosted"])

    return have.join(edge, group, "left").mapInPandas(fold, f"`{group}` {kind}, id int, boosted double")


def fuzzy_path(nodes: DataFrame, query: str) -> DataFrame:
    """The first node (by id) whose path holds the query text, an exact match before all others."""
    return nodes.where(F.contains("path", F.lit(query))).orderBy(F.col("path") != query, "id").limit(1)


def set_difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, change) added to or removed from a set; one shuffle per side."""
    a, b = new.select(*key).distinct(), old.select(*key).distinct()
    added = a.join(b, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("removed")))


def node_rows(files: DataFrame) -> DataFrame:
    """Node projection of code files: name, top directory, directory depth."""
    segs = F.split("path", "/")
    return files.withColumns({"name": F.element_at(segs, -1), "top": F.when(F.size(segs) > 1, F.element_at(segs, 1)).otherwise(F.lit("root")), "depth": F.size(segs) - 1})
