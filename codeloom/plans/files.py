"""Queries over ``modules``, ``nodes``, ``documents`` and ``embeddings`` and their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import scoring as S
from codeloom.functions import text as T
from codeloom.operators import batching, bpe, cache, context, parse, reports, search, security, summarize, symbols
from codeloom.operators.graph import clean_links, clean_nodes, degrees, directed, first_seen
from codeloom.plans import files_sql
from codeloom.session import spread, table
from codeloom.sources import repo as R



def _modules(spark, d):
    """One row per (repo, path): the file delivered last, with its size counted from the content."""
    m = table(spark, d, "modules").withColumn("path", P.slashes(F.col("path")))
    m = cache.latest(m.select("repo", "path", "module_id", "content", "content_hash", "loaded_at"), ["repo", "path"], ["loaded_at", "module_id"])
    return m.withColumns({"tokens": T.token_estimate(F.col("content")), "content": F.coalesce("content", F.lit(""))})


def _docs(spark, d):
    return table(spark, d, "documents")


def scan_filter(spark, d):
    m = _modules(spark, d)
    return m.where(~P.ignored_dir(F.col("path")) & ~P.suffix(F.col("path")).isin(P.IGNORE_EXTENSIONS) & (F.octet_length("content") <= P.MAX_FILE_SIZE_BYTES) & (F.col("tokens") <= P.MAX_FILE_TOKENS)).select("repo", "path", "tokens")


def code_files(spark, d):
    m = _modules(spark, d)
    return m.where(P.splitext(F.col("path")).isin(P.CODE_EXTENSIONS)).select("module_id", P.suffix(F.col("path")).alias("suffix"), P.splitext(F.col("path")).alias("splitext"), P.after_last_dot(F.col("path")).alias("last_dot"))


def token_totals(spark, d):
    return _modules(spark, d).groupBy("repo").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), S.size_class(F.sum("tokens")).alias("size_class"))


def content_hash_dedup(spark, d):
    return _docs(spark, d).where("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def _cache(spark, d):
    """Cached analyses: those of files delivered up to September 2025, under the hash on record; some are empty."""
    return table(spark, d, "modules").where("loaded_at < '2025-09-01' and content_hash is not null").groupBy(P.slashes(F.col("path")).alias("file_path"), "content_hash").agg(F.max("tokens").alias("tokens"), F.max(F.when(F.col("module_id") % 3 == 0, "").otherwise(F.concat(F.lit("seen "), F.col("module_id")))).alias("analysis"))


def cache_lookup(spark, d):
    files = table(spark, d, "modules").select("module_id", P.slashes(F.col("path")).alias("file_path"), "content_hash")
    return cache.look_up(files, _cache(spark, d)).select("module_id", "analysis", "hit")


def cache_upsert(spark, d):
    new = table(spark, d, "modules").where("loaded_at >= '2025-09-01' and content_hash is not null").groupBy(P.slashes(F.col("path")).alias("file_path"), "content_hash").agg(F.max(F.length("content")).cast("int").alias("tokens"))
    return cache.upsert(_cache(spark, d), new, ["tokens"])


def cache_latest(spark, d):
    return cache.latest(table(spark, d, "modules").select("repo", P.slashes(F.col("path")).alias("path"), "module_id", "loaded_at"), ["repo", "path"], ["loaded_at", "module_id"]).select("repo", "path", "module_id")


def path_roles(spark, d):
    p = F.col("path")
    return _modules(spark, d).select("module_id", P.is_test_file(p).alias("is_test"), P.is_analysis_target(p).alias("is_target"), P.is_audited(p, F.col("content")).alias("is_audited"), P.import_path(p).alias("import_path"))


def file_tier(spark, d):
    m = _modules(spark, d)
    return m.select("module_id", S.file_tier(P.after_last_dot(F.col("path")), F.col("tokens")).alias("tier"), S.out_tokens(F.col("tokens")).alias("out_tokens"), S.refactor_budget(F.col("tokens")).alias("refactor_budget"))


def refactor_eligible(spark, d):
    m = _modules(spark, d)
    return m.where(P.suffix(F.col("path")).isin(".py", ".js", ".ts", ".tsx", ".go", ".rs", ".java", ".rb") & F.col("tokens").between(1, 5500) & (F.length(F.trim("content")) > 0)).select("module_id", "tokens")


def refactor_batches(spark, d):
    """Greedy batches of eligible files per repository: at most 1500 tokens and six files."""
    m = refactor_eligible(spark, d).join(_modules(spark, d).select("module_id", "repo", "path"), "module_id")
    return batching.greedy_batches(m, 1500, ["repo"], ["path"]).groupBy("repo", "batch").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


def chunk_batches(spark, d):
    return batching.chunks(_modules(spark, d).select("repo", "path", "module_id"), 10, ["repo"], ["path"]).select("module_id", "chunk")


def merge_refactored(spark, d):
    """The trees with blank contents replaced by a marker, others kept."""
    m = _modules(spark, d)
    changed = m.where(F.length(F.trim("content")) == 0).select("repo", "path", F.lit("# empty").alias("content"))
    return R.clone_with(m.select("repo", "path", "content"), changed, ["repo"]).select("repo", "path", F.length("content").alias("chars"))


def _definitions(spark, d):
    n = clean_nodes(table(spark, d, "nodes"))
    return parse.definitions(n.select("repo", "path", "functions", "classes"), ["repo", "path"])


def _texts(spark, d):
    return _modules(spark, d).select("repo", "path", "content")


def symbol_refs(spark, d):
    """In how many other files of its repository each defined symbol is mentioned, and how often."""
    idx = symbols.token_index(_texts(spark, d), ["repo", "path"])
    defs = _definitions(spark, d).select("repo", "path", "symbol").distinct()
    return symbols.references(defs, idx, ["repo"]).where("path <> in_path").groupBy("repo", "path", "symbol").agg(F.count("*").alias("files"), F.sum("n").alias("mentions"))


def dead_symbols(spark, d):
    return symbols.dead_symbols(_definitions(spark, d), _texts(spark, d), ["repo"])


def dead_totals(spark, d):
    defined = _definitions(spark, d).where(P.is_analysis_target(F.col("path"))).groupBy("repo").agg(F.count_distinct("path", "symbol").alias("defined"))
    return defined.join(dead_symbols(spark, d).groupBy("repo").agg(F.count("*").alias("dead")), "repo", "left").na.fill(0)


def coverage_gap(spark, d):
    return symbols.coverage(_definitions(spark, d), _texts(spark, d), ["repo"])


def coverage_pct(spark, d):
    return symbols.coverage_totals(coverage_gap(spark, d), ["repo"])


def _parsed(spark, d):
    return parse.parse_files(_modules(spark, d), ["repo", "path", "module_id"])


def parse_structure(spark, d):
    p = _parsed(spark, d)
    return p.select("module_id", F.size("functions").alias("functions"), F.size("classes").alias("classes"), F.size("imports").alias("imports"), F.size(F.flatten(F.map_values("calls"))).alias("calls"))


def coverage_with_calls(spark, d):
    p = _parsed(spark, d)
    return symbols.coverage(parse.definitions(p, ["repo", "path"]), _texts(spark, d), ["repo"], parse.call_pairs(p, ["repo"]))


def python_imports(spark, d):
    """Modules named by the import lines of Python files, by expression alone."""
    m = _modules(spark, d).where(P.suffix(F.col("path")) == ".py")
    lines = m.select("module_id", F.explode(F.split("content", "\r?\n")).alias("line"))
    return lines.where(F.col("line").rlike(r"^(import|from) [\w.]+")).select("module_id", T.python_import(F.col("line")).alias("module")).where("module is not null").distinct()


TASK = "load voucher cache"


def context_projection(spark, d):
    """Entries of the context index: the first 1500 characters of each file as its snippet."""
    return _indexed(spark, d).select("id", F.length("snippet").alias("chars"), F.sha2("snippet", 256).alias("snippet_hash"))


def _indexed(spark, d):
    """Nodes with the snippets of their files (empty where a node has no file)."""
    n = clean_nodes(table(spark, d, "nodes"))
    return n.join(_texts(spark, d).select("repo", "path", context.snippet(F.col("content")).alias("snippet")), ["repo", "path"], "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def context_score(spark, d):
    k = context.keyword_score(TASK, F.col("snippet"))
    return _indexed(spark, d).select("id", k["score"].alias("score"), k["reasons"].alias("reasons"))


def context_budget(spark, d):
    k = context.keyword_score(TASK, F.col("snippet"))
    return context.within_budget(_indexed(spark, d).select("id", "path", F.col("id").alias("ord"), "tokens", k["score"].alias("score")), 8000).select("id", "rank", "score", "cost")


def context_ranked(spark, d):
    """Keyword score plus centrality, within the budget, with scaled snippets and each file's share of the tokens."""
    n = _indexed(spark, d)
    deg = degrees(n, directed(clean_links(table(spark, d, "links")))).select("id", "in_degree")
    k = context.keyword_score(TASK, F.col("snippet"))
    s = context.with_filters(n, ["py", ".js"]).join(deg, "id").select("id", F.col("id").alias("ord"), "tokens", "snippet", F.round(k["score"] + context.centrality(F.col("in_degree")), 9).alias("score"))
    return context.fit_snippets(context.within_budget(s, 6000), 6000).select("id", "rank", "cost", "tokens_share", F.length("snippet").alias("snippet_chars"))


def tokens_share(spark, d):
    t = _modules(spark, d).groupBy("repo").agg(F.sum("tokens").alias("tokens"))
    return t.select("repo", (F.col("tokens") / t.agg(F.sum("tokens")).scalar()).alias("share"))


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return search.top_k(e, q, 8).select("vec_id")


def vector_topk_batch(spark, d):
    e = table(spark, d, "embeddings")
    return search.top_k_of(e.where("vec_id % 100 = 0"), e, 8).select("query_id", "vec_id", "rank")


def token_counts(spark, d):
    """Tokens of every file by a public vocabulary."""
    return bpe.count_tokens(spread(_modules(spark, d).select("module_id", "content")), text="content")


def semantic_search(spark, d):
    """The documents nearest to a question, by the local embedding."""
    docs = _docs(spark, d).where("source = 'file_analysis' and text <> ''").select("doc_id", "text")
    return search.semantic_search(search.embed(spread(docs), "text"), "which module loads the voucher cache", id_col="doc_id").select("doc_id", F.round("similarity", 6).alias("similarity"))


def embed_documents(spark, d):
    """Documents for embedding: path and analysis, cut at 8000 characters, with capped symbol lists."""
    n = clean_nodes(table(spark, d, "nodes"))
    a = _docs(spark, d).where("source = 'file_analysis' and text <> ''").select("repo", P.slashes(F.col("path")).alias("path"), "doc_id", F.col("text").alias("analysis"))
    doc = search.embed_document()
    return a.join(n, ["repo", "path"]).select("doc_id", F.length(doc).alias("chars"), search.excerpt(doc).alias("excerpt"), search.csv_head(F.col("functions"), 20).alias("functions"), search.csv_head(F.col("classes"), 10).alias("classes"), "complexity")


def answer_quality(spark, d):
    n = clean_nodes(table(spark, d, "nodes"))
    a = _docs(spark, d).where("source = 'file_analysis'").select("repo", P.slashes(F.col("path")).alias("path"), "doc_id", "text")
    q = S.answer_quality(F.col("text"), F.col("functions"), F.col("classes"), F.col("tokens"))
    return a.join(n, ["repo", "path"]).select("doc_id", F.round(q, 6).alias("quality"), (q < 0.35).alias("again"))


def think_strip(spark, d):
    t = F.concat(F.lit("a<THINK>x\ny</think> "), F.col("text"), F.lit(" <think>open"))
    return _docs(spark, d).select("doc_id", F.length(T.strip_think(t)).alias("chars"))


def fence_strip(spark, d):
    t = F.concat(F.lit("```python\n"), F.regexp_replace("text", "\r", ""), F.lit("\n```"))
    return _docs(spark, d).where("text is not null").select("doc_id", (T.strip_fences(t) == F.regexp_replace("text", "\r", "")).alias("same"))


def marker_blocks(spark, d):
    t = F.concat(F.lit("[FILE: a.py]\n"), F.col("text"), F.lit("\n[END]\nnoise [FILE: b.py] x [END]"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(T.marked_blocks(t)).alias("blocks"), T.marked_blocks(t)[1]["name"].alias("second"))


def md_line_class(spark, d):
    lines = _docs(spark, d).where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(T.markdown_class(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"), F.sum(F.length(T.strip_inline(F.col("line")))).alias("chars"))


def url_parse(spark, d):
    u = F.concat(F.lit("https://www.github.com/"), F.col("repo"), F.when(F.col("module_id") % 2 == 0, ".git").otherwise(""))
    r = P.repo_of_url(u)
    return table(spark, d, "modules").select("module_id", r["clean_url"].alias("clean_url"), r["repo"].alias("name"), P.url_key(u).alias("url_key"))


def url_redact(spark, d):
    u = F.concat(F.lit("see https://tok@host/"), F.col("path"), F.lit(" and http://a:b@c/d"))
    return table(spark, d, "modules").select("module_id", P.redact_url(u).alias("text"))


def chain_parse(spark, d):
    c = F.concat_ws(",", F.concat(F.lit("groq:"), F.col("branch"), F.lit(":k:1")), F.lit("bad"), F.lit("other:m:k"), F.lit(" gemini : m2 : k2 "))
    return table(spark, d, "snapshots").select("snapshot_id", F.size(T.parse_chain(c)).alias("n"), T.parse_chain(c)[0]["key"].alias("first_key"), T.parse_chain(c)[1]["model"].alias("second_model")).distinct()


def provider_of(spark, d):
    m = F.when(F.col("source").startswith("read"), "gemini-x").when(F.col("source").startswith("chat"), "nvidia/y").otherwise(F.col("source"))
    return _docs(spark, d).groupBy(T.provider_of(m).alias("provider")).agg(F.count("*").alias("n"))


def severity_lines(spark, d):
    """Severities named in texts."""
    s = _docs(spark, d).where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b(HIGH|MEDIUM|LOW|ERROR|WARNING|INFO)\b"), F.lit(1))).alias("label"))
    return s.groupBy(S.severity(F.col("label")).alias("severity")).agg(F.count("*").alias("n"))


def node_substring(spark, d):
    return clean_nodes(table(spark, d, "nodes")).where(F.contains(F.lower("path"), F.lit("cache"))).select("id", "path")


def repo_json(spark, d):
    return reports.combined_map(_modules(spark, d).select("repo", "path", "tokens"))


def dead_report(spark, d):
    return reports.dead_code_report(dead_symbols(spark, d))


def gap_report(spark, d):
    return reports.gap_report(coverage_gap(spark, d))


def analysis_prompts(spark, d):
    """Prompts over whole files with the import statements found by pattern."""
    n = clean_nodes(table(spark, d, "nodes")).drop("tokens")
    imports = F.when(P.suffix(F.col("path")) == ".py", T.import_lines(F.col("content"))).otherwise(F.array().cast("array<string>"))
    p = reports.analysis_prompt(F.col("path"), F.col("tokens"), F.col("functions"), F.col("classes"), imports, F.col("content"))
    return n.join(_modules(spark, d).select("repo", "path", "content", "tokens"), ["repo", "path"]).select("id", F.length(p).alias("chars"), F.sha2(p, 256).alias("prompt_hash"))


def repo_snapshot(spark, d):
    """A snapshot row per repository from the current nodes and links."""
    from codeloom.operators.graph import link_paths

    n = clean_nodes(table(spark, d, "nodes"))
    links = clean_links(table(spark, d, "links"))
    lp = links.join(n.select(F.col("id").alias("source"), "repo", F.col("path").alias("source_path")), "source").join(n.select(F.col("id").alias("target"), F.col("path").alias("target_path")), "target")
    s = R.snapshot_of(n, lp, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return s.select("repo", "timestamp", F.size("files").alias("files"), F.size("links").alias("links"))


def complexity_heatmap(spark, d):
    m = _modules(spark, d)
    return parse.complexity(parse.parse_files(m, ["module_id"]), m, ["module_id"])


def parsed_import_links(spark, d):
    """Import edges of each repository, resolved from its own parsed sources."""
    p = _parsed(spark, d)
    n = p.select("repo", "path", F.col("module_id").alias("id"))
    return parse.import_links(parse.resolve_imports(p, n, ["repo"]), n, ["repo"])


def _import_texts(spark, d):
    """The import statements that the links of the dependency graph stand for, one list per source file.

    Python files import by dotted name, scripts by relative path; links between other files, and to Python files whose path is no dotted name, have none.
    """
    n = clean_nodes(table(spark, d, "nodes")).select("id", "repo", "path")
    l = table(spark, d, "links").where("target is not null").groupBy("source", "target").agg(F.min("loaded_at").alias("at"))
    both = l.join(n.select(F.col("id").alias("source"), "repo", "path"), "source").join(n.select(F.col("id").alias("target"), F.col("path").alias("to")), "target")
    dotted = F.when(F.col("path").rlike(r"\.py$") & F.col("to").rlike(r"^[A-Za-z_]\w*(/[A-Za-z_]\w*)*\.py$"), F.concat(F.lit("from "), F.replace(F.regexp_replace("to", r"\.py$", ""), F.lit("/"), F.lit(".")), F.lit(" import x")))
    up = F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 1)
    script = F.when(F.col("path").rlike(r"\.(js|ts)$") & F.col("to").rlike(r"\.(js|ts)$"), F.concat(F.lit("import x from './"), up, "to", F.lit("'")))
    stmt = both.withColumn("stmt", F.coalesce(dotted, script)).where("stmt is not null")
    lists = stmt.groupBy("repo", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "target", "stmt"))), lambda s: s["stmt"]).alias("imports"))  # as many as the file has imports
    return lists, n


def import_resolve(spark, d):
    """The files that the import statements of each file name."""
    lists, n = _import_texts(spark, d)
    return parse.resolve_imports(lists, n, ["repo"]).select("repo", "path", "target").distinct()


def import_graph(spark, d):
    """The dependency graph built from import statements, one link per pair of files in the direction seen first."""
    lists, n = _import_texts(spark, d)
    links = parse.import_links(parse.resolve_imports(lists, n, ["repo"]), n, ["repo"])
    return first_seen(links.withColumn("o", F.struct("source", "position", "target")), "o").withColumnRenamed("bidirectional", "seen_again")


def dead_symbols_parsed(spark, d):
    """Dead symbols of the parsed sources themselves; callees and exported names are alive."""
    p = _parsed(spark, d)
    callees = parse.call_pairs(p, ["repo"]).select("repo", F.col("callee").alias("symbol")).distinct()
    exports = p.select("repo", F.explode("exports").alias("symbol")).distinct()
    return symbols.dead_symbols(parse.definitions(p, ["repo", "path"]), _texts(spark, d), ["repo"], callees, exports)


def _to_analyse(spark, d):
    n = clean_nodes(table(spark, d, "nodes")).select("repo", "path", "functions", "classes")
    f = n.join(_modules(spark, d).select("repo", "path", "tokens", "content", "content_hash"), ["repo", "path"])
    imports = F.when(P.suffix(F.col("path")) == ".py", T.import_lines(F.col("content"))).otherwise(F.array().cast("array<string>"))
    return f.withColumn("prompt", reports.analysis_prompt(F.col("path"), F.col("tokens"), F.col("functions"), F.col("classes"), imports, F.col("content")))


def file_analyses(spark, d):
    """Analyses by content hash where a document has one, else by the stub model, poor ones asked again."""
    f = _to_analyse(spark, d)
    seen = _docs(spark, d).where("source = 'file_analysis'").select("repo", P.slashes(F.col("path")).alias("path"), F.col("text").alias("analysis")).join(f.select("repo", "path", "content_hash"), ["repo", "path"])
    return summarize.analyse(f, seen.select("content_hash", "analysis")).select("repo", "path", "from_cache", F.round("quality", 6).alias("quality"))


def repo_synthesis(spark, d):
    a = _docs(spark, d).where("source = 'file_analysis' and text is not null").select("repo", F.concat("path", F.lit("#"), "doc_id").alias("path"), F.col("text").alias("analysis"))
    return summarize.synthesis(a).select("repo", "batches")


def well_documented(spark, d):
    """Whether each file is documented well enough to be left as it is."""
    n = clean_nodes(table(spark, d, "nodes")).join(_texts(spark, d), ["repo", "path"])
    return n.select("id", summarize.well_documented(P.suffix(F.col("path")), F.col("content"), F.col("functions")).alias("documented"))


def refactor_split(spark, d):
    """Files to rewrite one by one and files left as they are, per repository."""
    n = clean_nodes(table(spark, d, "nodes")).drop("tokens").join(_modules(spark, d).select("repo", "path", "content", "tokens"), ["repo", "path"])
    ok = summarize.well_documented(P.suffix(F.col("path")), F.col("content"), F.col("functions"))
    return n.groupBy("repo").agg(F.count_if(ok).alias("left"), F.count_if(~ok & F.col("tokens").between(1, 5500)).alias("to_rewrite"))


def refactor_prompts(spark, d):
    """Batch prompts of the files that are rewritten in batches, per repository."""
    n = clean_nodes(table(spark, d, "nodes")).drop("tokens").join(_modules(spark, d).select("repo", "path", "content", "tokens"), ["repo", "path"])
    ways = summarize.refactor_ways(n.where("tokens between 1 and 5500"))
    return summarize.batch_prompts(ways.where("way = 'batch'"), ["repo"]).select("repo", "batch", F.length("prompt").alias("chars"))


def audit_prompts(spark, d):
    p = security.audit_prompts(_texts(spark, d))
    return p.select("repo", "batch", "files", F.sha2("prompt", 256).alias("prompt_hash"))


def change_scopes(spark, d):
    """Size class of each repository's last day of deliveries."""
    m = table(spark, d, "modules").where("loaded_at is not null").select("repo", "path", F.to_date("loaded_at").alias("day"))
    last = m.groupBy("repo").agg(F.max("day").alias("day"))
    n = m.join(last, ["repo", "day"]).groupBy("repo").agg(F.count_distinct(P.slashes(F.col("path"))).alias("files"))
    return n.select("repo", "files", S.change_scope(F.col("files")).alias("scope"))


def model_budgets(spark, d):
    """Tokens a minute per model name, by the first limit whose name it contains; the sources stand for models."""
    m = F.coalesce("source", F.lit("none"))
    return _docs(spark, d).select(m.alias("model")).distinct().select("model", summarize.safe_budget(F.col("model"), [("comment", 8000), ("chat", 6000), ("file", 5500)]).alias("budget"))


def module_extensions(spark, d):
    """Files per extension: the one on record in one spelling, else the suffix of the path."""
    m = table(spark, d, "modules")
    return m.groupBy(P.module_extension(F.col("ext"), P.slashes(F.col("path"))).alias("extension")).agg(F.count("*").alias("files"))


def node_positions(spark, d):
    """Positional ids of a repository's files in the order of their paths."""
    m = _modules(spark, d).select("repo", "path", "module_id")
    return batching.ordered_ranks(m, ["repo"], "path", rank="pos").select("module_id", (F.col("pos") - 1).alias("pos"))


def labels(spark, d):
    """Display classes of complexity, token budgets and counts."""
    n = clean_nodes(table(spark, d, "nodes"))
    return n.select("id", S.complexity_class(F.col("complexity")).alias("complexity_class"), S.budget_label(F.col("tokens") * 40).alias("budget"), S.k_format(F.col("tokens")).alias("tokens"))


def scaffold_prompts(spark, d):
    s = summarize.scaffold_prompts(coverage_gap(spark, d), _texts(spark, d), ["repo", "path"])
    return s.groupBy("repo", summarize.scaffold_name(F.col("path")).alias("name")).agg(F.count("*").alias("files"), F.max("path").alias("last"))


def executive_report(spark, d):
    n = clean_nodes(table(spark, d, "nodes"))
    links = clean_links(table(spark, d, "links")).join(n.select(F.col("id").alias("source"), "repo"), "source")
    return summarize.executive(n, links)


def tail_lines(spark, d):
    """The last 200 lines of the longest text of each source."""
    t = _docs(spark, d).where("source is not null and text is not null").groupBy("source").agg(F.max_by("text", F.struct(F.length("text"), F.col("doc_id"))).alias("text"))
    lines = F.split("text", "\n")
    return t.select("source", F.size(lines).alias("lines"), F.sha2(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 199, F.lit(1)), F.lit(200)), "\n"), 256).alias("tail_hash"))


QUERIES = {f.__name__: f for f in (
    scan_filter, code_files, token_totals, content_hash_dedup, cache_lookup, cache_upsert, cache_latest, path_roles, file_tier, refactor_eligible, refactor_batches, chunk_batches, merge_refactored, symbol_refs,
    dead_symbols, dead_totals, coverage_gap, coverage_pct, parse_structure, coverage_with_calls, python_imports, context_projection, context_score, context_budget, context_ranked, tokens_share, vector_topk, vector_topk_batch,
    token_counts, semantic_search, embed_documents, answer_quality, think_strip, fence_strip, marker_blocks, md_line_class, url_parse, url_redact, chain_parse, provider_of, severity_lines, node_substring, repo_json, dead_report, gap_report, analysis_prompts, repo_snapshot,
    complexity_heatmap, import_resolve, import_graph, parsed_import_links, dead_symbols_parsed, file_analyses, repo_synthesis, well_documented, refactor_split, refactor_prompts, audit_prompts, change_scopes, model_budgets, module_extensions, node_positions, labels, scaffold_prompts, executive_report, tail_lines)}
ORACLES = files_sql.ORACLES
