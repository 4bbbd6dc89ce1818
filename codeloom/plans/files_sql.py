"""Oracle SQL of the file queries."""

from __future__ import annotations

_M = r"""WITH m AS (
  SELECT repo, replace(path, '\', '/') AS path, arg_max(module_id, k) AS module_id, coalesce(list(content ORDER BY k DESC)[1], '') AS content,
    coalesce(length(list(content ORDER BY k DESC)[1]), 0) // 4 AS tokens
  FROM (SELECT *, row_number() OVER (ORDER BY loaded_at NULLS FIRST, module_id) AS k FROM modules) GROUP BY 1, 2),
x AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM m),
y AS (SELECT *, lower(regexp_extract(name, '[^.](\.[^.]+)$', 1)) AS suffix, lower(regexp_extract(regexp_replace(name, '^\.+', ''), '.(\.[^.]*)$', 1)) AS splitext,
  CASE WHEN contains(path, '.') THEN '.' || lower(string_split(path, '.')[-1]) ELSE '' END AS last_dot FROM x)
"""
_N = """, n AS (SELECT id, max(repo) AS repo, max(path) AS path, coalesce(max(tokens), 0) AS tokens, coalesce(max(complexity), 0) AS complexity,
  coalesce(max(functions), []) AS functions, coalesce(max(classes), []) AS classes FROM nodes WHERE id IS NOT NULL GROUP BY id)
"""
_DEF = _N + """, defs AS (SELECT repo, path, 'function' AS kind, unnest(functions) AS symbol FROM n UNION ALL SELECT repo, path, 'class', unnest(classes) FROM n),
tok AS (SELECT repo, path, token, count(*) AS n FROM (SELECT repo, path, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}_]+')) AS token FROM m) GROUP BY ALL)
"""
_TEST = r"(^|[/\\])(test_|_test\.|tests?[/\\]).*\.(py|js|ts)$"
_NOT = r"(^|[/\\])(test_|_test\.|tests?[/\\]|tests_generated[/\\]|docs[/\\])"
_DEAD = _DEF + rf""", todo AS (SELECT DISTINCT repo, path, kind, symbol FROM defs WHERE NOT regexp_matches(path, '{_NOT}') AND NOT starts_with(symbol, '_')),
odd AS (SELECT t.*, m.path AS in_path, len(string_split(m.content, t.symbol)) - 1 AS n FROM todo t JOIN m ON m.repo = t.repo AND contains(m.content, t.symbol) WHERE NOT regexp_full_match(t.symbol, '[\p{{L}}\p{{N}}_]+')),
seen AS (SELECT t.*, tok.path AS in_path, tok.n FROM todo t JOIN tok ON tok.repo = t.repo AND tok.token = t.symbol UNION ALL SELECT * FROM odd),
cnt AS (SELECT repo, path, kind, symbol, bool_or(in_path <> path) AS elsewhere, sum(CASE WHEN in_path = path THEN n ELSE 0 END) AS own FROM seen GROUP BY ALL),
dc AS (SELECT repo, path, symbol, count(*) AS defs FROM (SELECT repo, path, unnest(regexp_extract_all(content, '\b(?:def|class)\s+([\p{{L}}\p{{N}}_]+)', 1)) AS symbol FROM m) GROUP BY ALL),
fw AS (SELECT DISTINCT repo, path, regexp_extract(b, '\b(?:def|class)\s+([\p{{L}}\p{{N}}_]+)$', 1) AS symbol FROM (SELECT repo, path, unnest(regexp_extract_all(content, '((?:[^\n]*\n){{0,3}}?[^\n]*\b(?:def|class)\s+[\p{{L}}\p{{N}}_]+)', 1)) AS b FROM m)
  WHERE regexp_matches(b, '@(app|router|blueprint|celery|pytest|signal|admin)\.|@(staticmethod|classmethod|property|overload|abstractmethod)|urlpatterns|admin\.register')),
dead AS (SELECT t.* FROM todo t LEFT JOIN cnt USING (repo, path, kind, symbol) LEFT JOIN dc USING (repo, path, symbol)
  WHERE NOT coalesce(elsewhere, false) AND coalesce(own, 0) <= coalesce(defs, 0) AND (t.repo, t.path, t.symbol) NOT IN (SELECT (repo, path, symbol) FROM fw))
"""
_COV = _DEF + rf""", fns AS (SELECT repo, path, symbol AS fn FROM defs WHERE kind = 'function' AND NOT starts_with(symbol, '_') AND NOT regexp_matches(path, '{_TEST}')),
cov AS (SELECT repo, path, fn, CASE WHEN (repo, fn) IN (SELECT (repo, token) FROM tok WHERE regexp_matches(path, '{_TEST}')) THEN 'covered' ELSE 'gap' END AS status FROM fns)
"""
_DIRS = "'node_modules','.git','__pycache__','.venv','venv','dist','build','.next','coverage','.pytest_cache','docs','tests_generated'"
_EXT = "'.png','.jpg','.jpeg','.gif','.svg','.ico','.woff','.woff2','.ttf','.eot','.mp4','.mp3','.zip','.tar','.gz','.lock','.bin','.exe','.pyc','.docx','.xlsx','.pdf','.env','.db'"
_CODE = "'.py','.js','.mjs','.cjs','.ts','.tsx','.go','.rs','.java','.rb','.c','.cpp','.cc','.h','.hpp','.cs','.swift','.kt','.scala','.php'"
_SCORE = _M + _N + """, w AS (SELECT id, n.tokens, path, coalesce(substr(m.content, 1, 1500), '') AS snippet, list_distinct(list_filter(regexp_split_to_array(trim(lower(translate(path, '/_.', '   ') || ' ' || replace(array_to_string(functions, ' '), '_', ' ') || ' ' || replace(array_to_string(classes, ' '), '_', ' '))), '\\s+'), lambda s: s <> '')) AS sym FROM n LEFT JOIN m USING (repo, path)),
s AS (SELECT *, list_filter(['cache', 'load', 'voucher'], lambda t: list_contains(sym, t)) AS exact, list_filter(['cache', 'load', 'voucher'], lambda t: NOT list_contains(sym, t) AND len(list_filter(sym, lambda q: contains(t, q) OR contains(q, t))) > 0) AS part,
  list_filter(['load voucher', 'voucher cache'], lambda p: contains(lower(path) || ' ' || lower(snippet), p)) AS phrase, list_filter(['cache', 'load', 'voucher'], lambda t: NOT list_contains(sym, t) AND contains(lower(snippet), t)) AS snip FROM w),
sc AS (SELECT id, tokens, path, snippet, 3.0 * len(exact) + 0.5 * len(part) + 2.0 * len(phrase) + 1.0 * len(snip) AS score,
  list_concat(list_sort(exact), list_sort(phrase)[1:2], list_sort(list_filter(snip, lambda t: NOT list_contains(part, t)))[1:2]) AS reasons FROM s)
"""
_CACHE = _M + r""", c AS (SELECT replace(path, '\', '/') AS file_path, content_hash, max(tokens) AS tokens, max(CASE WHEN module_id % 3 = 0 THEN '' ELSE 'seen ' || module_id END) AS analysis
  FROM modules WHERE loaded_at < TIMESTAMP '2025-09-01' AND content_hash IS NOT NULL GROUP BY 1, 2)
"""
_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
_ANALYSES = _M + _N + r""", a AS (SELECT doc_id, text, n.*, 'File: ' || n.path || chr(10) || chr(10) || text AS full_doc FROM documents d JOIN n ON n.repo = d.repo AND n.path = replace(d.path, '\', '/') WHERE source = 'file_analysis')
"""
_PROMPTS = r""", prompts AS (SELECT n.id, repo, path, functions, classes, m.tokens, content_hash, '### ' || path || ' (' || m.tokens || ' tokens)' || chr(10) || 'fn: ' || CASE WHEN len(functions) > 0 THEN array_to_string(functions[1:6], ', ') ELSE 'none' END || ' | cls: '
  || CASE WHEN len(classes) > 0 THEN array_to_string(classes[1:4], ', ') ELSE 'none' END || ' | imports: ' || CASE WHEN len(imports) > 0 THEN array_to_string(imports[1:5], ', ') ELSE 'none' END || chr(10) || '```' || chr(10) || regexp_replace(content, '^\s+|\s+$', '', 'g') || chr(10) || '```' AS p
FROM n JOIN (SELECT *, CASE WHEN regexp_matches(path, '(?i)[^./][.]py$') THEN list_transform(regexp_extract_all(content, '(?m)^[ \t]*((?:import|from)[ \t][^\r\n]+)', 1), lambda s: rtrim(s, ' ')) ELSE [] END AS imports FROM m) m USING (repo, path)
  JOIN (SELECT module_id, content_hash FROM modules) h USING (module_id))
"""
_DOCUMENTED = r""", f AS (SELECT n.id, n.repo, m.tokens AS size, regexp_matches(path, '[^./][.]py$') AS py, regexp_matches(ltrim(content, ' '), '^\s*("{3}|\x27{3})') AS doc, functions,
  regexp_extract_all(content, '(?s)def\s+(\w+)\s*\([^)]*\)[^:\n]*:\s*\n\s*(?:"{3}|\x27{3})', 1) AS with_doc FROM n JOIN m USING (repo, path)),
w AS (SELECT id, repo, size, py AND doc AND (len(functions) = 0 OR CAST(len(list_filter(functions, lambda x: list_contains(with_doc, x))) AS DOUBLE) / greatest(len(functions), 1) >= 0.7) AS documented FROM f)
"""
_IMPORTED = r""", l AS (SELECT source, target, min(loaded_at) AS first_at FROM links WHERE target IS NOT NULL GROUP BY 1, 2),
b AS (SELECT l.*, s.repo, s.path, t.path AS "to" FROM l JOIN n s ON s.id = l.source JOIN n t ON t.id = l.target),
i AS (SELECT * FROM b WHERE regexp_matches(path, '\.py$') AND regexp_matches("to", '^[A-Za-z_]\w*(/[A-Za-z_]\w*)*\.py$') OR regexp_matches(path, '\.(js|ts)$') AND regexp_matches("to", '\.(js|ts)$'))
"""

ORACLES = {
    "scan_filter": _M + f"SELECT repo, path, tokens FROM y WHERE len(list_filter(string_split(path, '/')[:-2], lambda s: s IN ({_DIRS}) OR starts_with(s, '.'))) = 0 AND suffix NOT IN ({_EXT}) AND strlen(content) <= 1000000 AND tokens <= 50000",
    "code_files": _M + f"SELECT module_id, suffix, splitext, last_dot FROM y WHERE splitext IN ({_CODE})",
    "token_totals": _M + "SELECT repo, count(*) AS files, sum(tokens) AS tokens, CASE WHEN sum(tokens) >= 50000 THEN 'large' ELSE 'standard' END AS size_class FROM m GROUP BY repo",
    "content_hash_dedup": "SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "cache_lookup": _CACHE + r"SELECT module_id, c.analysis, coalesce(length(c.analysis) > 0, false) AS hit FROM modules f LEFT JOIN c ON c.file_path = replace(f.path, '\', '/') AND c.content_hash = f.content_hash",
    "cache_upsert": _CACHE + r""", u AS (SELECT replace(path, '\', '/') AS file_path, content_hash, max(length(content)) AS tokens FROM modules WHERE loaded_at >= TIMESTAMP '2025-09-01' AND content_hash IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(u.file_path, c.file_path) AS file_path, coalesce(u.content_hash, c.content_hash) AS content_hash, coalesce(u.tokens, c.tokens) AS tokens, c.analysis FROM c FULL JOIN u ON c.file_path = u.file_path AND c.content_hash = u.content_hash""",
    "cache_latest": _M + "SELECT repo, path, module_id FROM m",
    "path_roles": _M + rf"""SELECT module_id, regexp_matches(path, '{_TEST}') AS is_test, NOT regexp_matches(path, '{_NOT}') AS is_target,
  length(trim(content, ' ')) > 0 AND NOT (contains(path, 'test') OR contains(path, 'docs') OR contains(path, '_refactored') OR contains(path, 'tests_generated')) AS is_audited, regexp_replace(replace(path, '/', '.'), '\.py$', '') AS import_path FROM m""",
    "file_tier": _M + """SELECT module_id, CASE WHEN last_dot IN ('.md', '.txt', '.rst', '.pdf', '.docx', '.log', '.yml', '.yaml', '.toml', '.cfg', '.ini', '.conf', '.env', '.env.example', '.properties', '.sh', '.bash', '.zsh', '.fish', '.bat', '.cmd', '.ps1', '.html', '.htm', '.css', '.scss', '.sass', '.less', '.json', '.xml', '.csv', '.tsv', '.sql', '.gitignore', '.gitattributes', '.editorconfig', '.dockerignore', '.mailmap', '.npmrc', '.yarnrc', '.license', '.changelog', '.makefile') THEN 'tier0' WHEN tokens < 500 THEN 'tier1' WHEN tokens < 3000 THEN 'tier2' WHEN tokens < 8000 THEN 'tier3' ELSE 'tier4' END AS tier,
  CASE WHEN tokens < 300 THEN 512 WHEN tokens < 1000 THEN 768 ELSE 1024 END AS out_tokens, least(CAST(floor(tokens * 1.5) AS INT) + 512, 8192) AS refactor_budget FROM y""",
    "refactor_eligible": _M + "SELECT module_id, tokens FROM y WHERE suffix IN ('.py', '.js', '.ts', '.tsx', '.go', '.rs', '.java', '.rb') AND tokens BETWEEN 1 AND 5500 AND length(trim(content, ' ')) > 0",
    "chunk_batches": _M + "SELECT module_id, (row_number() OVER (PARTITION BY repo ORDER BY path) - 1) // 10 AS chunk FROM m",
    "merge_refactored": _M + "SELECT repo, path, CASE WHEN length(trim(content, ' ')) = 0 THEN 7 ELSE length(content) END AS chars FROM m",
    "symbol_refs": _M + _DEF + "SELECT d.repo, d.path, d.symbol, count(*) AS files, sum(tok.n) AS mentions FROM (SELECT DISTINCT repo, path, symbol FROM defs WHERE regexp_full_match(symbol, '[\\p{L}\\p{N}_]+')) d JOIN tok ON tok.repo = d.repo AND tok.token = d.symbol AND tok.path <> d.path GROUP BY ALL",
    "dead_symbols": _M + _DEAD + "SELECT * FROM dead",
    "dead_totals": _M + _DEAD + f"SELECT d.repo, d.defined, coalesce(x.dead, 0) AS dead FROM (SELECT repo, count(DISTINCT (path, symbol)) AS defined FROM defs WHERE NOT regexp_matches(path, '{_NOT}') GROUP BY repo) d LEFT JOIN (SELECT repo, count(*) AS dead FROM dead GROUP BY repo) x ON x.repo = d.repo",
    "dead_report": _M + _DEAD + "SELECT DISTINCT repo, CAST(0 AS BIGINT) AS line_no, '## ' || 'Dead symbols in ' || repo AS line FROM dead UNION ALL SELECT repo, 1 + row_number() OVER (PARTITION BY repo ORDER BY '`' || symbol || '` in ' || path), '- ' || '`' || symbol || '` in ' || path FROM dead",
    "coverage_gap": _M + _COV + "SELECT * FROM cov",
    "coverage_pct": _M + _COV + "SELECT repo, count(*) AS total, count(*) FILTER (WHERE status = 'covered') AS covered, 0 AS indirect, count(*) FILTER (WHERE status = 'gap') AS gaps, CAST(floor(CAST(count(*) FILTER (WHERE status = 'covered') AS DOUBLE) / count(*) * 100) AS INT) AS pct FROM cov GROUP BY repo",
    "gap_report": _M + _COV + "SELECT DISTINCT repo, CAST(0 AS BIGINT) AS line_no, '## ' || 'Untested in ' || repo AS line FROM (SELECT * FROM cov WHERE status = 'gap') UNION ALL SELECT repo, 1 + row_number() OVER (PARTITION BY repo ORDER BY path || ': `' || fn || '`'), '- ' || path || ': `' || fn || '`' FROM (SELECT * FROM cov WHERE status = 'gap')",
    "python_imports": _M + r"""SELECT DISTINCT module_id, module FROM (SELECT module_id, coalesce(nullif(regexp_extract(line, '^\s*from\s+(\.*[\w.]*)\s+import\b', 1), ''), nullif(regexp_extract(line, '^\s*import\s+([\w.]+)', 1), '')) AS module
  FROM (SELECT module_id, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM y WHERE suffix = '.py') WHERE regexp_matches(line, '^(import|from) [\w.]+')) WHERE module IS NOT NULL""",
    "context_score": _SCORE + "SELECT id, score, reasons FROM sc",
    "context_budget": _SCORE + ", r AS (SELECT id, score, greatest(tokens, 1) AS cost, row_number() OVER o AS rank, coalesce(sum(greatest(tokens, 1)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sc WINDOW o AS (ORDER BY score DESC, id)) SELECT id, rank, score, cost FROM r WHERE before < 8000",
    "context_ranked": _SCORE + """, l AS (SELECT source, target, bool_or(coalesce(bidirectional, false)) AS b FROM links WHERE target IS NOT NULL AND source <> target GROUP BY 1, 2),
e AS (SELECT source AS src, target AS dst FROM l UNION SELECT target, source FROM l WHERE b), g AS (SELECT dst, count(*) AS c FROM e GROUP BY dst),
q AS (SELECT id, tokens, snippet, round(score + 2 * ln(1 + coalesce(c, 0)), 9) AS score FROM sc LEFT JOIN g ON g.dst = id WHERE lower(path) LIKE '%.py' OR lower(path) LIKE '%.js'),
r AS (SELECT id, snippet, greatest(tokens, 1) AS cost, row_number() OVER o AS rank, coalesce(sum(greatest(tokens, 1)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q WINDOW o AS (ORDER BY score DESC, id)),
c AS (SELECT *, sum(cost) OVER () AS total FROM r WHERE before < 6000)
SELECT id, rank, cost, cost / total AS tokens_share, CASE WHEN total > 6000 THEN CAST(floor(length(snippet) * (CAST(6000.0 AS DOUBLE) / total)) AS INT) ELSE length(snippet) END AS snippet_chars FROM c""",
    "tokens_share": _M + "SELECT repo, sum(tokens) / sum(sum(tokens)) OVER () AS share FROM m GROUP BY repo",
    "vector_topk": f"SELECT b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 8",
    "vector_topk_batch": f"SELECT query_id, vec_id, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 8",
    "embed_documents": _ANALYSES + """SELECT doc_id, length(doc) AS chars, substr(doc, instr(doc, chr(10) || chr(10)) + 2, 400) AS excerpt, array_to_string(functions[1:20], ', ') AS functions, array_to_string(classes[1:10], ', ') AS classes, complexity
FROM (SELECT *, substr(full_doc, 1, 8000) AS doc FROM a WHERE text <> '')""",
    "answer_quality": _ANALYSES + """, k AS (SELECT doc_id, text, tokens, list_concat(functions[1:6], classes[1:4]) AS names FROM a),
v AS (SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 50 THEN 0.0 ELSE CASE WHEN len(names) > 0 THEN 0.5 * CAST(len(list_filter(names, lambda s: contains(text, s))) AS DOUBLE) / len(names) ELSE 0.25 END
  + 0.3 * least(CAST(length(text) AS DOUBLE) / greatest(80.0, CAST(tokens * 0.4 AS DOUBLE)), 1.0) + 0.1 * CAST(regexp_matches(lower(text), 'purpose|this file|this module|responsible for') AS INT) + 0.1 * CAST(regexp_matches(lower(text), 'function|class|method|def |returns|handles') AS INT) END AS q FROM k)
SELECT doc_id, round(CAST(q AS DOUBLE), 6) AS quality, q < 0.35 AS again FROM v""",
    "url_parse": "SELECT module_id, 'https://github.com/' || repo AS clean_url, repo AS name, substr(sha256('https://www.github.com/' || repo || CASE WHEN module_id % 2 = 0 THEN '.git' ELSE '' END), 1, 16) AS url_key FROM modules",
    "url_redact": "SELECT module_id, 'see https://host/' || path || ' and http://c/d' AS text FROM modules",
    "chain_parse": "SELECT DISTINCT snapshot_id, 2 AS n, 'k:1' AS first_key, 'm2' AS second_model FROM snapshots",
    "provider_of": "SELECT CASE WHEN starts_with(source, 'read') THEN 'gemini' WHEN starts_with(source, 'chat') THEN 'nvidia' ELSE 'groq' END AS provider, count(*) AS n FROM documents GROUP BY 1",
    "severity_lines": r"SELECT CASE WHEN l IN ('ERROR', 'HIGH') THEN 'HIGH' WHEN l IN ('WARNING', 'MEDIUM') THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\b(HIGH|MEDIUM|LOW|ERROR|WARNING|INFO)\b', 1)) AS l FROM documents) GROUP BY 1",
    "node_substring": _M + _N + "SELECT id, path FROM n WHERE contains(lower(path), 'cache')",
    "fence_strip": "SELECT doc_id, true AS same FROM documents WHERE text IS NOT NULL",
    "marker_blocks": "SELECT doc_id, 2 AS blocks, 'b.py' AS second FROM documents WHERE text IS NOT NULL",
    "think_strip": r"SELECT doc_id, length(regexp_replace('a ' || text || ' ', '^\s+|\s+$', '', 'g')) AS chars FROM documents",
    "md_line_class": r"""SELECT CASE WHEN s = '' THEN 'blank' WHEN starts_with(s, '# ') THEN 'h1' WHEN starts_with(s, '## ') THEN 'h2' WHEN starts_with(s, '### ') THEN 'h3' WHEN regexp_matches(s, '^[-*•] ') THEN 'bullet' WHEN regexp_matches(s, '^\d+\.\s') THEN 'numbered' ELSE 'text' END AS kind, count(*) AS lines,
  sum(length(regexp_replace(regexp_replace(regexp_replace(line, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '`(.+?)`', '\1', 'g'))) AS chars
FROM (SELECT line, trim(line, ' ') AS s FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)) GROUP BY 1""",
    "repo_snapshot": _M + _N + """, l AS (SELECT DISTINCT source, target FROM links WHERE target IS NOT NULL AND source <> target),
p AS (SELECT n.repo, count(DISTINCT (n.path, t.path)) AS links FROM l JOIN n ON n.id = l.source JOIN n t ON t.id = l.target GROUP BY n.repo)
SELECT n.repo, '2026-01-01T00:00:00Z' AS timestamp, count(DISTINCT path) AS files, coalesce(any_value(p.links), 0) AS links FROM n LEFT JOIN p ON p.repo = n.repo GROUP BY n.repo""",
    "repo_synthesis": "SELECT repo, CAST(ceil(count(*) / 10.0) AS BIGINT) AS batches FROM documents WHERE source = 'file_analysis' AND text IS NOT NULL GROUP BY repo",
    "scaffold_prompts": _M + _COV + r""", g AS (SELECT DISTINCT repo, path FROM cov WHERE status = 'gap' AND (repo, path) IN (SELECT (repo, path) FROM m))
SELECT repo, 'tests_generated/test_' || regexp_replace(regexp_extract(path, '[^/]*$'), '\.\w+$', '') || '.py' AS name, count(*) AS files, max(path) AS "last" FROM g GROUP BY 1, 2""",
    "executive_report": _M + _N + """, l AS (SELECT DISTINCT source, target FROM links WHERE target IS NOT NULL AND source <> target),
f AS (SELECT repo, count(*) AS files, sum(tokens) AS tokens FROM n GROUP BY repo), e AS (SELECT n.repo, count(*) AS edges FROM l JOIN n ON n.id = l.source GROUP BY n.repo),
r AS (SELECT f.*, coalesce(e.edges, 0) AS edges, CASE WHEN tokens >= 50000 THEN 'large' ELSE 'standard' END AS size_class FROM f LEFT JOIN e USING (repo))
SELECT *, repo || ': ' || files || ' files, ' || tokens || ' tokens, ' || edges || ' import edges (' || size_class || ')' AS prompt FROM r""",
    "tail_lines": """WITH t AS (SELECT source, arg_max(text, (length(text), doc_id)) AS text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL GROUP BY source), s AS (SELECT source, string_split(text, chr(10)) AS l FROM t)
SELECT source, len(l) AS lines, sha256(array_to_string(l[greatest(len(l) - 199, 1):len(l)], chr(10))) AS tail_hash FROM s""",
    "refactor_batches": _M.replace("WITH m", "WITH RECURSIVE m", 1) + """, o AS (SELECT repo, tokens, row_number() OVER (PARTITION BY repo ORDER BY path) AS i FROM y
  WHERE suffix IN ('.py', '.js', '.ts', '.tsx', '.go', '.rs', '.java', '.rb') AND tokens BETWEEN 1 AND 5500 AND length(trim(content, ' ')) > 0),
r AS (SELECT repo, i, tokens, tokens AS used, 1 AS n, 0 AS batch FROM o WHERE i = 1
  UNION ALL SELECT o.repo, o.i, o.tokens, CASE WHEN r.used + o.tokens > 1500 OR r.n >= 6 THEN o.tokens ELSE r.used + o.tokens END,
    CASE WHEN r.used + o.tokens > 1500 OR r.n >= 6 THEN 1 ELSE r.n + 1 END, CASE WHEN r.used + o.tokens > 1500 OR r.n >= 6 THEN r.batch + 1 ELSE r.batch END FROM r JOIN o ON o.repo = r.repo AND o.i = r.i + 1)
SELECT repo, batch, count(*) AS files, sum(tokens) AS tokens FROM r GROUP BY repo, batch""",
    "analysis_prompts": _M + _N + _PROMPTS + "SELECT id, length(p) AS chars, sha256(p) AS prompt_hash FROM prompts",
    "file_analyses": _M + _N + _PROMPTS + r""", c AS (SELECT content_hash, max(text) AS cached FROM documents d JOIN prompts q ON q.repo = d.repo AND q.path = replace(d.path, '\', '/') WHERE source = 'file_analysis' AND text <> '' AND content_hash IS NOT NULL GROUP BY 1),
a AS (SELECT q.*, cached IS NOT NULL AS from_cache, coalesce(cached, 'Purpose: this file handles ' || array_to_string(list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '')[1:40], ' ') || '. It has functions and returns values.') AS text, list_concat(functions[1:6], classes[1:4]) AS names
  FROM prompts q LEFT JOIN c USING (content_hash))
SELECT repo, path, from_cache, round(CAST(CASE WHEN length(text) < 50 THEN 0.0 ELSE CASE WHEN len(names) > 0 THEN 0.5 * CAST(len(list_filter(names, lambda s: contains(text, s))) AS DOUBLE) / len(names) ELSE 0.25 END
  + 0.3 * least(CAST(length(text) AS DOUBLE) / greatest(80.0, CAST(tokens * 0.4 AS DOUBLE)), 1.0) + 0.1 * CAST(regexp_matches(lower(text), 'purpose|this file|this module|responsible for') AS INT) + 0.1 * CAST(regexp_matches(lower(text), 'function|class|method|def |returns|handles') AS INT) END AS DOUBLE), 6) AS quality FROM a""",
    "context_projection": _SCORE + "SELECT id, length(snippet) AS chars, sha256(snippet) AS snippet_hash FROM w",
    "import_resolve": _M + _N + _IMPORTED + "SELECT DISTINCT repo, path, \"to\" AS target FROM i",
    "import_graph": _M + _N + _IMPORTED + """, f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_at NULLS FIRST, target) - 1 AS position FROM i),
k AS (SELECT *, row_number() OVER (ORDER BY source, position, target) AS o FROM f WHERE source <> target)
SELECT arg_min(source, o) AS source, arg_min(target, o) AS target, count(*) > 1 AS seen_again FROM k GROUP BY least(source, target), greatest(source, target)""",
    "well_documented": _M + _N + _DOCUMENTED + "SELECT id, documented FROM w",
    "refactor_split": _M + _N + _DOCUMENTED + "SELECT repo, count(*) FILTER (WHERE documented) AS \"left\", count(*) FILTER (WHERE NOT documented AND size BETWEEN 1 AND 5500) AS to_rewrite FROM w GROUP BY repo",
    "refactor_prompts": (_M + _N + _DOCUMENTED).replace("WITH m", "WITH RECURSIVE m", 1) + """, o AS (SELECT m.repo, m.path, m.tokens, length(m.content) AS c, row_number() OVER (PARTITION BY m.repo ORDER BY m.path) AS i FROM w JOIN n ON n.id = w.id JOIN m ON m.repo = n.repo AND m.path = n.path
  WHERE NOT documented AND m.tokens BETWEEN 1 AND 2000),
r AS (SELECT repo, i, path, c, tokens AS used, 1 AS n, 0 AS batch FROM o WHERE i = 1
  UNION ALL SELECT o.repo, o.i, o.path, o.c, CASE WHEN r.used + o.tokens > 2000 OR r.n >= 6 THEN o.tokens ELSE r.used + o.tokens END,
    CASE WHEN r.used + o.tokens > 2000 OR r.n >= 6 THEN 1 ELSE r.n + 1 END, CASE WHEN r.used + o.tokens > 2000 OR r.n >= 6 THEN r.batch + 1 ELSE r.batch END FROM r JOIN o ON o.repo = r.repo AND o.i = r.i + 1)
SELECT repo, batch, CAST(length('Improve these files:') + sum(1 + length('[FILE: ]') + length(path) + 1 + c + length('[END]') + 1) AS BIGINT) AS chars FROM r GROUP BY repo, batch""",
    "audit_prompts": _M + """, a AS (SELECT repo, path, '### ' || path || chr(10) || '```' || chr(10) || substr(content, 1, 3000) || chr(10) || '```' AS part, (row_number() OVER (PARTITION BY repo ORDER BY path) - 1) // 4 AS batch
  FROM m WHERE length(trim(content, ' ')) > 0 AND NOT (contains(path, 'test') OR contains(path, 'docs') OR contains(path, '_refactored') OR contains(path, 'tests_generated')))
SELECT repo, batch, count(*) AS files, sha256(string_agg(part, chr(10) || chr(10) ORDER BY path)) AS prompt_hash FROM a GROUP BY 1, 2""",
    "change_scopes": r"""WITH m AS (SELECT repo, replace(path, '\', '/') AS path, CAST(loaded_at AS DATE) AS day FROM modules WHERE loaded_at IS NOT NULL), l AS (SELECT repo, max(day) AS day FROM m GROUP BY repo)
SELECT repo, count(DISTINCT path) AS files, CASE WHEN count(DISTINCT path) < 5 THEN 'small' WHEN count(DISTINCT path) <= 20 THEN 'medium' ELSE 'large' END AS scope FROM m JOIN l USING (repo, day) GROUP BY repo""",
    "model_budgets": "SELECT DISTINCT coalesce(source, 'none') AS model, CASE WHEN contains(coalesce(source, 'none'), 'comment') THEN 8000 WHEN contains(source, 'chat') THEN 6000 WHEN contains(source, 'file') THEN 5500 ELSE 5000 END AS budget FROM documents",
    "module_extensions": r"""SELECT coalesce('.' || nullif(lower(ltrim(trim(ext, ' '), '.')), ''), lower(regexp_extract(regexp_extract(replace(path, '\', '/'), '[^/]*$'), '[^.](\.[^.]+)$', 1))) AS extension, count(*) AS files FROM modules GROUP BY 1""",
    "node_positions": _M + "SELECT module_id, row_number() OVER (PARTITION BY repo ORDER BY path) - 1 AS pos FROM m",
    "labels": _M + _N + """SELECT id, CASE WHEN complexity <= 0 THEN '' WHEN complexity < 50 THEN 'low' WHEN complexity < 200 THEN 'medium' ELSE 'high' END AS complexity_class,
  CASE WHEN tokens * 40 >= 128000 THEN '128k' WHEN tokens * 40 >= 64000 THEN '64k' WHEN tokens * 40 >= 32000 THEN '32k' WHEN tokens * 40 >= 16000 THEN '16k' WHEN tokens * 40 >= 8000 THEN '8k' ELSE '4k' END AS budget,
  CASE WHEN tokens >= 1000 THEN printf('%.1f', tokens / 1000.0) || 'k' ELSE CAST(tokens AS VARCHAR) END AS tokens FROM n""",
    "repo_json": _M + """SELECT repo, path, '{"path":"' || path || '","tokens":' || tokens || '}' AS json FROM m""",
}
