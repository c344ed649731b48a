"""Queries over the repository view of the driver's tables: classification, resolution, graph, health, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, render
from ..functions import paths as P
from ..functions import roles as R
from ..functions.text import analyse
from ..operators import diagrams, graph, health, lookup, resolve
from ..operators.search import rank_symbols
from ..sources import codeview as c
from ..sources.views import table
from .registered import query

WITH = f"WITH {c.ALL}"
SYM = f"WITH {c.FILES}, {c.SYMBOLS}"


# ----- files and symbols --------------------------------------------------------------
@query(f"WITH {c.FILES} SELECT file_id, rel_path, language, size_bytes, is_binary, is_generated, is_test, skip_reason FROM cf")
def code_files(spark, d):
    return c.files(spark, d).select("file_id", "rel_path", "language", "size_bytes", "is_binary", "is_generated", "is_test", "skip_reason")


@query(f"""WITH {c.FILES} SELECT rel_path, lower(regexp_extract(rel_path, '[^/]\\.([^./]*)$', 1)) AS ext, regexp_extract(rel_path, '[^/]*$') AS base, regexp_replace(rel_path, '/[^/]*$', '') AS dir, CAST(len(string_split(rel_path, '/')) AS INT) AS depth,
 {c._match('rel_path', P.SEARCH_TESTS)} AS search_test, {c._match('rel_path', [P.BUILD_OUTPUT])} AS build_output FROM cf""")
def path_parts(spark, d):
    p = F.col("rel_path")
    return c.files(spark, d).select("rel_path", P.extension(p).alias("ext"), P.base_name(p).alias("base"), P.dir_name(p).alias("dir"), P.depth(p).alias("depth"), P.is_search_test_path(p).alias("search_test"), p.rlike(P.BUILD_OUTPUT).alias("build_output"))


@query(f"WITH {c.FILES} SELECT count(*) AS seen, count(*) FILTER (skip_reason IS NULL) AS accepted, count(*) FILTER (is_binary) AS skipped_binary, count(*) FILTER (skip_reason = 'unrecognised file type') AS unrecognised FROM cf")
def scan_counters(spark, d):
    f = F.col("skip_reason")
    return c.files(spark, d).agg(F.count("*").alias("seen"), F.count_if(f.isNull()).alias("accepted"), F.count_if("is_binary").alias("skipped_binary"), F.count_if(f == "unrecognised file type").alias("unrecognised"))


@query(f"{SYM} SELECT symbol_id, file_id, name, qualified_name, kind, role, visibility, start_line, end_line, container_id, signature, doc_comment, is_exported, is_deprecated, complexity FROM cs")
def code_symbols(spark, d):
    return c.symbols(spark, d).select("symbol_id", "file_id", "name", "qualified_name", "kind", "role", "visibility", "start_line", "end_line", "container_id", "signature", "doc_comment", "is_exported", "is_deprecated", "complexity")


@query(f"{SYM} SELECT kind || ' ' || qualified_name || ' — ' || rel_path || ':' || CASE WHEN start_line = end_line THEN CAST(start_line AS VARCHAR) ELSE start_line || '-' || end_line END || CASE WHEN len(flags) > 0 THEN ' [' || array_to_string(flags, ', ') || ']' ELSE '' END AS line FROM (SELECT *, list_filter([CASE WHEN is_exported THEN 'exported' END, CASE WHEN is_deprecated THEN 'deprecated' END, CASE WHEN role <> 'unknown' THEN role END], lambda x: x IS NOT NULL) AS flags FROM cs)")
def symbol_lines(spark, d):
    return c.symbols(spark, d).select(render.symbol_line().alias("line"))


@query(f"""{SYM} SELECT symbol_id, name, kind, rel_path FROM cs WHERE lower(name) LIKE '%er%' AND kind IN ('function', 'class', 'method') AND rel_path LIKE 'src/%' ORDER BY is_exported DESC, complexity DESC, name, symbol_id LIMIT 40 OFFSET 10""")
def find_symbol_filtered(spark, d):
    return lookup.symbols(c.symbols(spark, d), "ER", kinds=["function", "class", "method"], path_prefix="SRC/", repo="repo", limit=40, offset=10).select("symbol_id", "name", "kind", "rel_path")


@query(f"{SYM} SELECT count(*) AS n FROM cs WHERE name LIKE '%\\_p%' ESCAPE '\\'")
def find_symbol_wildcards(spark, d):
    pattern = "%" + lookup.like_pattern("_P") + "%"
    return c.symbols(spark, d).where(F.expr(f"translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '{pattern.lower().replace(chr(92), chr(92) * 2)}'")).agg(F.count("*").alias("n"))


@query(f"{SYM} SELECT regexp_replace(rel_path, '/[^/]*$', '') AS dir, count(*) AS n FROM cs GROUP BY 1 HAVING count(*) >= 3")
def symbols_per_directory(spark, d):
    return c.symbols(spark, d).groupBy(P.dir_name(F.col("rel_path")).alias("dir")).agg(F.count("*").alias("n")).where("n >= 3")


# ----- imports and references ---------------------------------------------------------
@query(f"WITH {c.FILES}, {c.IMPORTS} SELECT ord, file_id, specifier, target_file_id, external_package, line FROM ci")
def code_imports(spark, d):
    return c.imports(spark, d).select("ord", "file_id", "specifier", "target_file_id", "external_package", "line")


@query(f"WITH {c.FILES}, {c.IMPORTS} SELECT external_package, count(DISTINCT file_id) AS n_files FROM ci WHERE external_package IS NOT NULL GROUP BY 1")
def package_usage(spark, d):
    return lookup.package_usage(c.imports(spark, d))


@query(f"WITH {c.FILES}, {c.IMPORTS} SELECT specifier, count(*) AS n FROM ci WHERE target_file_id IS NULL AND external_package IS NULL GROUP BY 1")
def unresolved_specifiers(spark, d):
    return lookup.unresolved_imports(c.imports(spark, d)).groupBy("specifier").agg(F.count("*").alias("n"))


@query(f"WITH {c.FILES}, {c.SYMBOLS}, {c.IMPORTS}, {c.REFERENCES} SELECT ord, name, kind, line, from_id, to_id, confidence FROM cr")
def resolved_references(spark, d):
    return c.resolved(spark, d).select("ord", "name", "kind", "line", "from_id", "to_id", "confidence")


@query(f"{WITH} SELECT edge_id, kind, from_id, to_id, file_id, line, confidence FROM ce")
def code_edges(spark, d):
    return c.edges(spark, d).select("edge_id", "kind", "from_id", "to_id", "file_id", "line", "confidence")


@query(f"""{WITH} SELECT (SELECT count(*) FROM cr WHERE to_id IS NULL) AS unresolved_references, (SELECT count(*) FROM cer WHERE confidence = 'exact') AS exact_edges, (SELECT count(*) FROM cer WHERE confidence = 'heuristic') AS heuristic_edges,
 (SELECT count(*) FROM ci WHERE target_file_id IS NULL AND external_package IS NULL) AS unresolved_imports, (SELECT count(*) FROM ci WHERE external_package IS NOT NULL) AS external_imports""")
def resolution_counters(spark, d):
    return spark.createDataFrame([resolve.counters(c.resolved(spark, d), c.imports(spark, d))], "unresolved_references bigint, exact_edges bigint, heuristic_edges bigint, unresolved_imports bigint, external_imports bigint")


@query(f"{WITH} SELECT edge_id, from_id, to_id FROM ce WHERE kind IN ('calls', 'extends') AND confidence = 'exact' ORDER BY edge_id LIMIT 500")
def find_edges(spark, d):
    return lookup.edges(c.edges(spark, d), ["calls", "extends"], exact_only=True, repo="repo").select("edge_id", "from_id", "to_id")


@query(f"""{WITH}, tg AS (SELECT symbol_id, qualified_name FROM cs WHERE name = 'parseToken' ORDER BY is_exported DESC, complexity DESC, name, symbol_id LIMIT 10),
x AS (SELECT ce.*, tg.qualified_name AS target, row_number() OVER (PARTITION BY to_id ORDER BY edge_id) AS nth FROM ce JOIN tg ON to_id = symbol_id WHERE kind <> 'imports')
SELECT target, x.kind, coalesce(s.qualified_name, f.rel_path, x.from_id) AS caller, a.rel_path || ':' || x.line AS location, confidence FROM x LEFT JOIN cs s ON s.symbol_id = x.from_id LEFT JOIN cf f ON f.file_id = x.from_id LEFT JOIN cf a ON a.file_id = x.file_id WHERE nth <= 100""")
def find_references(spark, d):
    r = c.repo(spark, d)
    return lookup.references(r, lookup.symbols(r.symbols, "parseToken", True, limit=10))


@query(f"""{WITH}, me AS (SELECT to_id AS symbol_id FROM ce WHERE kind = 'calls' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), e AS (SELECT 'calls' AS direction, to_id AS peer_id, edge_id, confidence FROM ce JOIN me ON from_id = symbol_id WHERE kind = 'calls'
 UNION ALL SELECT 'called by', from_id, edge_id, confidence FROM ce JOIN me ON to_id = symbol_id WHERE kind = 'calls'), n AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY edge_id) AS nth FROM e)
SELECT direction, coalesce(s.qualified_name, f.rel_path, peer_id) AS peer, coalesce(s.rel_path, f.rel_path) AS peer_path, confidence FROM n LEFT JOIN cs s ON s.symbol_id = peer_id LEFT JOIN cf f ON f.file_id = peer_id WHERE nth <= 40""")
def symbol_peers(spark, d):
    r = c.repo(spark, d)
    e = r.edges.where("kind = 'calls'")
    s = e.groupBy(F.col("to_id").alias("me")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "me").limit(1).select("me")
    out = lookup.ends(e.join(s, F.col("from_id") == F.col("me")).drop("me").orderBy("edge_id").limit(40), r, "to").withColumn("direction", F.lit("calls"))
    inn = lookup.ends(e.join(s, F.col("to_id") == F.col("me")).drop("me").orderBy("edge_id").limit(40), r, "from").withColumn("direction", F.lit("called by"))
    return out.unionByName(inn).select("direction", "peer", "peer_path", "confidence")


@query(f"""{WITH}, pick AS (SELECT min(rel_path) AS p FROM cf WHERE file_id IN (SELECT to_id FROM cei)), me AS (SELECT file_id FROM cf, pick WHERE rel_path = p)
SELECT 'defines' AS section, qualified_name AS text FROM cs WHERE file_id IN (FROM me) UNION ALL SELECT 'imports', specifier || CASE WHEN external_package IS NOT NULL THEN ' (external)' WHEN target_file_id IS NULL THEN ' — unresolved' ELSE '' END FROM ci WHERE file_id IN (FROM me)
UNION ALL SELECT 'imported by', rel_path FROM cei JOIN cf ON cf.file_id = from_id WHERE to_id IN (FROM me)""")
def file_explained(spark, d):
    r = c.repo(spark, d)
    e = r.edges.where("kind = 'imports'")
    me = r.files.join(e.select(F.col("to_id").alias("file_id")), "file_id", "left_semi").orderBy("rel_path").limit(1).select("file_id")
    mark = F.when(F.col("external_package").isNotNull(), " (external)").when(F.col("target_file_id").isNull(), " — unresolved").otherwise("")
    a = r.symbols.join(me, "file_id", "left_semi").select(F.lit("defines").alias("section"), F.col("qualified_name").alias("text"))
    b = r.imports.join(me, "file_id", "left_semi").select(F.lit("imports"), F.concat("specifier", mark))
    by = e.join(me.withColumnRenamed("file_id", "to_id"), "to_id", "left_semi").select("file_id").join(r.files.select("file_id", "rel_path"), "file_id").select(F.lit("imported by"), "rel_path")
    return a.unionAll(b).unionAll(by)


@query(f"""{WITH}, moved AS (SELECT file_id FROM cf WHERE size_bytes % 7 = 0) SELECT DISTINCT rel_path FROM ci WHERE target_file_id IN (FROM moved)""")
def dependents(spark, d):
    moved = c.files(spark, d).where("size_bytes % 7 = 0").select(F.col("file_id").alias("target_file_id"))
    return c.imports(spark, d).join(moved, "target_file_id", "left_semi").select("rel_path").distinct()


@query(f"""{SYM}, r AS (SELECT DISTINCT rel_path, a, a + 29 AS z FROM cs0, (VALUES (1), (21), (41)) AS t(a)) SELECT r.rel_path, CAST(a AS INT) AS start_line, CAST(z AS INT) AS end_line, array_to_string(list(qualified_name ORDER BY ord), ' ') AS names FROM r JOIN cs ON cs.rel_path = r.rel_path AND cs.start_line <= z AND cs.end_line >= a GROUP BY 1, 2, 3""")
def chunk_symbols(spark, d):
    s = c.symbols(spark, d)
    r = s.select("rel_path").distinct().select("rel_path", F.explode(F.array(F.lit(1), F.lit(21), F.lit(41))).alias("a")).withColumn("z", F.col("a") + 29)
    j = r.join(s, (r["rel_path"] == s["rel_path"]) & (F.col("start_line") <= F.col("z")) & (F.col("end_line") >= F.col("a")))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "qualified_name"))), lambda v: v["qualified_name"])
    return j.groupBy(r["rel_path"], "a", "z").agg(F.array_join(names, " ").alias("names")).select("rel_path", F.col("a").alias("start_line"), F.col("z").alias("end_line"), "names")


# ----- graph ---------------------------------------------------------------------------
ENTRY = """ep AS (SELECT cs.*, CASE WHEN role = 'controller' THEN 'HTTP route or controller' WHEN role IN ('worker', 'job') THEN 'background worker or scheduled job' WHEN role = 'entrypoint' OR regexp_matches(name, '^(main|Main|bootstrap|start|serve)$') THEN 'process entry function'
 WHEN is_exported AND symbol_id NOT IN (SELECT to_id FROM ce WHERE kind = 'calls') AND NOT is_test AND regexp_matches(rel_path, '(^|/)(cmd|bin|scripts?)/') THEN 'exported and uncalled in an executable directory' END AS reason FROM cs WHERE kind IN ('function', 'method', 'constructor', 'class', 'route'))"""


@query(f"{WITH}, {ENTRY} SELECT symbol_id, reason FROM ep WHERE reason IS NOT NULL")
def entry_points(spark, d):
    return graph.entry_points(c.symbols(spark, d), c.edges(spark, d), c.files(spark, d)).select("symbol_id", "reason")


@query(f"{WITH}, {ENTRY} SELECT reason, count(*) AS n, min(symbol_id) AS first_id FROM ep WHERE reason IS NOT NULL GROUP BY 1")
def entry_points_by_reason(spark, d):
    return entry_points(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.min("symbol_id").alias("first_id"))


LAYERS = "ly AS (SELECT cf.rel_path, coalesce(r, regexp_extract(cf.rel_path, '^[^/]*')) AS layer FROM cf LEFT JOIN (SELECT rel_path, arg_min(role, (start_line, symbol_id)) AS r FROM cs WHERE role <> 'unknown' GROUP BY 1) x ON x.rel_path = cf.rel_path WHERE skip_reason IS NULL)"


@query(f"{SYM}, {LAYERS} SELECT * FROM ly")
def layers(spark, d):
    return graph.layers(c.symbols(spark, d), c.files(spark, d))


@query(f"{SYM}, {LAYERS} SELECT layer, count(*) AS n FROM ly GROUP BY 1 ORDER BY n DESC, layer LIMIT 10")
def layer_sizes(spark, d):
    return layers(spark, d).groupBy("layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer").limit(10)


@query(f"""WITH {c.FILES}, {c.IMPORTS}, e AS (SELECT cei.from_id, cei.to_id FROM (SELECT DISTINCT file_id AS from_id, target_file_id AS to_id FROM ci WHERE target_file_id IS NOT NULL) cei),
p AS (SELECT regexp_replace(a.rel_path, '/[^/]*$', '') AS "from", regexp_replace(b.rel_path, '/[^/]*$', '') AS "to" FROM e JOIN cf a ON a.file_id = from_id JOIN cf b ON b.file_id = to_id) SELECT "from", "to", count(*) AS weight FROM p WHERE "from" <> "to" GROUP BY 1, 2""")
def dependency_folders(spark, d):
    return diagrams.pair_weights(resolve.import_edges(c.imports(spark, d)), c.files(spark, d), 40)[0]


@query(f"""WITH {c.FILES}, p AS (SELECT string_split(rel_path, '/') AS s FROM cf), x AS (SELECT array_to_string(s[1:n], '/') AS dir FROM p, (VALUES (1), (2), (3)) AS t(n) WHERE n < len(s)) SELECT dir, count(*) AS n FROM x GROUP BY 1""")
def folder_counts(spark, d):
    return diagrams.folder_counts(c.files(spark, d))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, (s_suppkey + 7 * j) % (SELECT count(*) FROM supplier) AS b FROM supplier, (VALUES (1), (2), (3)) AS t(j)), o(n, d) AS (SELECT 1::BIGINT, 0 UNION SELECT b, d + 1 FROM o JOIN e ON a = n WHERE d < 2), i(n, d) AS (SELECT 1::BIGINT, 0 UNION SELECT a, d + 1 FROM i JOIN e ON b = n WHERE d < 2),
near AS (SELECT n FROM o UNION SELECT n FROM i) SELECT DISTINCT a AS from_id, b AS to_id FROM e WHERE a IN (FROM near) AND b IN (FROM near)""")
def focus_graph(spark, d):
    from ..sources.views import ring_edges

    return graph.neighbourhood(ring_edges(spark, d).distinct(), 1, 2, 60).select("from_id", "to_id")


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey % 10 * 10 + (s_suppkey // 10 + 1) % 4 AS b FROM supplier WHERE s_suppkey // 10 < 4 UNION ALL SELECT s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 9 = 0),
f(a, b) AS (SELECT a, b FROM e UNION SELECT f.a, e.b FROM f JOIN e ON e.a = f.b), k AS (SELECT x.a AS node, min(x.b) AS component FROM f x JOIN f y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(DISTINCT x.b) > 1)
SELECT 'component ' || component AS cycle, node FROM k UNION ALL SELECT DISTINCT 'loop ' || a, a FROM e WHERE a = b""")
def import_cycles(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    tens = F.floor(k / 10)
    e = s.where(tens < 4).select(k.alias("from_id"), (k % 10 * 10 + (tens + 1) % 4).cast("long").alias("to_id")).unionAll(s.where(k % 9 == 0).select(k, k))
    return graph.cycles(e)


# ----- health --------------------------------------------------------------------------
HEALTH = f"""{WITH}, tested AS (SELECT DISTINCT array_to_string(string_split(rel_path, '/')[1:n], '/') AS p FROM cf, range(1, 9) AS t(n) WHERE is_test AND n <= len(string_split(rel_path, '/'))), dirs AS (SELECT regexp_replace(rel_path, '/[^/]*$', '') AS dir, count(*) AS n FROM cs GROUP BY 1 HAVING count(*) >= 5),
deps AS (SELECT 'pkg-' || s_suppkey AS name, unnest([pool[(s_suppkey + 0) % 10 + 1], pool[(s_suppkey + 3) % 10 + 1], pool[(s_suppkey + 7) % 10 + 1]]) AS dependency FROM supplier, (SELECT ['express', 'react', '@nestjs/core', 'left-pad', 'eslint-plugin', 'django', '@types/node', 'axum', 'typescript', 'lodash'] AS pool)),
h AS (SELECT 'possible-dead-code' AS category, 'low' AS severity, 'medium' AS confidence, kind || ' ' || qualified_name || ' has no resolved references' AS summary, rel_path, start_line AS line, row_number() OVER (ORDER BY complexity DESC, symbol_id) AS position FROM cs
 WHERE kind IN ('function', 'method', 'class') AND NOT is_exported AND symbol_id NOT IN (SELECT to_id FROM ce WHERE kind IN ('calls', 'references', 'instantiates', 'extends')) AND rel_path NOT IN (SELECT rel_path FROM cf WHERE is_generated) AND NOT contains(rel_path, 'test') AND length(name) > 2
UNION ALL SELECT 'unused-dependency', 'low', 'medium', dependency || ' is declared by ' || name || ' but never imported', name || '/package.json', NULL, row_number() OVER (ORDER BY name, dependency) FROM deps WHERE NOT regexp_matches(dependency, '^(@types/|eslint|prettier|typescript$|@babel|postcss|tailwindcss)') AND dependency NOT IN (SELECT external_package FROM ci WHERE external_package IS NOT NULL)
UNION ALL SELECT 'large-file', CASE WHEN skip_reason IS NOT NULL THEN 'medium' ELSE 'info' END, 'high', rel_path || ' is ' || CAST(floor(size_bytes / 1024 + 0.5) AS BIGINT) || ' KB' || CASE WHEN skip_reason IS NOT NULL THEN ' and was not indexed' ELSE '' END, rel_path, NULL, row_number() OVER (ORDER BY size_bytes DESC, rel_path) FROM cf WHERE size_bytes > 200000 AND NOT is_generated
UNION ALL SELECT 'missing-tests', 'medium', 'medium', dir || ' defines ' || n || ' symbols with no test file nearby', dir, NULL, row_number() OVER (ORDER BY n DESC, dir) FROM dirs WHERE NOT EXISTS (SELECT 1 FROM tested WHERE dir = p OR starts_with(dir, p || '/'))
UNION ALL SELECT 'high-complexity', CASE WHEN complexity >= 50 THEN 'high' ELSE 'medium' END, 'high', qualified_name || ' has cyclomatic complexity ' || complexity, rel_path, start_line, row_number() OVER (ORDER BY complexity DESC, symbol_id) FROM cs WHERE complexity >= 25
UNION ALL SELECT 'unresolved-import', 'info', 'high', '"' || specifier || '" could not be resolved (' || n || CASE WHEN n = 1 THEN ' occurrence)' ELSE ' occurrences)' END, NULL, NULL, row_number() OVER (ORDER BY n DESC, specifier) FROM (SELECT specifier, count(*) AS n FROM ci WHERE target_file_id IS NULL AND external_package IS NULL GROUP BY 1))"""


@query(f"{HEALTH} SELECT category, severity, confidence, summary, rel_path, line, position FROM h WHERE position <= 15")
def health_findings(spark, d):
    r = c.repo(spark, d)
    parts = [f(r) for f in health.CHECKS if f is not health.circular_imports]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("detail")


@query(f"{HEALTH} SELECT summary, rel_path, line, position FROM h WHERE category = 'possible-dead-code' AND position <= 15")
def health_category(spark, d):
    return health.findings(c.repo(spark, d), category="possible-dead-code").select("summary", "rel_path", "line", "position")


@query(f"{HEALTH.replace('count(*) >= 5', 'count(*) >= 3')} SELECT summary, rel_path, position FROM h WHERE category = 'missing-tests' AND position <= 40")
def untested_folders(spark, d):
    return health.untested(c.repo(spark, d), 40, 3).select("summary", "rel_path", "position")


@query(f"{HEALTH} SELECT summary, rel_path, line FROM h WHERE category = 'possible-dead-code' AND position <= 40")
def dead_code(spark, d):
    return health.dead_code(c.repo(spark, d), 40).select("summary", "rel_path", "line")


@query(f"{WITH} SELECT (SELECT count(*) FROM cf) AS files, (SELECT count(*) FROM cf WHERE skip_reason IS NULL) AS indexed_files, (SELECT count(*) FROM cs) AS symbols, (SELECT count(*) FROM cf WHERE is_test) AS test_files, (SELECT count(DISTINCT external_package) FROM ci) AS external_packages")
def health_totals(spark, d):
    return health.totals(c.repo(spark, d))


_FW = ", ".join(f"('{i}', '{label}', '{cat}')" for i, (label, cat, _, _) in R.FRAMEWORKS.items())
_FP = ", ".join(f"('{i}', {n}, '{p}')" for i, (_, _, ps, _) in R.FRAMEWORKS.items() for n, p in enumerate(ps))
_FF = " UNION ALL ".join(f"SELECT '{i}' AS id, {100 + n} AS place, min(rel_path) AS sign FROM cf WHERE regexp_matches(rel_path, '{p}')" for i, (_, _, _, ps) in R.FRAMEWORKS.items() for n, p in enumerate(ps))


@query(f"""WITH {c.FILES}, {c.IMPORTS}, u AS (SELECT external_package, count(DISTINCT file_id) AS n FROM ci WHERE external_package IS NOT NULL GROUP BY 1), s AS (SELECT fp.id, place, 'imported by ' || n || CASE WHEN n = 1 THEN ' file: ' ELSE ' files: ' END || external_package AS sign FROM u JOIN (VALUES {_FP}) AS fp(id, place, package) ON package = external_package
 UNION ALL SELECT * FROM ({_FF}) WHERE sign IS NOT NULL) SELECT id, label, category, array_to_string(list(sign ORDER BY place)[1:4], '|') AS evidence FROM s JOIN (VALUES {_FW}) AS fw(id, label, category) USING (id) GROUP BY 1, 2, 3""")
def frameworks(spark, d):
    return lookup.frameworks(c.imports(spark, d), c.files(spark, d)).withColumn("evidence", F.array_join("evidence", "|"))


# ----- history -------------------------------------------------------------------------
CF = f"hcf AS (SELECT DISTINCT l_orderkey AS sha, {c._sql_path('l_partkey')} AS rel_path FROM lineitem)"


@query(f"""{SYM}, {CF}, ch AS (SELECT rel_path, count(*) AS churn FROM hcf GROUP BY 1), cx AS (SELECT rel_path, sum(complexity) AS complexity, arg_min(qualified_name, (-complexity, CASE WHEN is_exported THEN 0 ELSE 1 END, name, symbol_id)) AS top_symbol FROM cs GROUP BY 1)
SELECT rel_path, churn, CAST(complexity AS BIGINT) AS complexity, CAST(churn * complexity AS BIGINT) AS score, top_symbol FROM ch JOIN cx USING (rel_path) WHERE complexity > 0 ORDER BY score DESC, rel_path LIMIT 15""")
def code_hotspots(spark, d):
    return lookup.hotspots(c.repo(spark, d))


@query(f"WITH {CF} SELECT rel_path, count(*) AS churn FROM hcf JOIN orders ON sha = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def code_churn(spark, d):
    return lookup.churn(c.commit_files(spark, d), c.commits(spark, d), 852076800000)


@query("SELECT 'a' || o_custkey || '@x' AS author_email, count(*) AS commits, arg_max('n' || o_custkey % 7, (o_orderdate, CAST(o_orderkey AS VARCHAR))) AS author_name FROM orders GROUP BY 1")
def contributors_by_email(spark, d):
    return lookup.contributors(c.commits(spark, d))


@query("SELECT 'n' || o_custkey % 7 AS author_name, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 100) GROUP BY 1")
def recent_authors(spark, d):
    return c.commits(spark, d).orderBy(F.desc("timestamp_ms"), "sha").limit(100).groupBy("author_name").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_name AS path, max(p_size) AS oid FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1), b AS (SELECT p_name AS path, max(p_size) AS oid FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS rel_path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'modify' END AS change_type FROM a FULL JOIN b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid""")
def tree_changes(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 5 <> 0").groupBy(F.col("p_name").alias("rel_path")).agg(F.max("p_size").alias("old"))
    b = p.where("p_partkey % 7 <> 0").groupBy(F.col("p_name").alias("rel_path")).agg(F.max("p_size").alias("new"))
    how = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").otherwise("modify")
    return a.join(b, "rel_path", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("rel_path", how.alias("change_type"))


_REVS = """rv AS (SELECT doc_id, 0 AS ord, 'r0' AS sha, text FROM documents UNION ALL SELECT doc_id, 1, 'r1', array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) % 3 <> 0), chr(10)) FROM documents UNION ALL SELECT doc_id, 2, 'r2', array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) % 2 = 0), chr(10)) FROM documents)"""


@query(f"""WITH {_REVS}, l AS (SELECT doc_id, ord, sha, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM rv), o AS (SELECT doc_id, t, arg_max(sha, ord) AS sha FROM l GROUP BY 1, 2)
SELECT l.doc_id, CAST(line AS INT) AS line, o.sha FROM l JOIN o ON l.doc_id = o.doc_id AND l.t = o.t WHERE ord = 0""")
def blame(spark, d):
    from ..sources.git import blame as blamed

    x = table(spark, d, "documents").select("doc_id", "text")
    keep = lambda n: F.array_join(F.filter(F.split("text", "\n"), lambda s: F.length(s) % n != (0 if n == 3 else 1)), "\n")
    revs = x.select("doc_id", F.lit(0).alias("ord"), F.lit("r0").alias("sha"), "text").unionAll(x.select("doc_id", F.lit(1), F.lit("r1"), keep(3))).unionAll(x.select("doc_id", F.lit(2), F.lit("r2"), keep(2)))
    return blamed(revs, ["doc_id"]).select("doc_id", "line", "sha")


# ----- ranking by name ------------------------------------------------------------------
def _name_rank_sql() -> str:
    q = analyse("how are user tokens parsed in the http client")
    words = list(q.terms[:6])
    known = c._list([w.lower() for w in words])
    per = " UNION ALL ".join(f"SELECT * FROM (SELECT symbol_id, name, {i} AS term, row_number() OVER (ORDER BY is_exported DESC, complexity DESC, name, symbol_id) AS nth FROM cs WHERE contains(lower(name), '{w}')) WHERE nth <= 25" for i, w in enumerate(words))
    split = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""{SYM}, m AS ({per}), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY term, nth) AS seen FROM m) WHERE seen = 1), a AS (SELECT *, {split} AS w FROM u),
 b AS (SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains({known}, x))) / len(w) + len(list_filter(w, lambda x: list_contains({known}, x))) END AS aff FROM a)
 SELECT symbol_id, CAST(row_number() OVER (ORDER BY round(aff, 9) DESC, term, nth) - 1 AS INT) AS rank FROM b"""


@query(_name_rank_sql())
def symbol_rank(spark, d):
    return rank_symbols(c.symbols(spark, d), analyse("how are user tokens parsed in the http client")).select("symbol_id", "rank")


# ----- rendering ------------------------------------------------------------------------
@query(f"""WITH {c.FILES} SELECT rel_path, regexp_replace(regexp_replace(rel_path, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g') AS node_id, regexp_replace(CASE WHEN length(rel_path) > 20 THEN rel_path ELSE rel_path || '(x) [{{y}}] | "z" and so on for some more' END, '["\\[\\]{{}}()|]', ' ', 'g') AS long_label, CAST(ceil(strlen(rel_path) / 3.2) AS BIGINT) AS tokens,
 CASE WHEN k % 3 = 1 THEN 'file' ELSE 'files' END AS noun, CASE WHEN k % 3 = 1 THEN 'dependency' ELSE 'dependencies' END AS noun2, CASE WHEN k % 3 = 1 THEN 'match' ELSE 'matches' END AS noun3 FROM cf WHERE length(CASE WHEN length(rel_path) > 20 THEN rel_path ELSE rel_path || '(x) [{{y}}] | "z" and so on for some more' END) <= 42""")
def rendering(spark, d):
    p = F.col("rel_path")
    long_ = F.when(F.length(p) > 20, p).otherwise(F.concat(p, F.lit('(x) [{y}] | "z" and so on for some more')))
    n = F.col("k") % 3
    return c.files(spark, d).where(F.length(long_) <= 42).select("rel_path", render.sanitize_id(p).alias("node_id"), render.label(long_).alias("long_label"), render.estimate_tokens(p).alias("tokens"), render.pluralize(F.lit("file"), n).alias("noun"), render.pluralize(F.lit("dependency"), n).alias("noun2"), render.pluralize(F.lit("match"), n).alias("noun3"))


@query("""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l, CAST(doc_id % 40 + 1 AS INT) AS focus FROM documents), y AS (SELECT doc_id, l, greatest(1, least(greatest(1, least(focus, len(l))) - 4, len(l) - 10 + 1)) AS s FROM x)
SELECT doc_id, CAST(CASE WHEN len(l) > 10 THEN s ELSE 1 END AS INT) AS start_line, CAST(CASE WHEN len(l) > 10 THEN s + 9 ELSE len(l) END AS INT) AS end_line, sha256(CASE WHEN len(l) > 10 THEN array_to_string(l[s:s + 9], chr(10)) ELSE array_to_string(l, chr(10)) END) AS h, len(l) > 10 AS truncated FROM y""")
def snippets(spark, d):
    x = table(spark, d, "documents").select("doc_id", render.clamp_lines(F.col("text"), 10, (F.col("doc_id") % 40 + 1).cast("int")).alias("s"))
    return x.select("doc_id", "s.start_line", "s.end_line", F.sha2("s.text", 256).alias("h"), "s.truncated")


@query(f"WITH {c.FILES} SELECT k, {c.sql_id('c_', 'chunk', 'file_id', '1', 'k')} AS chunk_id, {c.sql_id('e_', 'edge', "'calls'", 'file_id', 'k')} AS edge_id, {c.sql_id('g_', 'commit', "'repo'", 'k')} AS commit_id, {c.sql_id('r_', 'repository', 'rel_path')} AS repo_id FROM cf")
def other_ids(spark, d):
    k, f = F.col("k"), F.col("file_id")
    return c.files(spark, d).select("k", ids.chunk_id(f, F.lit(1), k).alias("chunk_id"), ids.edge_id(F.lit("calls"), f, k).alias("edge_id"), ids.commit_id(F.lit("repo"), k).alias("commit_id"), ids.repo_id(F.col("rel_path")).alias("repo_id"))
