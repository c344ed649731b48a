"""A repository made of the driver's tables: files and symbols from part, imports from orders, references from lineitem.

Every view is a function of the tables' keys, so that its twin in SQL is short
(``SQL``).  Names, folders and extensions cycle through lists whose lengths have no
common divisor, which gives all their combinations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import paths as P
from ..functions import roles as R
from ..operators import resolve
from ..schemas import Repo
from ..shared import cut
from .views import table

DIRS = "src/auth src/controllers src/services src/models src/workers src/jobs src/middleware src/repositories src/config tests/unit db/migrations generated/proto cmd/server scripts docs/adr packages/app/src vendor/lib src/handlers bin web/views e2e app/stores k8s lib".split()
STEMS = "user OrderService payment_handler AuthController index main test_api JobRunner CacheStore model Util_pb2 zz_generated readme HttpRouter loginGuard batch_test schema".split()
EXTS = ".ts .tsx .js .py .go .java .rs .kt .cs .c .md .json .yml .test.ts .pb.go .d.ts .png .sql .xyz".split()
NAMES = "loadUser handleRequest UserModel OrderService parseToken AuthController main Serializer _private CacheStore onClick up Job start computeTotals PaymentWorker HttpClient Config validate RouteTable Listener Iterator merge Facade encode LoginGuard buildQuery TaskRunner Entity flush Widget".split()
KINDS = "function class method interface constant variable".split()
SIGNATURES = ["function run()", "@Get('/users') list()", "class A", "@Cron('* * *') tick()", "def go(self)", "@app.post('/x')", "@shared_task work", "const x = 1", "@Interval(5) poll()"]
KINDS_OF_REFERENCE = "reference call call instantiate extends implements call".split()
EXTERNAL = {"typescript": "@nestjs/core/http", "tsx": "react", "javascript": "express", "python": "django.db", "go": "github.com/gin-gonic/gin", "java": "org.springframework.web.Rest", "kotlin": "org.junit.Test", "csharp": "Microsoft.AspNetCore.Mvc", "rust": "axum::Router", "c": "stdio.h", "markdown": "https://x"}
GO_MODULE = "example.com/mod"


def _pick(xs: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))


def _path(k: Column) -> Column:
    return F.concat(_pick(DIRS, k), F.lit("/m"), k.cast("string"), F.lit("/"), _pick(STEMS, k), _pick(EXTS, k))


def _name(n: Column, k: Column) -> Column:
    return F.concat(_pick(NAMES, n), F.when(k % 4 == 0, F.lit("")).otherwise((k % 53).cast("string")))


_STORED: dict[tuple, DataFrame] = {}


def _stored(make) -> object:
    """Written once an application and folder, as an index is, and read by every query after."""

    def get(spark: SparkSession, d: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, d, make.__name__)
        if key not in _STORED:
            _STORED[key] = cut(make(spark, d))
        return _STORED[key]

    return get


@_stored
def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    repo = F.lit("repo")
    x = table(spark, d, "part").select(k.alias("k"), _path(k).alias("rel_path"), (F.col("p_size") * 9000).cast("long").alias("size_bytes"), (k % 400).cast("int").alias("line_count"), F.sha2("p_name", 256).alias("content_hash"))
    path, lang = F.col("rel_path"), P.language_of(F.col("rel_path"))
    skip = F.when(P.is_binary_extension(path), F.lit("binary")).when(lang.isNull(), F.lit("unrecognised file type"))
    return x.select(
        "k", ids.file_id(repo, path).alias("file_id"), repo.alias("repo_id"), "rel_path", F.when(skip.isNull(), lang).alias("language"), "size_bytes", "line_count", "content_hash", F.lit(0).cast("long").alias("mtime_ms"),
        F.lit(None).cast("string").alias("package_name"), P.is_binary_extension(path).alias("is_binary"), P.is_generated_path(path).alias("is_generated"), P.is_test_path(path).alias("is_test"), skip.alias("skip_reason"),
    )


def raw_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Three symbols a file; the third lies in the second where the key is even."""
    k, j = F.col("k"), F.col("ord")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size").withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    start = 1 + j * 20
    return p.select(
        "k", _path(k).alias("rel_path"), "ord", _name(k * 3 + j, k).alias("name"), _pick(KINDS, k + j).alias("kind"), start.alias("start_line"), F.lit(1).alias("start_column"), (start + F.col("p_size") % 15).alias("end_line"), F.lit(1).alias("end_column"),
        F.when((j == 2) & (k % 2 == 0), _name(k * 3 + 1, k)).alias("container"), _pick(SIGNATURES, k + 2 * j).alias("signature"), F.when(k % 11 == 0, F.lit("Old. @Deprecated since 2")).when(k % 5 == 0, F.lit("Does it.")).alias("doc_comment"),
        ((k + j) % 3 == 0).alias("is_exported"), F.lit(False).alias("is_async"), F.lit("public").alias("visibility"), F.col("p_size").cast("int").alias("complexity"),
    )


@_stored
def symbols(spark: SparkSession, d: str) -> DataFrame:
    return resolve.symbols(raw_symbols(spark, d), files(spark, d))


def raw_references(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        _path(k).alias("rel_path"), (F.col("l_orderkey") * 10 + n).alias("ord"), _name(F.col("l_suppkey"), F.col("l_suppkey")).alias("name"), _pick(KINDS_OF_REFERENCE, n).alias("kind"), (1 + n * 7).cast("int").alias("line"), F.when(n % 2 == 1, _name(k * 3, k)).alias("from_symbol")
    )


def raw_imports(spark: SparkSession, d: str) -> DataFrame:
    """A file for each order's customer imports another, in the way of its language; each fifth an outside package."""
    k, t, path, lang = F.col("o_custkey"), F.col("t"), F.col("rel_path"), F.col("lang")
    known = table(spark, d, "part").select(F.col("p_partkey").alias("o_custkey")).hint("merge")  # keys are many, if short
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_semi")
    o = o.select("o_orderkey", _path(k).alias("rel_path"), (F.col("o_orderkey") % 1499 + 1).alias("t")).withColumn("lang", P.language_of(path)).withColumn("target", F.concat(_pick(DIRS, t), F.lit("/m"), t.cast("string"), F.lit("/"), _pick(STEMS, t)))
    target = F.col("target")
    up = F.repeat(F.lit("../"), P.depth(path) - 1)
    outside = F.create_map(*[F.lit(x) for kv in EXTERNAL.items() for x in kv])
    inner = (
        F.when(lang.isin(resolve.JS), F.concat(up, target, F.when(F.col("o_orderkey") % 2 == 0, F.lit(".js")).otherwise(F.lit(""))))
        .when(lang.isin("python", "java", "kotlin"), F.translate(target, "/", "."))
        .when(lang == "go", F.concat(F.lit(GO_MODULE + "/"), P.dir_name(target)))
        .when(lang == "rust", F.concat(F.lit("crate::"), F.regexp_replace(F.regexp_replace(target, "^src/", ""), "/", "::"), F.lit("::Item")))
        .otherwise(F.concat(up, target))
    )
    spec = F.when(F.col("o_orderkey") % 5 == 0, F.coalesce(F.try_element_at(outside, lang), inner)).otherwise(inner)
    return o.select(path, F.col("o_orderkey").alias("ord"), spec.alias("specifier"), F.array(_name(t * 3, t)).alias("symbols"), F.lit(False).alias("is_type_only"), (F.col("o_orderkey") % 90 + 1).cast("int").alias("line"))


@_stored
def imports(spark: SparkSession, d: str) -> DataFrame:
    return resolve.imports(raw_imports(spark, d), files(spark, d), go_module=GO_MODULE)


def _references(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_references(raw_references(spark, d), symbols(spark, d), imports(spark, d), files(spark, d))


@_stored
def resolved(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)


@_stored
def edges(spark: SparkSession, d: str) -> DataFrame:
    # fresh references lie by file, where those that were stored would be shuffled once more
    return resolve.import_edges(imports(spark, d)).unionByName(resolve.reference_edges(_references(spark, d)))


def packages(spark: SparkSession, d: str) -> DataFrame:
    """A package a supplier, with three dependencies each."""
    k = F.col("s_suppkey")
    pool = F.array(*[F.lit(x) for x in ("express", "react", "@nestjs/core", "left-pad", "eslint-plugin", "django", "@types/node", "axum", "typescript", "lodash")])
    deps = F.transform(F.array(F.lit(0), F.lit(3), F.lit(7)), lambda j: F.element_at(pool, ((k + j) % 10 + 1).cast("int")))
    name = F.concat(F.lit("pkg-"), k.cast("string"))
    return table(spark, d, "supplier").select(F.lit("repo").alias("repo_id"), name.alias("name"), name.alias("rel_path"), F.concat(name, F.lit("/package.json")).alias("manifest_path"), F.lit("npm").alias("ecosystem"), F.lit(None).cast("string").alias("version"), deps.alias("dependencies"), F.array().cast("array<string>").alias("dev_dependencies"))


def commits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.lit(None).cast("string").alias("commit_id"), F.lit("repo").alias("repo_id"), F.col("o_orderkey").cast("string").alias("sha"), F.concat(F.lit("n"), (F.col("o_custkey") % 7).cast("string")).alias("author_name"), F.concat(F.lit("a"), F.col("o_custkey").cast("string"), F.lit("@x")).alias("author_email"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").alias("timestamp_ms"), F.col("o_orderpriority").alias("subject"), (F.col("o_orderstatus") == "P").alias("is_merge"), F.lit(0).alias("files_changed"), F.lit(0).alias("insertions"), F.lit(0).alias("deletions"))


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.lit("repo").alias("repo_id"), F.col("l_orderkey").cast("string").alias("sha"), _path(F.col("l_partkey")).alias("rel_path"), F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "N", "modify").otherwise("delete").alias("change_type"))


def repo(spark: SparkSession, d: str) -> Repo:
    return Repo.of(spark, files=files(spark, d), symbols=symbols(spark, d), edges=edges(spark, d), imports=imports(spark, d), packages=packages(spark, d), commits=commits(spark, d), commit_files=commit_files(spark, d))


# ----- the same in SQL ----------------------------------------------------------------
def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _at(xs: list[str], i: str) -> str:
    return f"({_list(xs)})[({i}) % {len(xs)} + 1]"


def _sql_path(k: str) -> str:
    return f"{_at(DIRS, k)} || '/m' || {k} || '/' || {_at(STEMS, k)} || {_at(EXTS, k)}"


def _sql_name(n: str, k: str) -> str:
    return f"{_at(NAMES, n)} || CASE WHEN ({k}) % 4 = 0 THEN '' ELSE CAST(({k}) % 53 AS VARCHAR) END"


def _match(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '" + p.replace("'", "''") + "')" for p in patterns) + ")"


def sql_id(prefix: str, kind: str, *parts: str) -> str:
    joined = " || chr(0) || ".join([f"'{kind}'", *(f"CAST({p} AS VARCHAR)" for p in parts)])
    return f"'{prefix}' || left(replace(replace(to_base64(unhex(sha1({joined}))), '+', '-'), '/', '_'), 22)"


def sql_language(path: str) -> str:
    name = f"lower(regexp_extract({path}, '[^/]*$'))"
    ext = f"lower(regexp_extract({path}, '[^/]\\.([^./]*)$', 1))"
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.BY_NAME.items())
    by_ext = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.BY_EXTENSION.items())
    return f"coalesce(CASE {name} {named} END, CASE WHEN {name} LIKE 'dockerfile.%' THEN 'dockerfile' END, CASE {ext} {by_ext} END)"


def sql_role(path: str, name: str, signature: str, is_test: str) -> str:
    on = {"path": path, "name": name, "signature": f"coalesce({signature}, '')"}
    return f"CASE WHEN {is_test} THEN 'test' " + " ".join(f"WHEN {_match(on[w], [p])} THEN '{r}'" for r, w, p in R.ROLES) + " ELSE 'unknown' END"


_EXT = "lower(regexp_extract(rel_path, '[^/]\\.([^./]*)$', 1))"
FILES = f"""cf0 AS (SELECT p_partkey AS k, {_sql_path('p_partkey')} AS rel_path, CAST(p_size * 9000 AS BIGINT) AS size_bytes FROM part),
cf1 AS (SELECT *, {sql_language('rel_path')} AS lang, {_EXT} IN ({', '.join(f"'{b}'" for b in P.BINARY)}) AS is_binary FROM cf0),
cf AS (SELECT k, {sql_id('f_', 'file', "'repo'", 'rel_path')} AS file_id, rel_path, size_bytes, CASE WHEN NOT is_binary THEN lang END AS language, is_binary, {_match('rel_path', P.GENERATED)} AS is_generated, {_match('rel_path', P.TESTS)} AS is_test,
 CASE WHEN is_binary THEN 'binary' WHEN lang IS NULL THEN 'unrecognised file type' END AS skip_reason FROM cf1)"""
SYMBOLS = f"""cs0 AS (SELECT p_partkey AS k, j AS ord, {_sql_path('p_partkey')} AS rel_path, {_sql_name('p_partkey * 3 + j', 'p_partkey')} AS name, {_at(KINDS, 'p_partkey + j')} AS kind, CAST(1 + j * 20 AS INT) AS start_line, CAST(1 + j * 20 + p_size % 15 AS INT) AS end_line,
 CASE WHEN j = 2 AND p_partkey % 2 = 0 THEN {_sql_name('p_partkey * 3 + 1', 'p_partkey')} END AS container, {_at(SIGNATURES, 'p_partkey + 2 * j')} AS signature, CASE WHEN p_partkey % 11 = 0 THEN 'Old. @Deprecated since 2' WHEN p_partkey % 5 = 0 THEN 'Does it.' END AS doc_comment, (p_partkey + j) % 3 = 0 AS marked, CAST(p_size AS INT) AS complexity FROM part, (VALUES (0), (1), (2)) AS t(j)),
cs1 AS (SELECT cs0.*, cf.file_id, cf.language, cf.is_test, CASE WHEN container IS NULL THEN name ELSE container || '.' || name END AS qualified_name FROM cs0 JOIN cf ON cf.rel_path = cs0.rel_path),
cs2 AS (SELECT *, row_number() OVER (PARTITION BY file_id, kind, qualified_name ORDER BY ord) - 1 AS ordinal FROM cs1),
cs3 AS (SELECT *, {sql_id('s_', 'symbol', "'repo'", 'rel_path', 'kind', 'qualified_name', 'ordinal')} AS symbol_id FROM cs2),
csc AS (SELECT a.symbol_id, arg_max(b.symbol_id, b.ord) AS container_id FROM cs3 a JOIN cs3 b ON a.file_id = b.file_id AND a.container = b.qualified_name AND b.ord < a.ord GROUP BY 1),
cs AS (SELECT cs3.*, container_id, {sql_role('rel_path', 'name', 'signature', 'is_test')} AS role, CASE WHEN language = 'go' AND NOT regexp_matches(name, '^[A-Z]') THEN 'internal' ELSE 'public' END AS visibility,
 marked OR coalesce(CASE WHEN language = 'go' THEN regexp_matches(name, '^[A-Z]') WHEN language = 'python' THEN name NOT LIKE '\\_%' ESCAPE '\\' END, FALSE) AS is_exported, coalesce(regexp_matches(doc_comment, '(?i)@deprecated\\b'), FALSE) AS is_deprecated FROM cs3 LEFT JOIN csc USING (symbol_id))"""
_JS = "language IN ('typescript', 'tsx', 'javascript', 'jsx')"


def _sql_probes(base: str, exts: list[str]) -> str:
    tails = ["", *exts, *(f"/{i}{e}" for e in exts for i in resolve.INDEX)]
    return f"[{base} || x FOR x IN {_list(tails)}]"


_TARGET = f"{_at(DIRS, 't')} || '/m' || t || '/' || {_at(STEMS, 't')}"
_OUT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTERNAL.items())
IMPORTS = f"""ci0 AS (SELECT o_orderkey AS ord, o_custkey AS k, o_orderkey % 1499 + 1 AS t FROM orders WHERE o_custkey IN (SELECT p_partkey FROM part)),
ci1 AS (SELECT ci0.*, cf.file_id, cf.rel_path, cf.language, {sql_language('cf.rel_path')} AS lang, {_TARGET} AS target, repeat('../', len(cf.rel_path) - len(replace(cf.rel_path, '/', ''))) AS up FROM ci0 JOIN cf ON cf.k = ci0.k),
ci2 AS (SELECT *, CASE WHEN lang IN ('typescript', 'tsx', 'javascript', 'jsx') THEN up || target || CASE WHEN ord % 2 = 0 THEN '.js' ELSE '' END WHEN lang IN ('python', 'java', 'kotlin') THEN replace(target, '/', '.')
 WHEN lang = 'go' THEN '{GO_MODULE}/' || regexp_replace(target, '/[^/]*$', '') WHEN lang = 'rust' THEN 'crate::' || replace(regexp_replace(target, '^src/', ''), '/', '::') || '::Item' ELSE up || target END AS inside FROM ci1),
ci3 AS (SELECT *, CASE WHEN ord % 5 = 0 THEN coalesce(CASE lang {_OUT} END, inside) ELSE inside END AS specifier FROM ci2),
ci4 AS (SELECT *, regexp_replace(specifier, '^(\\.\\./)+', '') AS bare, replace(specifier, '.', '/') AS slashed, string_split(specifier, '::')[2:] AS rest FROM ci3),
ci5 AS (SELECT *, CASE WHEN {_JS} THEN CASE WHEN specifier LIKE '.%' THEN {_sql_probes("regexp_replace(bare, '[.][mc]?js$', '')", resolve.JS_EXT)} END WHEN language = 'python' THEN flatten([{', '.join(_sql_probes(f"'{p}' || slashed", ['.py', '.pyi']) for p in ('', 'src/', 'lib/', 'app/'))}])
 WHEN language IN ('java', 'kotlin') THEN [x || slashed || '.java' FOR x IN {_list(resolve.JVM_ROOTS)}] || [x || slashed || '.kt' FOR x IN {_list(resolve.JVM_ROOTS)}]
 WHEN language = 'rust' AND specifier LIKE 'crate::%' THEN flatten([{_sql_probes("'src/' || array_to_string(rest[1:n], '/')", ['.rs'])} FOR n IN range(len(rest), 0, -1)])
 WHEN language = 'go' AND specifier LIKE '{GO_MODULE}%' THEN [substr(specifier, {len(GO_MODULE) + 2}) || '/*.go'] WHEN language IN ('c', 'cpp', 'markdown') AND regexp_matches(specifier, '^[./]') THEN {_sql_probes('bare', resolve.PLAIN_EXT)} END AS cand FROM ci4),
ck AS (SELECT rel_path AS path, file_id FROM cf UNION ALL SELECT d || '/*.go', arg_min(file_id, rel_path) FROM (SELECT regexp_replace(rel_path, '/[^/]*$', '') AS d, * FROM cf WHERE rel_path LIKE '%.go') GROUP BY d),
cih AS (SELECT ord, arg_min(ck.file_id, pos) AS target_file_id FROM (SELECT ord, unnest(cand) AS path, unnest(range(1, len(cand) + 1)) AS pos FROM ci5) JOIN ck USING (path) GROUP BY 1),
ci AS (SELECT ci5.ord, ci5.file_id, ci5.rel_path, specifier, target_file_id, {_sql_name('t * 3', 't')} AS name, CAST(ci5.ord % 90 + 1 AS INT) AS line, CASE WHEN target_file_id IS NOT NULL THEN NULL
 WHEN {_JS} THEN CASE WHEN regexp_matches(specifier, '^([./]|node:)') THEN NULL WHEN specifier LIKE '@%/%' THEN regexp_extract(specifier, '^[^/]+/[^/]+') ELSE string_split(specifier, '/')[1] END WHEN language = 'python' THEN CASE WHEN specifier NOT LIKE '.%' THEN string_split(specifier, '.')[1] END
 WHEN language = 'go' THEN CASE WHEN specifier LIKE '%.%' THEN specifier END WHEN language IN ('java', 'kotlin', 'csharp') THEN array_to_string(string_split(specifier, '.')[1:2], '.') WHEN language = 'rust' THEN CASE WHEN string_split(specifier, '::')[1] NOT IN ('crate', 'self', 'super') THEN string_split(specifier, '::')[1] END END AS external_package FROM ci5 LEFT JOIN cih USING (ord))"""
_KIND = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in resolve.EDGE_KIND.items())
REFERENCES = f"""cr0 AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS ord, {_sql_name('l_suppkey', 'l_suppkey')} AS name, CASE {_at(KINDS_OF_REFERENCE, 'l_linenumber')} {_KIND} END AS kind, CAST(1 + l_linenumber * 7 AS INT) AS line, CASE WHEN l_linenumber % 2 = 1 THEN {_sql_name('l_partkey * 3', 'l_partkey')} END AS from_symbol FROM lineitem),
crs AS (SELECT file_id, name, arg_max(target_file_id, ord) AS scope_file FROM ci WHERE target_file_id IS NOT NULL GROUP BY 1, 2),
crl AS (SELECT file_id, name, arg_min(symbol_id, ord) AS first_id, arg_max(symbol_id, ord) AS last_id FROM cs GROUP BY 1, 2),
crn AS (SELECT name, count(*) AS n, arg_min(symbol_id, (CASE WHEN is_exported THEN 0 ELSE 1 END, rel_path, ord)) AS any_id FROM cs GROUP BY 1),
crq AS (SELECT file_id, qualified_name, arg_max(symbol_id, ord) AS source_id FROM cs GROUP BY 1, 2),
cr AS (SELECT cf.file_id, cf.rel_path, r.ord, r.name, r.kind, r.line, coalesce(source_id, cf.file_id) AS from_id, coalesce(a.first_id, b.last_id, any_id) AS to_id,
 CASE WHEN coalesce(a.first_id, b.last_id, CASE WHEN n = 1 THEN any_id END) IS NOT NULL THEN 'exact' WHEN any_id IS NOT NULL THEN 'heuristic' END AS confidence
 FROM cr0 r JOIN cf ON cf.k = r.k LEFT JOIN crs ON crs.file_id = cf.file_id AND crs.name = r.name LEFT JOIN crl a ON a.file_id = scope_file AND a.name = r.name LEFT JOIN crl b ON b.file_id = cf.file_id AND b.name = r.name LEFT JOIN crn ON crn.name = r.name LEFT JOIN crq ON crq.file_id = cf.file_id AND crq.qualified_name = r.from_symbol)"""
EDGES = f"""cei AS (SELECT 'imports' AS kind, file_id AS from_id, target_file_id AS to_id, file_id, min(line) AS line, 'exact' AS confidence FROM ci WHERE target_file_id IS NOT NULL GROUP BY file_id, target_file_id),
cer AS (SELECT kind, from_id, to_id, arg_min(file_id, (rel_path, ord)) AS file_id, arg_min(line, (rel_path, ord)) AS line, arg_min(confidence, (rel_path, ord)) AS confidence FROM cr WHERE to_id IS NOT NULL GROUP BY 1, 2, 3),
ce AS (SELECT {sql_id('e_', 'edge', 'kind', 'from_id', 'to_id')} AS edge_id, * FROM (SELECT * FROM cei UNION ALL SELECT * FROM cer))"""
ALL = ", ".join([FILES, SYMBOLS, IMPORTS, REFERENCES, EDGES])
