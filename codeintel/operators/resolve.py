"""Second pass: symbols with ids, imports to files, references to symbols, chunks.

Everything is a join on names or paths; what the order of files decides is carried
as (rel_path, ord).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import roles as R
from ..functions.paths import dir_name, join_relative, normalize
from ..functions.redact import redact
from ..functions.text import search_text
from ..shared import cut

JS = ["typescript", "tsx", "javascript", "jsx"]
JS_EXT = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
PLAIN_EXT = [".h", ".hpp", ".md", ""]
INDEX = ["index", "__init__", "mod", "main"]
JVM_ROOTS = ["src/main/java/", "src/main/kotlin/", "src/", ""]
EDGE_KIND = {"call": "calls", "extends": "extends", "implements": "implements", "instantiate": "instantiates", "reference": "references"}


# ----- symbols -------------------------------------------------------------------
def symbols(raw: DataFrame, files: DataFrame) -> DataFrame:
    """The ``symbols`` table (and ord) of raw symbols (rel_path, ord, and the fields of an extractor's symbol).

    Equal (kind, qualified name) in a file get ordinals; the container is the last
    symbol of its name before.  Rows are shuffled once, by path, and never broadcast:
    Spark sizes them by the few bytes they are made of, not by their texts.
    """
    qualified = F.when(F.col("container").isNull(), F.col("name")).otherwise(F.concat_ws(".", "container", "name"))
    x = raw.withColumn("qualified_name", qualified).hint("merge").join(files.select("rel_path", "file_id", "repo_id", "language", "is_test"), "rel_path")
    nth = Window.partitionBy("rel_path", "file_id", "kind", "qualified_name").orderBy("ord")
    x = x.withColumn("ordinal", F.row_number().over(nth) - 1)
    x = x.withColumn("symbol_id", ids.symbol_id(F.col("repo_id"), F.col("rel_path"), F.col("kind"), F.col("qualified_name"), F.col("ordinal")))
    # a row a symbol under its own name; where it has a container, that one only offers its id, and another under the container's name looks for one
    alone = F.col("container").isNull()
    owner = F.struct(F.col("qualified_name").alias("key"), F.col("symbol_id").alias("offered"), alone.alias("kept"))
    member = F.struct(F.col("container").alias("key"), F.lit(None).cast("string").alias("offered"), F.lit(True).alias("kept"))
    x = x.withColumn("at", F.explode(F.when(alone, F.array(owner)).otherwise(F.array(owner, member)))).withColumns({k: F.col("at")[k] for k in ("key", "offered", "kept")})
    before = Window.partitionBy("rel_path", "file_id", "key").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("container_id", F.when(~alone, F.last("offered", ignorenulls=True).over(before))).where("kept")
    lang, name = F.col("language"), F.col("name")
    return x.select(
        "symbol_id", "repo_id", "file_id", "rel_path", "name", "qualified_name", "kind",
        R.infer_role(F.col("rel_path"), name, F.col("signature"), F.col("is_test")).alias("role"),
        R.normalize_visibility(F.col("visibility"), lang, name).alias("visibility"),
        "start_line", "start_column", "end_line", "end_column", "container_id", redact(F.col("signature")).alias("signature"), redact(F.col("doc_comment")).alias("doc_comment"),
        (F.col("is_exported") | F.coalesce(R.exported_by_convention(lang, name), F.lit(False))).alias("is_exported"),
        "is_async", R.is_deprecated(F.col("doc_comment")).alias("is_deprecated"), "complexity", "ord",
    )


# ----- imports -------------------------------------------------------------------
def _tails(extensions: list[str]) -> list[str]:
    """What may follow a base: nothing, each extension, an index file of each."""
    return ["", *extensions, *(f"/{i}{e}" for e in extensions for i in INDEX)]


#: What may stand before and after a base in each family of languages, the likeliest first.
RULES = {
    "js": [("", t) for t in _tails(JS_EXT)],
    "python": [("", t) for t in _tails([".py", ".pyi"])],
    "module": [(h, t) for h in ("", "src/", "lib/", "app/") for t in _tails([".py", ".pyi"])],
    "jvm": [(r, e) for e in (".java", ".kt") for r in JVM_ROOTS],
    "rust": [("", t) for t in _tails([".rs"])],
    "go": [("", "*.go")],
    "plain": [("", t) for t in _tails(PLAIN_EXT)],
}
BASES = "array<struct<family:string,base:string>>"


def bases(language: Column, path: Column, spec: Column, aliases: dict[str, list[str]] | None = None, packages: list[tuple[str, str]] | None = None, go_module: str | None = None) -> Column:
    """array<struct<family, base>>: the paths that an import may mean are each base between the ends of its family in ``RULES``.

    ``aliases``: patterns and targets of a project's path map; ``packages``: names
    and folders of the workspace's packages; ``go_module``: the root module.  A Go
    path ``folder/*.go`` stands for the first file of that folder.
    """
    none = F.array().cast(BASES)
    of = lambda family, base: F.array(F.struct(F.lit(family).alias("family"), base.alias("base"))).cast(BASES)
    js = F.when(spec.startswith("."), of("js", join_relative(path, F.regexp_replace(spec, r"\.[mc]?js$", ""))))
    bare = []
    for pattern, targets in (aliases or {}).items():
        prefix = pattern.removesuffix("*")
        rest = F.substr(spec, F.lit(len(prefix) + 1))
        for t in targets:
            bare.append(F.when(spec.startswith(prefix), of("js", normalize(F.concat(F.lit(t.removesuffix("*")), rest)))).otherwise(none))
    chosen = F.lit(None).cast("string")
    for name, folder in reversed(packages or []):
        chosen = F.when((spec == name) | spec.startswith(f"{name}/"), F.lit(folder)).otherwise(chosen)
    at = F.when(chosen == "", F.lit("")).otherwise(F.concat(chosen, F.lit("/")))
    if packages:
        bare += [F.when(chosen.isNotNull(), of("js", F.concat(at, F.lit(x)))).otherwise(none) for x in ("src/index", "index")]
    js = js.otherwise(F.flatten(F.array(*bare)) if bare else none)
    dots = F.length(F.regexp_extract(spec, r"^\.+", 0))
    up = F.repeat(F.lit("../"), dots - 1)
    inside = F.translate(F.substr(spec, dots + 1), ".", "/")
    absolute = F.translate(spec, ".", "/")
    python = F.when(spec.startswith("."), of("python", join_relative(path, F.concat(up, inside)))).otherwise(of("module", absolute))
    seg = F.split(spec, "::")
    head, rest = seg[0], F.slice(seg, F.lit(2), F.greatest(F.size(seg) - 1, F.lit(0)))
    folder = F.when(head == "crate", F.lit("src")).when(head == "super", dir_name(dir_name(path))).otherwise(dir_name(path))
    depths = F.when(F.size(rest) > 0, F.sequence(F.size(rest), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    part = lambda n: F.struct(F.lit("rust").alias("family"), normalize(F.concat_ws("/", folder, F.array_join(F.slice(rest, F.lit(1), n), "/"))).alias("base"))
    rust = F.when(head.isin("crate", "self", "super"), F.transform(depths, part).cast(BASES)).otherwise(none)
    if go_module:
        inner = F.regexp_replace(F.substr(spec, F.lit(len(go_module) + 1)), "^/", "")
        go = F.when(spec.startswith(go_module), of("go", F.when(inner == "", F.lit("")).otherwise(F.concat(inner, F.lit("/"))))).otherwise(none)
    else:
        go = none
    plain = F.when(spec.rlike("^[./]"), of("plain", join_relative(path, F.regexp_replace(spec, "^/", "")))).otherwise(none)
    return F.when(language.isin(JS), js).when(language == "python", python).when(language.isin("java", "kotlin"), of("jvm", absolute)).when(language == "rust", rust).when(language == "go", go).when(language.isin("c", "cpp", "markdown"), plain).otherwise(none)


def candidates(language: Column, path: Column, spec: Column, aliases: dict[str, list[str]] | None = None, packages: list[tuple[str, str]] | None = None, go_module: str | None = None) -> Column:
    """array<string>: the paths that ``bases`` mean, the likeliest first."""
    ends = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(h).alias("head"), F.lit(t).alias("tail")) for h, t in v]))])
    return F.flatten(F.transform(bases(language, path, spec, aliases, packages, go_module), lambda b: F.transform(F.element_at(ends, b["family"]), lambda e: F.concat(e["head"], b["base"], e["tail"]))))


def _named(paths: DataFrame) -> DataFrame:
    """(repo_id, family, base, target, place) of (repo_id, path, target): the few bases that mean a path, so that no import is spelled out in all its ways."""
    rules = F.array(*[F.struct(F.lit(k).alias("family"), F.lit(h).alias("head"), F.lit(t).alias("tail"), F.lit(n).alias("place")) for k, v in RULES.items() for n, (h, t) in enumerate(v)])
    p = F.col("path")
    fits = lambda r: p.endswith(r["tail"]) & p.startswith(r["head"]) & (F.length(p) >= F.length(r["head"]) + F.length(r["tail"]))
    x = paths.select("repo_id", "path", "target", F.explode(F.filter(rules, fits)).alias("r"))
    base = F.substr(p, F.length("r.head") + 1, F.length(p) - F.length("r.head") - F.length("r.tail"))
    return x.select("repo_id", "r.family", base.alias("base"), "target", "r.place")


def imports(raw: DataFrame, files: DataFrame, **context) -> DataFrame:
    """The ``imports`` table (and ord) of raw imports (rel_path, ord, specifier, symbols, is_type_only, line).

    Imports that mean the same bases are looked up once.
    """
    at = files.select("rel_path", "file_id", "repo_id", "language")
    x = raw.join(at, "rel_path").withColumn("b", bases(F.col("language"), F.col("rel_path"), F.col("specifier"), **context))
    # what can't be a file is keyed by its own path, so that no task gets all of it
    x = cut(x.withColumn("b", F.when(F.size("b") > 0, F.col("b")).otherwise(F.array(F.struct(F.lit("").alias("family"), F.col("rel_path").alias("base"))).cast(BASES))))
    asked = x.where("b[0].family <> ''").select("repo_id", "b").distinct().select("repo_id", "b", F.posexplode("b").alias("nth", "e")).select("repo_id", "b", "nth", "e.family", "e.base")
    known = files.select("repo_id", F.col("rel_path").alias("path"), F.col("file_id").alias("target"))
    go = files.where(F.col("rel_path").endswith(".go")).groupBy("repo_id", dir_name(F.col("rel_path")).alias("d")).agg(F.min_by("file_id", "rel_path").alias("target"))
    known = known.unionByName(go.select("repo_id", F.when(F.col("d") == "", F.lit("*.go")).otherwise(F.concat("d", F.lit("/*.go"))).alias("path"), "target"))
    # written, so that its size is known before the imports are laid out for it: few targets are sent to them instead
    hit = cut(asked.hint("merge").join(_named(known), ["repo_id", "family", "base"]).groupBy("repo_id", "b").agg(F.min_by("target", F.struct("nth", "place")).alias("target_file_id")))
    external = F.when(F.col("target_file_id").isNull(), R.external_package(F.col("language"), F.col("specifier")))
    return x.join(hit, ["repo_id", "b"], "left").select("repo_id", "file_id", "rel_path", "specifier", "target_file_id", external.alias("external_package"), "symbols", "is_type_only", "line", "ord")


def import_edges(imported: DataFrame) -> DataFrame:
    """Edges from file to file; of several imports of one file, the first line."""
    kind = F.lit("imports")
    x = imported.where("target_file_id IS NOT NULL").groupBy("repo_id", "file_id", "target_file_id").agg(F.min("line").alias("line"))
    return x.select(ids.edge_id(kind, F.col("file_id"), F.col("target_file_id")).alias("edge_id"), "repo_id", kind.alias("kind"), F.col("file_id").alias("from_id"), F.col("target_file_id").alias("to_id"), "file_id", "line", F.lit("exact").alias("confidence"))


# ----- references ----------------------------------------------------------------
def resolve_references(raw: DataFrame, syms: DataFrame, imported: DataFrame, files: DataFrame) -> DataFrame:
    """Raw references (rel_path, ord, name, kind, line, from_symbol) with from_id, to_id and confidence (null: unresolved).

    In order: the first symbol of that name in the file it is imported from (the
    last import of a name counts); the last one in the same file; the only one
    there is; else, as a guess, the first exported one, or the first.

    References and what their files know lie beside each other, by path, which is
    unique in ``files``: windows find one in the other, and nothing is shuffled twice.
    """
    place = F.struct("rel_path", "ord")
    offered = syms.groupBy(F.col("file_id").alias("scope_file"), "name").agg(F.min_by("symbol_id", "ord").alias("scoped_id"))
    scope = imported.where("target_file_id IS NOT NULL").select("rel_path", "target_file_id", "ord", F.explode("symbols").alias("name")).groupBy("rel_path", "name").agg(F.max_by("target_file_id", "ord").alias("scope_file"))
    scope = scope.join(offered, ["scope_file", "name"]).select("rel_path", "name", "scoped_id")
    local = syms.select("rel_path", "name", F.col("qualified_name").alias("from_symbol"), F.col("symbol_id").alias("own_id"), F.col("ord").alias("own_ord"))
    x = raw.select("rel_path", "ord", "name", "kind", "line", "from_symbol", F.lit(True).alias("asks"))
    x = x.unionByName(local, allowMissingColumns=True).unionByName(scope, allowMissingColumns=True).repartition("rel_path")
    named, inside = Window.partitionBy("rel_path", "name"), Window.partitionBy("rel_path", "from_symbol")
    x = x.withColumns({"scoped_id": F.max("scoped_id").over(named), "last_id": F.max_by("own_id", "own_ord").over(named)}).withColumn("source_id", F.max_by("own_id", "own_ord").over(inside)).where("asks")
    x = x.join(files.select("rel_path", "file_id", "repo_id"), "rel_path")
    x = x.withColumns({k: F.when(F.col(of).isNotNull(), F.col(k)) for k, of in (("scoped_id", "name"), ("last_id", "name"), ("source_id", "from_symbol"))})
    by_name = syms.groupBy("repo_id", "name").agg(F.count("*").alias("n_named"), F.min_by("symbol_id", F.struct((~F.col("is_exported")).alias("x"), place.alias("p"))).alias("any_id"))
    x = x.join(by_name, ["repo_id", "name"], "left")
    sure = F.coalesce("scoped_id", "last_id", F.when(F.col("n_named") == 1, F.col("any_id")))
    to = F.coalesce(sure, F.col("any_id"))
    kind = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.lit(kv[1])), EDGE_KIND.items(), F.when(F.lit(False), F.lit("")))
    return x.select(
        "repo_id", "file_id", "rel_path", "ord", "name", kind.alias("kind"), "line", F.coalesce("source_id", "file_id").alias("from_id"), to.alias("to_id"),
        F.when(sure.isNotNull(), F.lit("exact")).when(to.isNotNull(), F.lit("heuristic")).alias("confidence"),
    )


def reference_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each (kind, source, target): that of the first reference.

    A source lies in one file, so that its path is a key too, by which fresh
    references are laid out already.
    """
    x = resolved.where("to_id IS NOT NULL").groupBy("rel_path", "file_id", "repo_id", "kind", "from_id", "to_id").agg(F.min(F.struct("ord", "line", "confidence")).alias("f"))
    return x.select(ids.edge_id(F.col("kind"), F.col("from_id"), F.col("to_id")).alias("edge_id"), "repo_id", "kind", "from_id", "to_id", "file_id", F.col("f.line").alias("line"), F.col("f.confidence").alias("confidence"))


def counters(resolved: DataFrame, imported: DataFrame) -> dict:
    """How much was resolved, and how surely."""
    a = resolved.agg(F.count_if(F.expr("to_id IS NULL")).alias("unresolved_references")).first()
    e = reference_edges(resolved).agg(F.count_if(F.expr("confidence = 'exact'")).alias("exact_edges"), F.count_if(F.expr("confidence = 'heuristic'")).alias("heuristic_edges")).first()
    i = imported.agg(F.count_if(F.expr("target_file_id IS NULL AND external_package IS NULL")).alias("unresolved_imports"), F.count_if(F.expr("external_package IS NOT NULL")).alias("external_imports")).first()
    return a.asDict() | e.asDict() | i.asDict()


# ----- chunks --------------------------------------------------------------------
def chunks(ranges: DataFrame, syms: DataFrame, files: DataFrame) -> DataFrame:
    """The ``chunks`` table of ranges (rel_path, start_line, end_line, symbol, text): redacted text, owner, names of all symbols it overlaps."""
    c = ranges.where(F.length(F.trim("text")) > 0).join(files.select("rel_path", "file_id", "repo_id"), "rel_path")
    c = c.withColumn("chunk_id", ids.chunk_id(F.col("file_id"), F.col("start_line"), F.col("end_line"))).withColumn("text", redact(F.col("text")))
    s = syms.select(F.col("file_id").alias("s_file"), F.col("start_line").alias("s0"), F.col("end_line").alias("s1"), "qualified_name", "ord")
    over = c.select("chunk_id", "file_id", "start_line", "end_line").join(s, (F.col("file_id") == F.col("s_file")) & (F.col("s0") <= F.col("end_line")) & (F.col("s1") >= F.col("start_line")))
    names = over.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "qualified_name"))), lambda v: v["qualified_name"]).alias("names"))
    owner = syms.groupBy("file_id", F.col("qualified_name").alias("symbol")).agg(F.max_by(F.struct("symbol_id", "doc_comment"), "ord").alias("o"))
    x = c.join(names, "chunk_id", "left").join(owner, ["file_id", "symbol"], "left")
    none = F.array().cast("array<string>")
    indexed = search_text(F.col("rel_path"), F.coalesce("names", none), F.col("o.doc_comment"), F.col("text"))
    return x.select("chunk_id", "repo_id", "file_id", "rel_path", F.col("o.symbol_id").alias("symbol_id"), "start_line", "end_line", "text", indexed.alias("search_text")).dropDuplicates(["chunk_id"])
