"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Base spans come from three patterns (assign, access, hex).  The method looks at
each candidate's value over the whole corpus: its hash is counted by distinct
owners and distinct repositories.  A value that many owners have is a copied
example; one that few have, and whose characters look random, is live.  The same
test adds spans: long mixed tokens outside the base patterns are kept, as kind
``owned``, only where few owners have them and they look live.

The texts are read once.  Only rows with candidates go on, and of those only the
candidates and the lengths between them.  Counting is distinct first, so a value
in a third of all rows shrinks before the shuffle; joining the counts back is
salted.

Edge cases: null and empty texts have no spans; a null owner or repository counts
as one of its own kind; equal rows are each returned (rows are told apart by
position, not by doc_id); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, text_key, whole

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run that is shorter fails whole, wherever in it one starts
HEX = r"[0-9a-f]{24,}"
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "owned")
SALTS = 16
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|(.)\1{5,}|012345|123456|abcdef"


def _matches(text: Column, pattern: str, value: int) -> Column:
    """array<struct<gap, found, value>>: characters before each match since the last, the match, its group ``value``."""
    gaps = F.split(text, pattern, -1)
    all_ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else all_
    rows = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(all_)), all_, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("found"))), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["found"].alias("found"), v.alias("value")))
    none = F.array().cast("array<struct<gap:int,found:int,value:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _looks_live(v: Column) -> Column:
    """Many different characters for its length, and no placeholder."""
    kinds = F.size(F.array_distinct(F.split(v, "")))
    return (kinds >= F.least(F.lit(9), F.length(v) * 2 / 3)) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(PLACEHOLDER)


def candidates(docs: DataFrame, owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, candidates): row_id, doc_id (and text_key, if ``keyed``) of every row; row_id, owner, repo, kind, start, stop, value."""
    text = F.col("__t")
    found = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "owned": (OWNED, 0)}
    base = docs.select(
        *([text_key(text_col).alias("text_key")] if keyed else []),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\0null")).alias("owner"),
        F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in repo])), 256).alias("repo"),
        whole(text_col).alias("__t"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    names = ["row_id", "doc_id", *(["text_key"] if keyed else [])]
    rows = materialize(base.select(*names, "owner", "repo", *[_matches(text, p, g).alias(k) for k, (p, g) in found.items()]))
    some = rows.where(" OR ".join(f"size({k}) > 0" for k in KINDS))
    each = None
    for n, k in enumerate(KINDS):
        x = some.select("row_id", "owner", "repo", F.lit(n).alias("kind"), F.posexplode(k).alias("pos", "m"))
        each = x if each is None else each.unionAll(x)
    before = Window.partitionBy("row_id", "kind").orderBy("pos")
    stop = F.sum(F.col("m.gap") + F.col("m.found")).over(before)
    each = each.select("row_id", "owner", "repo", "kind", (stop - F.col("m.found")).alias("start"), stop.alias("stop"), F.col("m.value").alias("value"))
    fits = (F.col("kind") != 0) | (F.length("value") >= 6)
    return rows.select(*names), each.where(fits)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos of every candidate value: distinct before it is counted."""
    pairs = found.groupBy("hash", "owner", "repo").agg(F.lit(1))
    return pairs.groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"))


def scan(docs: DataFrame, example_owners: int = 4, owner: str = "source", repo: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row a row of ``docs``: doc_id (text_key, if ``keyed``) and found, an array of
    struct<start, kind, stop, hash, n_owners, n_repos, live>, by start and kind.

    ``example_owners`` distinct owners, or more, make a value an example.
    """
    rows, each = candidates(docs, owner, repo, id_col, text_col, keyed)
    live_form = _looks_live(F.col("value"))
    each = materialize(each.select("row_id", "owner", "repo", "kind", "start", "stop", F.sha2("value", 256).alias("hash"), live_form.alias("form")).where("kind < 3 OR form"))
    stats = ownership(each).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = each.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int")).join(stats, ["hash", "salt"])
    known = known.withColumn("live", F.col("form") & (F.col("n_owners") < example_owners)).where("kind < 3 OR live")
    # an added span says nothing where a base span already is
    first = Window.partitionBy("row_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row_id").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("kind") < 3
    known = known.withColumn("reach", F.max(F.when(is_base, F.col("stop"))).over(first)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(later))
    known = known.where("kind < 3 OR ((reach IS NULL OR reach <= start) AND (next IS NULL OR next >= stop))")
    spans = known.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "hash", "n_owners", "n_repos", "live"))).alias("found"))
    none = F.array().cast(spans.schema["found"].dataType)
    return rows.join(spans, "row_id", "left").select(*rows.columns, F.coalesce("found", none).alias("found"))


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, the digest of base spans, and all spans."""
    base = F.filter("found", lambda x: x["kind"] < 3)

    def said(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda x: F.concat_ws(":", _name(x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with the spans of ``found`` (in order of start) replaced; overlapping ones once."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s, x):
        fresh = x["start"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["stop"]).cast("long").alias("at"))

    return F.aggregate(found, zero, step, lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))


def redact_documents(docs: DataFrame, example_owners: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with secrets that aren't copied examples replaced in the text.

    Every row stays, and each is redacted by its own text, whatever its id; n_chars,
    where there is one, follows the text.
    """
    cols = docs.columns
    key, spans = fresh(docs, "__key", "__found")
    found = scan(docs, example_owners, id_col=id_col, text_col=text_col, keyed=True)
    hit = found.select(F.col("text_key").alias(key), F.filter("found", lambda x: x["n_owners"] < example_owners).alias(spans)).where(F.size(spans) > 0)
    # equal texts have equal spans, so they are joined by their text, and no copy of the texts is kept
    hit = hit.groupBy(key).agg(F.first(spans).alias(spans))
    out = docs.join(hit, text_key(text_col) == F.col(key), "left")
    text = F.when(F.col(spans).isNotNull(), redacted(F.col(text_col), F.col(spans))).otherwise(F.col(text_col))
    out = out.withColumn(text_col, text)
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*cols)
