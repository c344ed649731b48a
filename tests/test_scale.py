"""What large tables ask of a plan: nothing wide is broadcast, shuffled twice or spelled out in many rows."""

import pytest
from pyspark.sql import functions as F

from codeintel.operators import resolve
from codeintel.sources import codeview

TINY = "/root/testdata/sf0.001"


def plan_of(df):
    """The plan as it ran."""
    q = df._jdf.queryExecution()
    q.executedPlan().execute().count()
    return q.executedPlan().toString().partition("== Initial Plan ==")[0]


@pytest.fixture
def kept(spark):
    """A small file's texts are not known from its bytes: as with a large one, Spark's default threshold decides."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_symbols_are_never_broadcast_and_shuffled_once(kept):
    df = resolve.symbols(codeview.raw_symbols(kept, TINY), codeview.files(kept, TINY))
    plan = plan_of(df)
    assert "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the symbols and their files


def test_containers_are_the_last_before(spark):
    files = spark.createDataFrame([("a", "f", "r", "go", False)], "rel_path string, file_id string, repo_id string, language string, is_test boolean")
    rows = [(0, "A", None), (1, "x", "A"), (2, "A", None), (3, "y", "A"), (4, "z", "A.y"), (5, "w", "late"), (6, "late", None)]
    raw = spark.createDataFrame([("a", o, n, "class", c) for o, n, c in rows], "rel_path string, ord int, name string, kind string, container string")
    raw = raw.withColumns({k: F.lit(1) for k in ("start_line", "start_column", "end_line", "end_column", "complexity")} | {k: F.lit("") for k in ("signature", "doc_comment", "visibility")} | {k: F.lit(False) for k in ("is_exported", "is_async")})
    got = {r.ord: r for r in resolve.symbols(raw, files).collect()}
    assert len(got) == 7
    held = {o: next((k for k, r in got.items() if r.symbol_id == got[o].container_id), None) for o in got}
    assert held == {0: None, 1: 0, 2: None, 3: 2, 4: 3, 5: None, 6: None}


def test_an_import_has_few_bases(spark):
    cases = [("typescript", "src/a.ts", "./b.js"), ("python", "a/b.py", "x.y"), ("python", "a/b.py", "..y"), ("java", "A.java", "a.B"), ("c", "a/b.c", "./c.h"), ("rust", "src/a.rs", "crate::m::n::T"), ("go", "a.go", "ex.com/m/p"), ("json", "a.json", "x")]
    df = spark.createDataFrame(cases, "l string, p string, s string")
    n = [len(r.b) for r in df.select(resolve.bases(F.col("l"), F.col("p"), F.col("s"), go_module="ex.com/m").alias("b")).collect()]
    assert n == [1, 1, 1, 1, 1, 3, 1, 0]


def test_named_paths_are_the_candidates(spark):
    """Looked up by its bases, an import finds the likeliest of its candidates."""
    paths = ["src/b.ts", "src/b/index.ts", "src/b.d.ts", "src/x/y.py", "x/y/__init__.py", "lib/x/y.pyi", "src/a/B.java", "a/B.kt", "src/m/n.rs", "src/m/mod.rs", "p/z.go", "p/c.go", "a/c.h", "a/c", "src/x.md"]
    imports = [("src/q.ts", "typescript", "./b.js"), ("src/q.ts", "typescript", "./b/"), ("q.py", "python", "x.y"), ("src/x/q.py", "python", ".y"), ("q.java", "java", "a.B"), ("q.rs", "rust", "crate::m::n::T"), ("q.rs", "rust", "crate::m::o::T"), ("q.go", "go", "ex.com/m/p"), ("a/q.c", "c", "./c"), ("a/q.c", "c", "./c.h"), ("q.md", "markdown", "./src/x"), ("q.ts", "typescript", "react")]
    langs = {p: lang for p, lang, _ in imports}
    files = spark.createDataFrame([(p, p, "r", langs.get(p, "go" if p.endswith(".go") else None)) for p in [*paths, *langs]], "rel_path string, file_id string, repo_id string, language string")
    raw = spark.createDataFrame([(p, i, s, [], False, 1) for i, (p, _, s) in enumerate(imports)], "rel_path string, ord int, specifier string, symbols array<string>, is_type_only boolean, line int")
    got = {r.ord: r.target_file_id for r in resolve.imports(raw, files, go_module="ex.com/m").collect()}
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(imports)], "ord int, p string, l string, s string").select("ord", resolve.candidates(F.col("l"), F.col("p"), F.col("s"), go_module="ex.com/m").alias("c"))
    known = {p: p for p in [*paths, *langs]} | {"p/*.go": "p/c.go", "*.go": "q.go"}
    assert got == {r.ord: next((known[x] for x in r.c if x in known), None) for r in c.collect()}
    assert sum(t is not None for t in got.values()) == 11


def test_references_are_shuffled_once(spark, tmp_path):
    raw = spark.createDataFrame([("a", 1, "f", "call", 3, "g"), ("a", 2, "f", "call", 4, "g"), ("a", 3, "h", "call", 5, None), ("b", 4, "f", "call", 1, None), ("gone", 5, "f", "call", 1, None), ("b", 6, "nowhere", "call", 1, None)], "rel_path string, ord int, name string, kind string, line int, from_symbol string")
    syms = spark.createDataFrame([("s1", "r", "A", "a", "f", "f", True, 0), ("s2", "r", "A", "a", "g", "g", True, 1), ("s3", "r", "C", "c", "h", "h", True, 0), ("s4", "r", "C", "c", "f", "f", True, 1), ("s5", "r", "C", "c", "f", "f", True, 2)], "symbol_id string, repo_id string, file_id string, rel_path string, name string, qualified_name string, is_exported boolean, ord int")
    imported = spark.createDataFrame([("b", "B", "C", 0, ["f"])], "rel_path string, file_id string, target_file_id string, ord int, symbols array<string>")
    files = spark.createDataFrame([(p, p.upper(), "r") for p in "abc"], "rel_path string, file_id string, repo_id string")
    resolved = resolve.resolve_references(raw, syms, imported, files)
    got = {r.ord: (r.from_id, r.to_id, r.confidence) for r in resolved.collect()}
    assert got == {1: ("s2", "s1", "exact"), 2: ("s2", "s1", "exact"), 3: ("A", "s3", "exact"), 4: ("B", "s4", "exact"), 6: ("B", None, None)}
    edges = resolve.reference_edges(resolved)
    assert {(r.from_id, r.to_id, r.file_id, r.line) for r in edges.collect()} == {("s2", "s1", "A", 3), ("A", "s3", "A", 5), ("B", "s4", "B", 1)}
    assert "hashpartitioning(rel_path#" in (plan := plan_of(edges)) and "kind#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


def test_postings_are_made_in_their_rows(spark):
    from codeintel.operators import search

    docs = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, "x")], "k int, text string")
    df = search.postings(docs, "k", "text")
    assert {(r.k, r.term, r.tf, tuple(r.positions), r.dl) for r in df.collect()} == {(1, "a", 2, (1, 4), 6), (1, "b", 3, (0, 2, 5), 6), (1, "c", 1, (3,), 6), (3, "x", 1, (0,), 1)}
    assert "Exchange" not in plan_of(df) and "Aggregate" not in plan_of(df)


def test_nearest_by_small_pieces(spark):
    """Pieces smaller than ``k``, ties across them and vectors that aren't numbers give what one piece gives."""
    from codeintel.operators import search

    rows = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(40, [0.0, 0.0]), (41, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "k long, e array<float>").repartition(2)
    got = {p: {(r.query_id, r.k, round(r.cosine, 6)) for r in search.nearest(v, v.where("k in (0, 1)"), "k", "e", 5, piece=p).collect()} for p in (3, 10_000)}
    assert got[3] == got[10_000] and {k for q, k, _ in got[3] if q == 0} == {0, 3, 6, 9, 12}
