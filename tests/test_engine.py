import hashlib

import pytest
from pyspark.sql import functions as F

from codeintel import registry
from codeintel.functions.ids import stable_id
from codeintel.functions.redact import DETECTORS, redact
from codeintel.functions.text import analyse, split_identifier, stem
from codeintel.operators import graph

TINY = "/root/testdata/sf0.001"


def test_split_and_stem(spark):
    rows = spark.createDataFrame([("parseUTF8String_HTTPServer-x",), ("",), ("getUserById",)], "s string").select(split_identifier(F.col("s")).alias("w")).collect()
    assert [r.w for r in rows] == [["parse", "utf8", "string", "http", "server", "x"], [], ["get", "user", "by", "id"]]
    words = {"queries": "query", "classes": "class", "boxes": "box", "tokens": "token", "status": None, "signing": "sign", "signed": "sign", "cat": None}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == words


def test_query_terms():
    q = analyse('how are "token pairs" signed')
    assert q.terms == ("signed", "sign") and q.phrases == ("token pairs",) and not q.looks_like_symbol
    assert analyse("getUserById").looks_like_symbol and analyse("get_user").clauses()[0] == ["get", "user"]
    assert "jwt" in analyse("where is auth").expanded and "auth" not in analyse("where is auth").expanded
    assert analyse("???").terms == () and analyse("the is a").clauses() == [] and len(analyse("auth queue database payment").expanded) == 24
    assert analyse("constructor").terms == ("constructor",)


def test_ids(spark):
    import base64

    got = spark.createDataFrame([("r", "a/b")], "r string, p string").select(stable_id("f_", "file", F.col("r"), F.col("p")).alias("i")).first().i
    assert got == "f_" + base64.urlsafe_b64encode(hashlib.sha1(b"file\0r\0a/b").digest()).decode()[:22]


def test_redaction_fires_and_repeats(spark):
    text = "AKIA" + "Z" * 16 + " gh" + "p_" + "a" * 36 + " tok" + "en = '" + "q1" * 8 + "' db://u:" + "pw123" + "@h"
    df = spark.createDataFrame([(text,)], "t string").select(redact(F.col("t")).alias("a")).select("a", redact(F.col("a")).alias("b"))
    r = df.first()
    assert r.a == r.b
    assert r.a.count("[REDACTED:") == 4
    assert len(DETECTORS) == 13


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "from_id long, to_id long")


def test_reach_and_path(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    assert {(r.node, r.depth) for r in graph.reachable(e, [1], 6).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert graph.shortest_path(e, 1, 4) == [1, 2, 3, 4]
    assert graph.shortest_path(e, 1, 1) == [1]
    assert graph.shortest_path(e, 4, 1) is None


@pytest.mark.parametrize("rest", [200_000, 0])
def test_strong_components(spark, rest):
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5), (4, 6)])
    got = {(r.node, r.component) for r in graph.strong_components(e, rest=rest).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert {r.cycle for r in graph.cycles(e).collect()} == {"component 1", "component 3", "loop 5"}


def test_reach_stops_at_a_number_of_nodes(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 5)])
    assert [r.node for r in graph.reachable(e, [1], 6, max_nodes=2).orderBy("node").collect()] == [2, 3]
    assert [r.node for r in graph.reachable(e, [1], 6, max_nodes=1).collect()] == [2]
    assert {(r.node, r.depth) for r in graph.reachable(e, [5], 6, reverse=True).collect()} == {(3, 1), (1, 2)}


def test_tarjan_long_chain():
    assert len(set(graph._tarjan((i, i + 1) for i in range(50_000)).values())) == 50_001


@pytest.mark.parametrize("name", ["hotspots", "files_by_language", "bm25", "search_documents"])
def test_queries_run(spark, name):
    assert registry.QUERIES[name](spark, TINY).count() > 0


def test_oracles_belong_to_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
