"""Graph operators over edge tables (from_id, to_id): driver-controlled, distributed rounds.

Rounds end in the shared folder.  What reaches the driver are counts and single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def reachable(edges: DataFrame, start: list, max_depth: int = 6, reverse: bool = False, max_nodes: int | None = None) -> DataFrame:
    """(node, depth, path): least depth of every node within ``max_depth``, the start excluded.

    ``path`` leads there from the start, by the least predecessors.  With
    ``max_nodes``, the search stops when so many are found; of the last depth the
    least ids stay.
    """
    spark = edges.sparkSession
    kind = edges.schema["from_id"].dataType.simpleString()
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    e = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).where("a <> b").distinct()
    seen = front = spark.createDataFrame([(s, 0, [s]) for s in start], f"node {kind}, depth int, path array<{kind}>")
    left = max_nodes
    for depth in range(1, max_depth + 1):
        step = front.join(e, front["node"] == e["a"]).groupBy("b").agg(F.min_by("path", "a").alias("p"))
        fresh = step.join(seen.select(F.col("node").alias("b")), "b", "left_anti").select(F.col("b").alias("node"), F.lit(depth).alias("depth"), F.concat("p", F.array("b")).alias("path"))
        if left is not None:
            fresh = fresh.orderBy("node").limit(left)
        front = cut(fresh)
        n = front.count()
        if n:
            seen = seen.unionByName(front)
        if not n or (left is not None and n >= left):
            break
        left = None if left is None else left - n
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, source, target, max_depth: int = 12) -> list | None:
    """The nodes of a shortest path, least predecessor first; None where there is none."""
    if source == target:
        return [source]
    row = reachable(edges, [source], max_depth).where(F.col("node") == target).select("path").first()
    return list(row.path) if row else None


def degrees(edges: DataFrame, cap: int = 40) -> DataFrame:
    """(node, inbound): distinct inbound edges, capped."""
    return edges.groupBy(F.col("to_id").alias("node")).agg(F.least(F.count("*"), F.lit(cap)).alias("inbound"))


def _tarjan(pairs) -> dict:
    """Least node of each node's strong component, with an explicit stack."""
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    held: list = []
    on: set = set()
    root: dict = {}
    for start in out:
        if start in index:
            continue
        work = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        held.append(start), on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    held.append(nxt), on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = held.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    root.update(dict.fromkeys(members, min(members)))
    return root


def _finish(live: DataFrame, kind: str) -> DataFrame:
    """Components of a rest of bounded size, in one task."""

    def run(pdf):
        import pandas as pd

        root = _tarjan(zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
        return pd.DataFrame({"node": list(root), "component": list(root.values())})

    return live.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, f"node {kind}, component {kind}")


def strong_components(edges: DataFrame, rest: int = 200_000, max_rounds: int = 1000, trims: int = 8) -> DataFrame:
    """(node, component) of strongly connected components of more than one node; component: the least node.

    Rounds of trimming (nodes without edges in or out lie in no cycle) and of
    forward-backward colouring, each on what the one before left, until at most
    ``rest`` edges are left: they, a few MB at most, end in one task.  Chains are
    trimmed at most ``trims`` layers a round, as the colouring cuts them too.
    """
    kind = edges.schema["from_id"].dataType.simpleString()
    live = cut(edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).where("a <> b").distinct())
    n, out = live.count(), None
    for _ in range(max_rounds):
        for _ in range(trims):
            if n <= rest:
                break
            kept = cut(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            was, live, n = n, kept, kept.count()
            if n == was:
                break
        if n <= rest:
            break
        found = _colour(live)
        out = found if out is None else out.unionByName(found)
        done = found.select("node")
        live = cut(live.join(done.withColumnRenamed("node", "a"), "a", "left_anti").join(done.withColumnRenamed("node", "b"), "b", "left_anti"))
        n = live.count()
    else:
        raise RuntimeError("strong components did not converge")
    last = _finish(live, kind)
    all_ = last if out is None else out.unionByName(last)
    big = all_.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return all_.join(big, "component").select("node", "component")


def _colour(live: DataFrame) -> DataFrame:
    """Components that hold the least node of all that reach them: the least label goes forward to a fixpoint, then back within its colour."""
    colour = live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("c", F.col("node"))
    while True:
        push = live.join(colour, live["a"] == colour["node"]).select(F.col("b").alias("node"), "c")
        new = cut(colour.unionByName(push).groupBy("node").agg(F.min("c").alias("c")))
        same = new.join(colour.withColumnRenamed("c", "old"), "node").where("c <> old").isEmpty()
        colour = new
        if same:
            break
    inside = live.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c"))
    inside = cut(inside)
    found = front = cut(colour.where("node = c").select("node", "c"))
    while not front.isEmpty():
        front = cut(inside.join(front.select(F.col("node").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct().join(found, ["node", "c"], "left_anti"))
        found = found.unionByName(front)
    return found.select("node", F.col("c").alias("component"))


def cycles(edges: DataFrame, **options) -> DataFrame:
    """(cycle, node): strong components, and nodes with an edge to themselves once more as cycles of one."""
    self_loops = edges.where("from_id = to_id").select(F.col("from_id").alias("node")).distinct()
    big = strong_components(edges, **options)
    return big.select(F.concat(F.lit("component "), F.col("component").cast("string")).alias("cycle"), "node").unionByName(self_loops.select(F.concat(F.lit("loop "), F.col("node").cast("string")).alias("cycle"), "node"))


def neighbourhood(edges: DataFrame, focus, hops: int = 2, max_nodes: int = 60) -> DataFrame:
    """The edges between nodes at most ``hops`` from ``focus``, either way."""
    near = reachable(edges, [focus], hops, max_nodes=max_nodes).unionByName(reachable(edges, [focus], hops, True, max_nodes)).select("node")
    kind = edges.schema["from_id"].dataType.simpleString()
    near = near.unionByName(edges.sparkSession.createDataFrame([(focus,)], f"node {kind}")).distinct()
    return edges.join(near.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(near.withColumnRenamed("node", "to_id"), "to_id", "left_semi").select(*edges.columns)


EXECUTABLE = ["function", "method", "constructor", "class", "route"]


def entry_points(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with ``reason``: the first of four signs that execution begins there."""
    called = edges.where("kind = 'calls'").select(F.col("to_id").alias("symbol_id")).distinct().withColumn("called", F.lit(True))
    x = symbols.where(F.col("kind").isin(EXECUTABLE)).join(called, "symbol_id", "left").join(files.select("rel_path", F.col("is_test").alias("in_test")), "rel_path", "left")
    reason = (
        F.when(F.col("role") == "controller", F.lit("HTTP route or controller"))
        .when(F.col("role").isin("worker", "job"), F.lit("background worker or scheduled job"))
        .when((F.col("role") == "entrypoint") | F.col("name").rlike("^(main|Main|bootstrap|start|serve)$"), F.lit("process entry function"))
        .when(F.col("is_exported") & F.col("called").isNull() & ~F.coalesce("in_test", F.lit(True)) & F.col("rel_path").rlike("(^|/)(bin|cmd|scripts?)/"), F.lit("exported and uncalled in an executable directory"))
    )
    return x.withColumn("reason", reason).where("reason IS NOT NULL").drop("called", "in_test")


def layers(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, layer): the role of a file's first symbol that has one, else its top folder (a root file's own name)."""
    order: Column = F.struct("start_line", "symbol_id")
    role = symbols.where("role <> 'unknown'").groupBy("rel_path").agg(F.min_by("role", order).alias("role"))
    x = files.where("skip_reason IS NULL").select("rel_path").join(role, "rel_path", "left")
    return x.select("rel_path", F.coalesce("role", F.substring_index("rel_path", "/", 1)).alias("layer"))
