"""Diagrams as Mermaid text, from bounded rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dir_name

PREFERRED = ["controller", "middleware", "service", "repository", "model", "config"]


@dataclass
class Diagram:
    text: str
    nodes: int
    aggregated: bool = False
    note: str | None = None


def node_id(s: str) -> str:
    s = re.sub("_+", "_", re.sub("[^A-Za-z0-9_]", "_", s))
    return f"n{s}" if s[:1].isdigit() else s


def label(s: str, most: int = 42) -> str:
    return re.sub(r'["\[\]{}()|]', " ", "…" + s[1 - most :] if len(s) > most else s)


def _box(s: str, more: str = "") -> str:
    return f'{node_id(s)}["{label(s)}{more}"]'


def pair_weights(edges: DataFrame, files: DataFrame, max_nodes: int = 40) -> tuple[DataFrame, int, bool]:
    """((from, to, weight) by falling weight, number of files, whether folders stand for files).

    Folders do when more than ``max_nodes`` files take part.
    """
    path = files.select("file_id", "rel_path")
    e = edges.where("kind = 'imports'").join(path.select(F.col("file_id").alias("from_id"), F.col("rel_path").alias("a")), "from_id").join(path.select(F.col("file_id").alias("to_id"), F.col("rel_path").alias("b")), "to_id")
    n = e.select(F.explode(F.array("a", "b")).alias("p")).distinct().count()
    if n > max_nodes:
        folder = lambda c: F.when(dir_name(F.col(c)) == "", F.lit("(root)")).otherwise(dir_name(F.col(c)))
        e = e.select(folder("a").alias("a"), folder("b").alias("b"))
    pairs = e.where("a <> b").groupBy(F.col("a").alias("from"), F.col("b").alias("to")).agg(F.count("*").alias("weight"))
    return pairs, n, n > max_nodes


def dependencies(edges: DataFrame, files: DataFrame, max_nodes: int = 40) -> Diagram:
    """The heaviest pairs first, until ``max_nodes`` nodes are shown; then only pairs between those.

    Until then every pair adds at least a new node or lies between shown ones, so
    the first ``max_nodes`` squared decide the nodes; the rest is a semi join.
    """
    pairs, n, folded = pair_weights(edges, files, max_nodes)
    order = [F.desc("weight"), F.col("from"), F.col("to")]
    head = pairs.orderBy(*order).limit(max_nodes**2 + 1).collect()
    shown: dict[str, None] = {}
    for a, b, _ in head:
        if len(shown) >= max_nodes:
            break
        shown |= {a: None, b: None}
    names = list(shown)
    rows = pairs.where(F.col("from").isin(names) & F.col("to").isin(names)).orderBy(*order).collect() if names else []
    lines = [f"  {_box(a)} {f'-- {w} -->' if w > 1 else '-->'} {_box(b)}" for a, b, w in rows]
    note = f"Collapsed to directories: {n} files exceeded the {max_nodes}-node budget." if folded else None
    return Diagram("\n".join(["graph LR", *lines]), len(shown), folded, note)


def layer_view(layers: DataFrame, most: int = 10) -> Diagram:
    """``layers``: rel_path, layer."""
    counts = layers.groupBy("layer").agg(F.count("*").alias("n"))
    total = counts.count()
    shown = counts.orderBy(F.desc("n"), "layer").limit(most).collect()
    place = {v: i for i, v in enumerate(PREFERRED)}
    order = sorted(shown, key=lambda r: place.get(r.layer, len(place)))
    lines = ["graph TD", *(f'  {_box(r.layer, f"<br/>{r.n} files")}' for r in shown), *(f"  {node_id(a.layer)} --> {node_id(b.layer)}" for a, b in zip(order, order[1:]))]
    return Diagram("\n".join(lines), len(shown), total > most, f"{total - most} smaller layers omitted." if total > most else None)


def call_graph(root: dict, reached: list[dict], edges: list[tuple[str, str, str]], max_nodes: int = 30) -> Diagram:
    """``reached``: symbols (symbol_id, qualified_name) by depth; edges: (from, to, confidence) between them."""
    shown = {root["symbol_id"]: root["qualified_name"]} | {r["symbol_id"]: r["qualified_name"] for r in reached[: max_nodes - 1]}
    box = lambda i: f'{node_id(i)}["{label(shown[i])}"]'
    lines = ["graph TD", f"  {box(root['symbol_id'])}:::root"]
    lines += [f"  {box(a)} {'-.->' if c == 'heuristic' else '-->'} {box(b)}" for a, b, c in edges if a in shown and b in shown]
    lines.append("  classDef root fill:#2d6cdf,color:#fff,stroke-width:0px;")
    over = len(reached) + 1 > max_nodes
    note = "Dotted edges are guesses: their names have several definitions."
    return Diagram("\n".join(lines), len(shown), over, f"Showing {len(shown)} of {len(reached) + 1} reachable symbols. {note}" if over else note)


def sequence(path: list[dict]) -> Diagram:
    """``path``: symbols (name, rel_path) in call order; participants are files."""
    owner = [r["rel_path"].rsplit("/", 1)[-1] for r in path]
    lines = ["sequenceDiagram", "  autonumber", *(f"  participant {node_id(o)} as {label(o)}" for o in dict.fromkeys(owner))]
    lines += [f"  {node_id(a)}->>{node_id(b)}: {label(r['name'])}" for a, b, r in zip(owner, owner[1:], path[1:])]
    return Diagram("\n".join(lines), len(path))


def folder_counts(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """(dir, n): files under each folder of at most ``max_depth`` levels."""
    parts = F.split("rel_path", "/")
    deep = F.least(F.size(parts) - 1, F.lit(max_depth))
    dirs = F.when(deep > 0, F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return files.select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def folders(files: DataFrame, max_depth: int = 3, max_nodes: int = 60) -> Diagram:
    counts = folder_counts(files, max_depth)
    total = counts.count()
    rows = counts.orderBy(F.desc("n"), "dir").limit(max_nodes).collect()
    shown = {r.dir for r in rows}
    lines = ["graph TD", '  root["/"]']
    for r in rows:
        above, _, last = r.dir.rpartition("/")
        lines.append(f'  {node_id(above) if above in shown else "root"} --> {node_id(r.dir)}["{label(last)}<br/>{r.n} files"]')
    return Diagram("\n".join(lines), len(rows), total > max_nodes, f"{total - max_nodes} directories omitted." if total > max_nodes else None)


def hotspots(rows: list, most: int = 15) -> Diagram:
    """``rows``: rel_path, churn, complexity."""
    lines = [f'  {_box(r.rel_path, f"<br/>{r.churn} changes × {r.complexity} complexity")}' for r in rows[:most]]
    return Diagram("\n".join(["graph LR", *lines]), len(lines), len(rows) > most)
