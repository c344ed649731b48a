"""The query surface: eighteen tools over the tables of a store.

Each gives a DataFrame, or a text where the answer is one.
"""

from __future__ import annotations

import os
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, render
from ..functions.paths import is_search_test_path, within
from ..functions.text import Query, analyse
from ..operators import diagrams, graph, health, lookup, search
from ..schemas import Repo
from ..sources.store import Store
from .index import index

DOCUMENT_KINDS = ("readme", "architecture", "onboarding")
FOOT = ["", "---", "_Drafted from a static index. Verify every claim before publishing._"]


class NotFound(LookupError):
    """What was asked for isn't in the index."""


class Refused(PermissionError):
    """A write without leave; ``preview`` is what would have been written."""

    def __init__(self, message: str, preview: str):
        super().__init__(message)
        self.preview = preview


class Tools:
    def __init__(self, spark: SparkSession, store: Store, config: dict, clock=time.time):
        self.spark, self.store, self.config, self.clock = spark, store, config, clock

    # ----- workspaces ------------------------------------------------------------
    def root(self, workspace: str | None = None) -> str:
        roots = self.config["workspace"]["roots"]
        if workspace is None and len(roots) == 1:
            return roots[0]
        hit = [r for r in roots if workspace in (r, os.path.basename(r.rstrip("/")))]
        if len(hit) != 1:
            raise NotFound(f"no single workspace {workspace!r} among {roots}")
        return hit[0]

    def repo(self, workspace: str | None = None) -> Repo:
        rid = self._id(self.root(workspace))
        if self.store.metadata(rid) is None:
            raise NotFound("This workspace is not indexed yet: run scan_repository first.")
        return self.store.repo(rid)

    def _id(self, root: str) -> str:
        return self.spark.range(1).select(ids.repo_id(F.lit(root)).alias("i")).first().i

    def list_workspaces(self) -> DataFrame:
        """root, reachable, file_count, symbol_count, age_min (null: not indexed)."""
        rows = []
        for root in self.config["workspace"]["roots"]:
            m = self.store.metadata(self._id(root))
            age = None if m is None else round((self.clock() * 1000 - m["indexed_at_ms"]) / 60_000)
            rows.append((root, os.access(root, os.R_OK), m and m["file_count"], m and m["symbol_count"], age))
        return self.spark.createDataFrame(rows, "root string, reachable boolean, file_count bigint, symbol_count bigint, age_min int")

    def scan_repository(self, workspace: str | None = None, force: bool = False) -> dict:
        return index(self.spark, self.store, self.root(workspace), self.config, force)

    def refresh_index(self, workspace: str | None = None) -> dict:
        report = self.scan_repository(workspace)
        return {k: report[k] for k in ("files_changed", "files_removed", "symbol_count", "elapsed_ms")}

    # ----- navigation ------------------------------------------------------------
    def search_code(self, query: str, workspace: str | None = None, limit: int | None = None, path_prefix: str | None = None, include_tests: bool = False) -> DataFrame:
        """rank, rel_path, start_line, end_line, symbol, score, reasons, snippet."""
        r, s = self.repo(workspace), self.config["search"]
        posts = self.store.read("postings", self._id(self.root(workspace)))
        n = limit or s["limit"]
        hits = search_chunks(r, posts, analyse(query), n, path_prefix, include_tests, s["rrf_k"], s["boost"], s["snippet_lines"])
        block = F.concat_ws("\n", "rel_path", F.array_join("reasons", "; "), "snippet")
        out = self.config["output"]
        return lookup.within_budget(hits.withColumn("block", block), "block", ["rank"], out["max_bytes"], out["reserve_bytes"]).drop("block", "used").orderBy("rank")

    def find_symbol(self, name: str, workspace: str | None = None, kind: str | None = None, exact: bool = False, limit: int = 20) -> DataFrame:
        r = self.repo(workspace)
        return lookup.symbols(r.symbols, name, exact, [kind] if kind else None, limit=limit).withColumn("line", render.symbol_line())

    def _exact(self, r: Repo, name: str, most: int, path: str | None = None) -> list:
        rows = lookup.symbols(r.symbols, name, True, path_prefix=path, limit=most).collect()
        if not rows:
            raise NotFound(f'No symbol named "{name}" was found.')
        return rows

    def find_references(self, name: str, workspace: str | None = None, include_heuristic: bool = True, limit: int = 100) -> DataFrame:
        """target, kind, caller, location, confidence."""
        r = self.repo(workspace)
        self._exact(r, name, 1)
        targets = lookup.symbols(r.symbols, name, True, limit=10)
        return lookup.references(r, targets, not include_heuristic, limit).orderBy("target", "location", "kind", "caller")

    def explain_file(self, path: str, workspace: str | None = None) -> DataFrame:
        """section, position, text: what a file defines, imports, is imported by, and its churn."""
        r = self.repo(workspace)
        f = r.files.where(F.col("rel_path") == path)
        if f.isEmpty():
            raise NotFound(f"{path} is not in the index.")
        me = f.select("file_id")
        about = f.select(F.lit("about").alias("section"), F.lit(0).alias("position"), F.concat(F.coalesce("language", F.lit("unknown language")), F.lit(", "), F.col("line_count").cast("string"), F.lit(" lines"), F.when(F.col("is_test"), ", test file").otherwise(""), F.when(F.col("is_generated"), ", generated").otherwise("")).alias("text"))
        defines = r.symbols.join(me, "file_id", "left_semi").orderBy("start_line", "symbol_id").limit(40).select(F.lit("defines").alias("section"), F.col("start_line").alias("position"), render.symbol_line().alias("text"))
        mark = F.when(F.col("external_package").isNotNull(), " (external)").when(F.col("target_file_id").isNull(), " — unresolved").otherwise("")
        imports = r.imports.join(me, "file_id", "left_semi").orderBy("line", "specifier").limit(30).select(F.lit("imports").alias("section"), F.col("line").alias("position"), F.concat("specifier", mark).alias("text"))
        by = r.edges.where("kind = 'imports'").join(me.withColumnRenamed("file_id", "to_id"), "to_id", "left_semi").join(r.files.select("file_id", "rel_path"), "file_id").orderBy("rel_path").limit(25)
        by = by.select(F.lit("imported by").alias("section"), F.lit(0).alias("position"), F.col("rel_path").alias("text"))
        churn = lookup.churn(r.commit_files.where(F.col("rel_path") == path), r.commits).select(F.lit("churn").alias("section"), F.lit(0).alias("position"), F.col("churn").cast("string").alias("text"))
        return reduce(DataFrame.unionByName, [about, defines, imports, by, churn])

    def explain_symbol(self, name: str, workspace: str | None = None, path: str | None = None) -> DataFrame:
        """symbol, direction (calls, called by), peer, peer_path, peer_line, confidence."""
        r = self.repo(workspace)
        s = self._exact(r, name, 5, path)[0]
        out = lookup.ends(lookup.edges(r.edges, ["calls"], from_id=s.symbol_id, limit=40), r, "to").withColumn("direction", F.lit("calls"))
        inn = lookup.ends(lookup.edges(r.edges, ["calls"], to_id=s.symbol_id, limit=40), r, "from").withColumn("direction", F.lit("called by"))
        return out.unionByName(inn).select(F.lit(s.qualified_name).alias("symbol"), "direction", "peer", "peer_path", "peer_line", "confidence")

    def trace_execution(self, source: str, target: str | None = None, workspace: str | None = None, max_depth: int = 8) -> tuple[DataFrame, diagrams.Diagram]:
        """(symbols of the path by step, or reachable ones by depth; a diagram)."""
        r = self.repo(workspace)
        a = self._exact(r, source, 1)[0]
        calls = lookup.edges(r.edges, ["calls"], limit=None)
        if target is not None:
            b = self._exact(r, target, 1)[0]
            path = graph.shortest_path(calls, a.symbol_id, b.symbol_id, max_depth)
            steps = self.spark.createDataFrame(list(enumerate(path or [], 1)), "step int, symbol_id string")
            rows = steps.join(r.symbols, "symbol_id").orderBy("step")
            return rows, diagrams.sequence([x.asDict() for x in rows.collect()])  # at most max_depth + 1 rows
        reach = graph.reachable(calls, [a.symbol_id], max_depth, max_nodes=60)
        rows = reach.select(F.col("node").alias("symbol_id"), "depth").join(r.symbols, "symbol_id").orderBy("depth", "symbol_id")
        got = rows.select("symbol_id", "qualified_name").collect()  # at most 60
        shown = [a.symbol_id, *(x.symbol_id for x in got)]
        between = [(e.from_id, e.to_id, e.confidence) for e in calls.where(F.col("from_id").isin(shown) & F.col("to_id").isin(shown)).orderBy("edge_id").collect()]
        return rows, diagrams.call_graph(a.asDict(), [x.asDict() for x in got], between)

    # ----- architecture ----------------------------------------------------------
    def project_overview(self, workspace: str | None = None) -> DataFrame:
        """section, position, text."""
        r = self.repo(workspace)

        def section(name: str, df: DataFrame, text, order: list, most: int) -> DataFrame:
            from pyspark.sql import Window

            return df.orderBy(*order).limit(most).select(F.lit(name).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("position"), text.alias("text"))

        langs = r.files.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n"))
        ep = graph.entry_points(r.symbols, r.edges, r.files)
        lay = graph.layers(r.symbols, r.files).groupBy("layer").agg(F.count("*").alias("n"))
        count = F.concat(F.lit(": "), F.col("n").cast("string"), F.when(F.col("n") == 1, " file").otherwise(" files"))
        parts = [
            section("summary", r.documents.where("kind = 'readme'"), F.col("summary"), ["rel_path"], 1),
            section("size", r.repositories, F.format_string("%d files, %d symbols, %d edges", "file_count", "symbol_count", "edge_count"), ["repo_id"], 1),
            section("languages", langs, F.concat("language", count), [F.desc("n"), "language"], 10),
            section("frameworks", lookup.frameworks(r.imports, r.files), F.concat("label", F.lit(" ("), "category", F.lit(") — "), F.element_at("evidence", 1)), ["id"], 12),
            section("packages", r.packages, F.concat("name", F.lit(" at "), F.when(F.col("rel_path") == "", ".").otherwise(F.col("rel_path"))), ["name"], 15),
            section("entry points", ep, F.concat("qualified_name", F.lit(" ("), "reason", F.lit(") — "), render.citation(F.col("rel_path"), F.col("start_line"))), ["rel_path", "start_line", "symbol_id"], 15),
            section("structure", lay, F.concat("layer", count), [F.desc("n"), "layer"], 10),
            section("documentation", r.documents, F.concat("rel_path", F.lit(" — "), "title"), ["rel_path"], 10),
        ]
        return reduce(DataFrame.unionByName, parts)

    def dependency_graph(self, workspace: str | None = None, focus: str | None = None, max_nodes: int = 40) -> diagrams.Diagram:
        """The import graph, or what is near one file; import cycles in the note."""
        r = self.repo(workspace)
        e = lookup.edges(r.edges, ["imports"], limit=None)
        if focus is not None:
            f = r.files.where(F.col("rel_path") == focus).first()
            if f is None:
                raise NotFound(f"{focus} is not in the index.")
            e = graph.neighbourhood(e, f.file_id)
        d = diagrams.dependencies(e, r.files, max_nodes)
        cyc = health.circular_imports(r).select("summary", "detail").collect()  # at most 15
        d.note = "\n".join([*([d.note] if d.note else []), *(f"{c.summary}: {c.detail}" for c in cyc)]) or None
        return d

    def architecture_diagram(self, view: str, workspace: str | None = None) -> diagrams.Diagram:
        r = self.repo(workspace)
        if view == "layers":
            return diagrams.layer_view(graph.layers(r.symbols, r.files))
        if view == "folders":
            return diagrams.folders(r.files)
        if view == "hotspots":
            return diagrams.hotspots(lookup.hotspots(r, 15).collect())
        raise ValueError("view is layers, folders or hotspots")

    def list_entry_points(self, workspace: str | None = None) -> DataFrame:
        """reason, symbol, location; at most 30 a reason."""
        from pyspark.sql import Window

        r = self.repo(workspace)
        ep = graph.entry_points(r.symbols, r.edges, r.files)
        nth = Window.partitionBy("reason").orderBy("rel_path", "start_line", "symbol_id")
        return ep.withColumn("nth", F.row_number().over(nth)).where("nth <= 30").select("reason", F.col("qualified_name").alias("symbol"), render.citation(F.col("rel_path"), F.col("start_line")).alias("location")).orderBy("reason", "location", "symbol")

    # ----- history and health ----------------------------------------------------
    def recent_changes(self, workspace: str | None = None, days: int = 14, limit: int = 40) -> DataFrame:
        """section (commits, churn, contributors), position, key, text, n."""
        from pyspark.sql import Window

        r = self.repo(workspace)
        since = int(self.clock() * 1000) - days * 86_400_000
        order = [F.desc("timestamp_ms"), F.col("sha")]
        commits = r.commits.where(F.col("timestamp_ms") >= since).orderBy(*order).limit(limit)
        a = commits.select(F.lit("commits").alias("section"), F.row_number().over(Window.orderBy(*order)).alias("position"), "sha", F.concat("subject", F.lit(" — "), "author_name").alias("text"), F.lit(1).cast("long").alias("n")).withColumnRenamed("sha", "key").where("position <= 25")
        churn = lookup.churn(r.commit_files, r.commits, since).orderBy(F.desc("churn"), "rel_path").limit(15)
        b = churn.select(F.lit("churn").alias("section"), F.row_number().over(Window.orderBy(F.desc("churn"), "rel_path")).alias("position"), F.col("rel_path").alias("key"), F.lit(None).cast("string").alias("text"), F.col("churn").alias("n"))
        who = commits.groupBy("author_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author_name").limit(10)
        c = who.select(F.lit("contributors").alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "author_name")).alias("position"), F.col("author_name").alias("key"), F.lit(None).cast("string").alias("text"), "n")
        return a.unionByName(b).unionByName(c)

    def repository_health(self, workspace: str | None = None, category: str | None = None) -> DataFrame:
        return health.findings(self.repo(workspace), category=category)

    def find_dead_code(self, workspace: str | None = None, limit: int = 40) -> DataFrame:
        return health.dead_code(self.repo(workspace), limit).orderBy("position")

    # ----- documents -------------------------------------------------------------
    def draft_documentation(self, kind: str, workspace: str | None = None) -> str:
        if kind not in DOCUMENT_KINDS:
            raise ValueError(f"kind is one of {DOCUMENT_KINDS}")
        r, root = self.repo(workspace), self.root(workspace)
        name = os.path.basename(root.rstrip("/")) or "project"
        # every list below is short: a limit stands before each collect
        eps = graph.entry_points(r.symbols, r.edges, r.files).orderBy("rel_path", "start_line", "symbol_id").limit(12).collect()
        lay = graph.layers(r.symbols, r.files)
        if kind == "readme":
            langs = r.files.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(5).collect()
            readme = r.documents.where("kind = 'readme'").orderBy("rel_path").select("summary").first()
            top = lay.groupBy("layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer").limit(8).collect()
            stack = [f"- {x.language} ({x.n} files)" for x in langs] + [f"- {x.label}" for x in lookup.frameworks(r.imports, r.files).limit(8).collect()]
            return "\n".join([f"# {name}", "", readme.summary if readme and readme.summary else "_Describe the project here._", "", "## Stack", *stack, "", "## Entry points", *(f"- `{e.qualified_name}` — `{e.rel_path}:{e.start_line}` ({e.reason})" for e in eps[:10]), "", "## Layout", *(f"- `{x.layer}` — {x.n} files" for x in top), *FOOT])
        if kind == "architecture":
            cyc = health.circular_imports(r, 6).collect()
            n = r.files.count()
            areas = lay.select("layer").distinct().count()
            return "\n".join([f"# {name} — architecture", "", f"{n} files across {areas} top-level areas.", "", "## Layers", "```mermaid", diagrams.layer_view(lay).text, "```", "", "## Entry points", *(f"- {e.qualified_name} ({e.reason})" for e in eps), "", "## Import cycles" if cyc else "## No import cycles detected", *(f"- {c.detail}" for c in cyc), *FOOT])
        hot = lookup.hotspots(r, 8).collect()
        docs = r.documents.orderBy("rel_path").limit(10).collect()
        return "\n".join([f"# Onboarding: {name}", "## Start here", *(f"1. `{e.rel_path}:{e.start_line}` — {e.qualified_name} ({e.reason})" for e in eps[:6]), "## Files that change most (and are most complex)", *(f"- `{h.rel_path}` — {h.churn} commits, complexity {h.complexity}, hottest: {h.top_symbol}" for h in hot), "## Existing documentation", *([f"- `{d.rel_path}` — {d.title}" for d in docs] or ["- None found."]), *FOOT[1:]])

    def write_documentation(self, kind: str, output_path: str, workspace: str | None = None, confirm: bool = False) -> dict:
        """Writes a draft below the root: only with the setting, and with ``confirm``."""
        text = self.draft_documentation(kind, workspace)
        if not self.config["security"]["allow_writes"]:
            raise Refused("writes are off in the settings", text)
        if not confirm:
            raise Refused("confirm the draft to write it", text)
        at = Path(within(self.root(workspace), output_path))
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")
        return {"path": output_path, "chars": len(text)}


TOOLS = [n for n in vars(Tools) if not n.startswith("_") and n not in ("root", "repo")]


def search_chunks(r: Repo, posts: DataFrame, query: Query, limit: int = 12, path_prefix: str | None = None, include_tests: bool = False, rrf_k: int = 60, boost: float = 0.35, snippet: int = 40, candidates: int = 60) -> DataFrame:
    """Search end to end: postings and symbol names ranked, fused, re-ranked, filtered, cut to snippets.

    Up to the join with texts, everything after the postings is at most
    ``candidates`` + 150 rows.
    """
    spark = posts.sparkSession
    stats = posts.groupBy("chunk_id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    idx = search.Index.__new__(search.Index)
    idx.key, idx.postings, idx.n, idx.avgdl = "chunk_id", posts, stats.n, stats.avgdl or 1.0
    best = search.top(search.bm25(idx, query.clauses()), "chunk_id", candidates)
    lex = best.join(r.chunks.select("chunk_id", "rel_path", "start_line", "end_line", "symbol_id", "text"), "chunk_id")
    sym = search.rank_symbols(r.symbols, query)
    spots = ["rel_path", "start_line"]
    fused = search.fuse([lex, sym], spots, rrf_k)
    a = lex.groupBy(*spots).agg(F.min_by(F.struct("end_line", "symbol_id", "text"), "rank").alias("c"))
    b = sym.groupBy(*spots).agg(F.min_by(F.struct("end_line", "symbol_id", "signature"), "rank").alias("s"))
    x = fused.join(a, spots, "left").join(b, spots, "left")
    # the variant that has a symbol wins
    sid = F.coalesce("c.symbol_id", "s.symbol_id")
    chunk_wins = F.col("c.symbol_id").isNotNull() | F.col("s").isNull()
    x = x.select(*spots, "fused", sid.alias("symbol_id"), F.when(chunk_wins, F.col("c.end_line")).otherwise(F.col("s.end_line")).alias("end_line"), F.when(chunk_wins, F.col("c.text")).otherwise(F.col("s.signature")).alias("body"))
    inbound = r.edges.where(F.col("kind").isin("calls", "references")).groupBy(F.col("to_id").alias("symbol_id")).agg(F.count("*").alias("inbound"))
    x = x.join(r.symbols.select("symbol_id", "qualified_name", "is_exported", "role"), "symbol_id", "left").join(inbound, "symbol_id", "left")
    x = search.rerank(x, boost)
    if not include_tests:
        x = x.where(~is_search_test_path(F.col("rel_path")))
    if path_prefix:
        x = x.where(F.col("rel_path").startswith(path_prefix))
    from pyspark.sql import Window

    order = [F.round("final", 9).desc(), F.col("rel_path"), F.col("start_line")]
    out = x.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    assert spark is not None
    return out.select("rank", "rel_path", "start_line", "end_line", F.col("qualified_name").alias("symbol"), F.round("final", 4).alias("score"), "reasons", render.clamp_lines(F.coalesce("body", F.lit("")), snippet)["text"].alias("snippet"))
