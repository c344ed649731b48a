"""Git history without a git binary: loose and packed objects, commits, changes, blobs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.redact import redact

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


class Git:
    """Reads the objects and refs of one repository."""

    def __init__(self, root: str):
        at = Path(root, ".git")
        if at.is_file():  # a worktree
            at = Path(root, at.read_text().split(":", 1)[1].strip())
        self.dir = at
        common = at / "commondir"
        self.common = (at / common.read_text().strip()).resolve() if common.exists() else at
        self.packs = [p for p in sorted((self.common / "objects/pack").glob("*.idx"))]
        self._index: dict[Path, tuple] = {}

    # ----- objects ---------------------------------------------------------------
    def read(self, oid: str) -> tuple[str, bytes]:
        """(kind, content); KeyError if there is none."""
        loose = self.common / "objects" / oid[:2] / oid[2:]
        if loose.exists():
            raw = zlib.decompress(loose.read_bytes())
            head, _, body = raw.partition(b"\0")
            return head.split()[0].decode(), body
        for idx in self.packs:
            at = self._find(idx, bytes.fromhex(oid))
            if at is not None:
                with open(idx.with_suffix(".pack"), "rb") as f:
                    return self._packed(f, at)
        raise KeyError(oid)

    def _find(self, idx: Path, oid: bytes) -> int | None:
        if idx not in self._index:
            d = idx.read_bytes()
            if d[:8] != b"\xfftOc\x00\x00\x00\x02":
                raise ValueError("pack index version")
            self._index[idx] = (d, int.from_bytes(d[8 + 255 * 4 : 8 + 256 * 4], "big"))
        d, n = self._index[idx]
        fan = 8
        lo = int.from_bytes(d[fan + (oid[0] - 1) * 4 : fan + oid[0] * 4], "big") if oid[0] else 0
        hi = int.from_bytes(d[fan + oid[0] * 4 : fan + oid[0] * 4 + 4], "big")
        names = fan + 1024
        while lo < hi:
            mid = (lo + hi) // 2
            got = d[names + mid * 20 : names + mid * 20 + 20]
            if got == oid:
                small = names + n * 24 + mid * 4
                v = int.from_bytes(d[small : small + 4], "big")
                if v & 1 << 31:
                    big = names + n * 28 + (v & (1 << 31) - 1) * 8
                    v = int.from_bytes(d[big : big + 8], "big")
                return v
            lo, hi = (mid + 1, hi) if got < oid else (lo, mid)
        return None

    def _packed(self, f, at: int) -> tuple[str, bytes]:
        f.seek(at)
        c = f.read(1)[0]
        kind, shift = c >> 4 & 7, 4
        while c & 128:
            c = f.read(1)[0]
            shift += 7
        if kind == 6:
            c = f.read(1)[0]
            back = c & 127
            while c & 128:
                c = f.read(1)[0]
                back = (back + 1 << 7) | c & 127
            delta = self._inflate(f)
            name, base = self._packed(f, at - back)
        elif kind == 7:
            oid = f.read(20).hex()
            delta = self._inflate(f)
            name, base = self.read(oid)
        else:
            return KINDS[kind], self._inflate(f)
        return name, _patched(base, delta)

    @staticmethod
    def _inflate(f) -> bytes:
        z, out = zlib.decompressobj(), b""
        while not z.eof:
            out += z.decompress(f.read(65536))
        return out

    # ----- refs ------------------------------------------------------------------
    def _packed_refs(self) -> dict[str, str]:
        p = self.common / "packed-refs"
        lines = p.read_text().splitlines() if p.exists() else []
        return {name: oid for oid, name in (x.split() for x in lines if x[:1] not in "#^")}

    def resolve(self, ref: str = "HEAD") -> str | None:
        for base in (self.dir, self.common):
            p = base / ref
            if p.is_file():
                v = p.read_text().strip()
                return self.resolve(v[5:]) if v.startswith("ref: ") else v
        return self._packed_refs().get(ref)

    def head(self) -> str | None:
        return self.resolve()

    def branch(self) -> str | None:
        v = (self.dir / "HEAD").read_text().strip()
        return v.removeprefix("ref: refs/heads/") if v.startswith("ref: ") else None

    def names(self, kind: str) -> list[str]:
        """Branches (``heads``) or tags (``tags``)."""
        top = self.common / "refs" / kind
        loose = [str(p.relative_to(top)) for p in top.rglob("*") if p.is_file()] if top.exists() else []
        prefix = f"refs/{kind}/"
        return sorted({*loose, *(n.removeprefix(prefix) for n in self._packed_refs() if n.startswith(prefix))})

    # ----- commits and trees -----------------------------------------------------
    def commit(self, oid: str) -> dict:
        _, body = self.read(oid)
        head, _, message = body.decode("utf-8", "replace").partition("\n\n")
        out: dict = {"sha": oid, "parents": [], "subject": message.split("\n")[0]}
        for line in head.split("\n"):
            key, _, v = line.partition(" ")
            if key == "tree":
                out["tree"] = v
            elif key == "parent":
                out["parents"].append(v)
            elif key == "author":
                who, _, rest = v.rpartition("> ")
                name, _, mail = who.partition(" <")
                out |= {"author_name": name, "author_email": mail, "timestamp_ms": int(rest.split()[0]) * 1000}
        return out

    def log(self, limit: int) -> Iterator[dict]:
        """Commits from HEAD, the newest first."""
        import heapq

        start = self.head()
        if not start:
            return
        first = self.commit(start)
        heap, seen = [(-first["timestamp_ms"], start, first)], {start}
        while heap and limit > 0:
            _, _, c = heapq.heappop(heap)
            yield c
            limit -= 1
            for p in c["parents"]:
                if p not in seen:
                    seen.add(p)
                    try:
                        pc = self.commit(p)
                    except KeyError:  # a shallow clone ends here
                        continue
                    heapq.heappush(heap, (-pc["timestamp_ms"], p, pc))

    def entries(self, tree: str | None) -> dict[str, tuple[bool, str]]:
        """name: (is a folder, oid)."""
        if tree is None:
            return {}
        d, at, out = self.read(tree)[1], 0, {}
        while at < len(d):
            end = d.index(b"\0", at)
            mode, _, name = d[at:end].partition(b" ")
            if mode != b"160000":  # not a submodule
                out[name.decode("utf-8", "replace")] = (mode == b"40000", d[end + 1 : end + 21].hex())
            at = end + 21
        return out

    def changes(self, new: str | None, old: str | None, base: str = "") -> Iterator[tuple[str, str]]:
        """(path, add | delete | modify) of files; equal sub-trees aren't opened."""
        a, b = self.entries(old), self.entries(new)
        for name in sorted({*a, *b}):
            x, y = a.get(name), b.get(name)
            if x == y:
                continue
            path = f"{base}{name}"
            if x and x[0] or y and y[0]:
                yield from self.changes(y[1] if y and y[0] else None, x[1] if x and x[0] else None, path + "/")
            if x and not x[0] and y and not y[0]:
                yield path, "modify"
            elif y and not y[0]:
                yield path, "add"
            elif x and not x[0]:
                yield path, "delete"

    def blob(self, tree: str, path: str) -> str | None:
        oid, folder = tree, True
        for part in path.split("/"):
            if not folder:
                return None
            got = self.entries(oid).get(part)
            if got is None:
                return None
            folder, oid = got
        return None if folder else self.read(oid)[1].decode("utf-8", "replace")


def _patched(base: bytes, delta: bytes) -> bytes:
    at = 0

    def size() -> int:
        nonlocal at
        v = shift = 0
        while True:
            c = delta[at]
            at += 1
            v |= (c & 127) << shift
            shift += 7
            if not c & 128:
                return v

    size(), size()
    out = []
    while at < len(delta):
        c = delta[at]
        at += 1
        if c & 128:
            offset = length = 0
            for k in range(4):
                if c >> k & 1:
                    offset |= delta[at] << 8 * k
                    at += 1
            for k in range(3):
                if c >> 4 + k & 1:
                    length |= delta[at] << 8 * k
                    at += 1
            length = length or 0x10000
            out.append(base[offset : offset + length])
        else:
            out.append(delta[at : at + c])
            at += c
    return b"".join(out)


# ----- Spark ---------------------------------------------------------------------
def history(spark: SparkSession, root: str, limit: int = 5000, merges: bool = False) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of the newest ``limit`` commits.

    The log is walked on the driver (a few fields a commit, ``limit`` of them); the
    trees are compared by tasks, each commit with its first parent.
    """
    git, repo = Git(root), ids.repo_id(F.lit(root))
    rows = []
    for c in git.log(limit):
        merge = len(c["parents"]) > 1
        if merges or not merge:
            parent = git.commit(c["parents"][0])["tree"] if c["parents"] else None
            rows.append((c["sha"], c["author_name"], c["author_email"], c["timestamp_ms"], c["subject"], merge, c["tree"], parent))
    log = spark.createDataFrame(rows, "sha string, author_name string, author_email string, timestamp_ms bigint, subject string, is_merge boolean, tree string, parent_tree string")

    def run(batches):
        g = Git(root)
        for b in batches:
            out = [(sha, p, how) for sha, new, old in zip(*(c.to_pylist() for c in b.columns), strict=True) for p, how in g.changes(new, old)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["sha", "rel_path", "change_type"])

    tasks = max(1, min(64, len(rows) // 50))
    changed = log.repartition(tasks, "sha").select("sha", "tree", "parent_tree").mapInArrow(run, "sha string, rel_path string, change_type string")
    files = changed.select(repo.alias("repo_id"), "sha", "rel_path", "change_type")
    n = files.groupBy("sha").agg(F.count("*").cast("int").alias("files_changed"))
    zero = F.lit(0)
    commits = log.join(n, "sha", "left").select(
        ids.commit_id(repo, F.col("sha")).alias("commit_id"), repo.alias("repo_id"), "sha", redact(F.col("author_name")).alias("author_name"), "author_email", "timestamp_ms",
        F.left(redact(F.col("subject")), F.lit(300)).alias("subject"), "is_merge", F.coalesce("files_changed", zero).alias("files_changed"), zero.alias("insertions"), zero.alias("deletions"),
    )
    return commits, files


def revisions(spark: SparkSession, root: str, path: str, most: int = 60) -> DataFrame:
    """(ord, sha, author_name, timestamp_ms, text) of the newest revisions of a file; ord 0 is the newest."""
    git, rows, last = Git(root), [], None
    for c in git.log(1 << 30):
        text = git.blob(c["tree"], path)
        parent = git.blob(git.commit(c["parents"][0])["tree"], path) if c["parents"] else None
        if text is not None and text != parent:
            rows.append((len(rows), c["sha"], c["author_name"], c["timestamp_ms"], text))
            if len(rows) == most:
                break
    return spark.createDataFrame(rows, "ord int, sha string, author_name string, timestamp_ms bigint, text string")


def blame(revs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, line, text, sha): for each line of the newest revision, the oldest that has such a line.

    ``revs``: key, ord (0: the newest), sha, text.  Equal lines share their
    revision.  One exchange on (key, line text): an aggregate, and a join with the
    newest revision's lines.
    """
    key = key or []
    lines = revs.select(*key, "ord", "sha", F.posexplode(F.split("text", "\n")).alias("pos", "line_text"))
    first = lines.groupBy(*key, "line_text").agg(F.max_by("sha", "ord").alias("sha"))
    now = lines.where("ord = 0").select(*key, (F.col("pos") + 1).alias("line"), "line_text")
    return now.join(first, [*key, "line_text"]).select(*key, "line", F.col("line_text").alias("text"), "sha")


def latest(revs: DataFrame, key: str, order: str, most: int = 60) -> DataFrame:
    """The newest ``most`` revisions of each key, numbered from 0."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("sha"))
    return revs.withColumn("ord", F.row_number().over(w) - 1).where(F.col("ord") < most)
