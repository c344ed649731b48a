"""What a path says about its file: language, binary, generated, test, and its parts."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of each language, one string a language.
EXTENSIONS = {
    "c": "c h", "cpp": "cc cpp cxx hh hpp", "csharp": "cs", "go": "go", "java": "java", "javascript": "cjs js mjs", "json": "json jsonc", "jsx": "jsx",
    "kotlin": "kt kts", "markdown": "markdown md mdx", "python": "py pyi", "rust": "rs", "sql": "sql", "terraform": "hcl tf tfvars", "tsx": "tsx",
    "typescript": "cts mts ts", "yaml": "yaml yml",
}
BY_EXTENSION = {e: lang for lang, all_ in EXTENSIONS.items() for e in all_.split()}
BY_NAME = {"containerfile": "dockerfile", "dockerfile": "dockerfile", "go.mod": "go", "go.sum": "go", **{f"docker-compose.{e}": "yaml" for e in ("yaml", "yml")}, **{f"{n}.json": "json" for n in ("package", "tsconfig")}}
LANGUAGES = sorted({*EXTENSIONS, "dockerfile"})
BINARY = sorted(
    "7z a avi avif avro bin bmp bz2 class db dll dylib eot exe gif gz ico jar jpeg jpg lib mdb mkv mov mp3 mp4 node o obj ogg otf parquet pdb pdf png pyc pyo rar so sqlite sqlite3 svgz tgz tiff ttf war wasm wav webm webp woff woff2 xz zip zst".split()
)


def _dirs(names: str, flags: str = "(?i)") -> str:
    return f"{flags}(^|/)({'|'.join(sorted(names.split()))})/"


GENERATED = [_dirs("gen autogen generated __generated__"), r"(?i)\.(designer|g|generated|pb)\.[a-z]+$", r"(?i)(^|/)migrations?/[0-9]+", r"\.d\.ts$", r"_pb2(_grpc)?\.py$", r"(?i)(^|/)zz_generated"]
#: Paths of tests to the indexer; search has its own, narrower notion.
TESTS = [_dirs("e2e integration spec specs test tests __tests__"), r"(?i)\.(spec|test)\.[a-z]+$", r"(^|/)test_[^/]+\.py$", r"[^/]+_test\.(go|py|rb)$", r"Tests?\.(cs|java|kt)$"]
SEARCH_TESTS = [_dirs("e2e spec test tests __tests__"), r"(?i)\.(spec|test)\.[a-z]+$"]
BUILD_OUTPUT = _dirs("build dist generated vendor", "")
SHEBANGS = [(r"^#!.*\bpython[0-9.]*\b", "python"), (r"^#!.*\bnode\b", "javascript"), (r"^#!.*\bts-node\b", "typescript")]
HEADER = r"(?im)^(?:.{0,4}\s*)(?:@generated\b|Code generated by |DO NOT EDIT|AUTO-?GENERATED)"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """All before the last slash; empty for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case letters after the last dot of the name; empty without one, or where the dot is first."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def to_posix(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def normalize(path: Column) -> Column:
    """``path`` without ``.``, empty and resolvable ``..`` segments."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = F.when((F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(s)))
        return F.when(s.isin("", "."), done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def join_relative(from_path: Column, specifier: Column) -> Column:
    """``specifier`` as seen from the folder of ``from_path``."""
    return normalize(F.concat_ws("/", dir_name(from_path), specifier))


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def language_of(path: Column, overrides: dict[str, str] | None = None) -> Column:
    """By whole name, then ``dockerfile.*``, then extension (an override first); null if unknown."""
    name, ext = F.lower(base_name(path)), extension(path)
    table = BY_EXTENSION | (overrides or {})
    by_name = F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv])
    by_ext = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(by_name, name), F.when(name.startswith("dockerfile."), F.lit("dockerfile")), F.try_element_at(by_ext, ext))


def language_of_shebang(first_line: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, lang in reversed(SHEBANGS):
        out = F.when(first_line.rlike(pattern), F.lit(lang)).otherwise(out)
    return out


def is_binary_extension(path: Column) -> Column:
    return extension(path).isin(BINARY)


def looks_binary(content: Column) -> Column:
    """A byte 0 among the first 8192."""
    return F.instr(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), "\0") > 0


def is_generated_path(path: Column) -> Column:
    return any_of(path, GENERATED)


def has_generated_header(text: Column) -> Column:
    return F.left(text, F.lit(512)).rlike(HEADER)


def is_test_path(path: Column) -> Column:
    return any_of(path, TESTS)


def is_search_test_path(path: Column) -> Column:
    return any_of(path, SEARCH_TESTS)


def count_lines(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("int")


# ----- driver side: where a path may lead ------------------------------------------
def is_within(root: str, path: str) -> bool:
    r, p = Path(root).resolve(), Path(path).resolve()
    return p == r or r in p.parents


def within(root: str, relative: str) -> str:
    """The absolute path of ``relative``; ValueError if it leaves ``root``, by links too."""
    if PurePosixPath(relative).is_absolute() or "\0" in relative:
        raise ValueError(f"not a relative path: {relative}")
    path = Path(root, relative)
    if not is_within(root, str(path)):
        raise ValueError(f"{relative} leaves the root")
    return str(path.resolve())


def containing_root(roots: list[str], path: str) -> str | None:
    """The innermost root that holds ``path``."""
    return max((r for r in roots if is_within(r, path)), key=lambda r: len(Path(r).resolve().parts), default=None)
