"""The tables of a repository's index, with keys."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VERSION = 1
_S, _I, _L, _B = "string", "int", "bigint", "boolean"


def _ddl(**columns: str) -> str:
    return ", ".join(f"{t} {c}" if False else f"{c} {t}" for c, t in columns.items())


FILES = _ddl(file_id=_S, repo_id=_S, rel_path=_S, language=_S, size_bytes=_L, line_count=_I, content_hash=_S, mtime_ms=_L, package_name=_S, is_binary=_B, is_generated=_B, is_test=_B, skip_reason=_S)
SYMBOLS = _ddl(
    symbol_id=_S, repo_id=_S, file_id=_S, rel_path=_S, name=_S, qualified_name=_S, kind=_S, role=_S, visibility=_S, start_line=_I, start_column=_I, end_line=_I, end_column=_I,
    container_id=_S, signature=_S, doc_comment=_S, is_exported=_B, is_async=_B, is_deprecated=_B, complexity=_I,
)
EDGES = _ddl(edge_id=_S, repo_id=_S, kind=_S, from_id=_S, to_id=_S, file_id=_S, line=_I, confidence=_S)
IMPORTS = _ddl(repo_id=_S, file_id=_S, specifier=_S, target_file_id=_S, external_package=_S, symbols="array<string>", is_type_only=_B, line=_I)
CHUNKS = _ddl(chunk_id=_S, repo_id=_S, file_id=_S, rel_path=_S, symbol_id=_S, start_line=_I, end_line=_I, text=_S, search_text=_S)
COMMITS = _ddl(commit_id=_S, repo_id=_S, sha=_S, author_name=_S, author_email=_S, timestamp_ms=_L, subject=_S, is_merge=_B, files_changed=_I, insertions=_I, deletions=_I)
COMMIT_FILES = _ddl(repo_id=_S, sha=_S, rel_path=_S, change_type=_S)
PACKAGES = _ddl(repo_id=_S, name=_S, rel_path=_S, manifest_path=_S, ecosystem=_S, version=_S, dependencies="array<string>", dev_dependencies="array<string>")
DOCUMENTS = _ddl(repo_id=_S, file_id=_S, rel_path=_S, kind=_S, title=_S, headings="array<string>", summary=_S)
REPOSITORIES = _ddl(repo_id=_S, root_path=_S, schema_version=_I, indexed_at_ms=_L, file_count=_L, symbol_count=_L, edge_count=_L, head_sha=_S, tree_hash=_S)
#: table: (columns, key)
TABLES = {
    "files": (FILES, ["file_id"]),
    "symbols": (SYMBOLS, ["symbol_id"]),
    "edges": (EDGES, ["edge_id"]),
    "imports": (IMPORTS, ["file_id", "specifier", "line"]),
    "chunks": (CHUNKS, ["chunk_id"]),
    "commits": (COMMITS, ["repo_id", "sha"]),
    "commit_files": (COMMIT_FILES, ["repo_id", "sha", "rel_path"]),
    "packages": (PACKAGES, ["repo_id", "name"]),
    "documents": (DOCUMENTS, ["file_id"]),
    "repositories": (REPOSITORIES, ["repo_id"]),
}
SYMBOL = "struct<name:string,kind:string,start_line:int,start_column:int,end_line:int,end_column:int,container:string,signature:string,doc_comment:string,is_exported:boolean,is_async:boolean,visibility:string,complexity:int>"
REFERENCE = "struct<name:string,kind:string,line:int,from_symbol:string,receiver:string>"
IMPORT = "struct<specifier:string,symbols:array<string>,is_type_only:boolean,line:int>"
RANGE = "struct<start_line:int,end_line:int,symbol:string>"
#: What an extractor says of a file.
PARSED = f"rel_path string, language string, symbols array<{SYMBOL}>, refs array<{REFERENCE}>, imports array<{IMPORT}>, ranges array<{RANGE}>, chunk_texts map<string,string>, syntax_errors boolean, error string"


@dataclass
class Repo:
    """The tables of one or more repositories as DataFrames."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    imports: DataFrame
    chunks: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    packages: DataFrame
    documents: DataFrame
    repositories: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Repo:
        """A repository of the given tables; the others are empty."""
        return cls(**{f.name: tables.get(f.name, spark.createDataFrame([], TABLES[f.name][0])) for f in fields(cls)})


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with just the table's columns, in its types."""
    want = StructType.fromDDL(TABLES[table][0])
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in want])
