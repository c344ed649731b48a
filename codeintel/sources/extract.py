"""Symbols, references, imports and chunk ranges of source texts.

Python is read with its own parser.  Other languages are read by rules on their
lines, on a text whose comments and strings are blanked first: definitions by
pattern, their ends by braces (or indentation), calls, instantiations, supertypes
and imports by pattern.  That is an approximation: a grammar sees more.  A file
that can't be read gives a row with ``error`` and never stops a batch.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import PARSED

CONTAINERS = {"class", "interface", "struct", "enum", "namespace", "module"}
MAX_CHUNK, OVERLAP, MAX_CHARS = 120, 10, 4_000_000
C_LIKE = r"\b(?:if|for|while|do|switch|case|catch|try)\b|\?(?![.?:])|&&|\|\||[=!<>]=|[-+*/%](?![=*/+-])|[<>](?=\s)"
BRANCHES = {
    "go": r"\b(?:if|for|switch|case|select)\b|&&|\|\||[=!<>]=",
    "rust": r"\b(?:if|for|while|loop|match)\b|=>|&&|\|\||[=!<>]=",
    "sql": r"(?i)\bcase\b|\bwhen\b",
    "terraform": r"\?",
}
_ID = r"[A-Za-z_$][\w$]*"
_JS = [
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})"),
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_ID})"),
    ("interface", rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>{_ID})"),
    ("enum", rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{_ID})"),
    ("type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{_ID})[^=]*="),
    ("namespace", rf"^\s*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+(?P<name>{_ID})"),
    ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_ID})[^=\n]*=\s*(?:async\s*)?(?:function\b|(?:\([^\n]*\)|{_ID})(?:\s*:[^=\n]+)?\s*=>)"),
    ("constant", rf"^(?:export\s+)?(?:const|let)\s+(?P<name>{_ID})"),
    ("variable", rf"^(?:export\s+)?var\s+(?P<name>{_ID})"),
    ("method", rf"^\s+(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*(?!(?:if|for|while|switch|catch|return|function|new|await|typeof)\b)(?P<name>#?{_ID})\s*(?:<[^>\n]*>)?\([^\n]*\)\s*(?::[^{{;\n]+)?\{{"),
]
_JVM = [
    ("class", r"^\s*(?:[\w@]+\s+)*class\s+(?P<name>\w+)"),
    ("interface", r"^\s*(?:\w+\s+)*interface\s+(?P<name>\w+)"),
    ("enum", r"^\s*(?:\w+\s+)*enum\s+(?:class\s+)?(?P<name>\w+)"),
    ("struct", r"^\s*(?:\w+\s+)*(?:record|struct)\s+(?:class\s+|struct\s+)?(?P<name>\w+)"),
]
_METHOD = r"^\s+(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|synchronized)\s+)+(?:<[^>]+>\s*)?[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\("
_CONSTRUCTOR = r"^\s+(?:public|private|protected|internal)\s+(?P<name>[A-Z]\w*)\s*\("
_C = [
    ("class", r"^\s*class\s+(?P<name>\w+)[^;]*$"),
    ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{?"),
    ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(?P<name>\w+)"),
    ("namespace", r"^\s*namespace\s+(?P<name>\w+)"),
    ("type", r"^\s*typedef\s+.*?(?P<name>\w+)\s*;"),
    ("method", r"^[\w:<>*&\s]+?\b\w+::~?(?P<name>\w+)\s*\([^;]*$"),
    ("function", r"^(?!\s*(?:return|else|if|for|while|switch|typedef|struct|class|enum|namespace)\b)[\w:<>*&]+[\s*&]+(?:[\w:<>*&]+[\s*&]+)*(?P<name>\w+)\s*\([^;]*$"),
]
RULES: dict[str, list[tuple[str, str]]] = {
    **dict.fromkeys(("typescript", "tsx", "javascript", "jsx"), _JS),
    "go": [
        ("function", r"^func\s+(?P<name>\w+)"), ("method", r"^func\s*\([^)]*\)\s*(?P<name>\w+)"), ("struct", r"^\s*type\s+(?P<name>\w+)\s+struct\b"),
        ("interface", r"^\s*type\s+(?P<name>\w+)\s+interface\b"), ("type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)\S"), ("constant", r"^const\s+(?P<name>\w+)"), ("variable", r"^var\s+(?P<name>\w+)"),
    ],
    "java": [*_JVM, ("constructor", _CONSTRUCTOR), ("method", _METHOD), ("field", r"^\s+(?:(?:public|private|protected|static|final|volatile)\s+)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:=|;)")],
    "csharp": [*_JVM, ("namespace", r"^\s*namespace\s+(?P<name>[\w.]+)"), ("constructor", _CONSTRUCTOR), ("method", _METHOD), ("property", r"^\s+(?:(?:public|private|protected|internal|static|virtual|override)\s+)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\{")],
    "kotlin": [("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(?P<name>\w+)"), ("property", r"^\s*(?:\w+\s+)*va[lr]\s+(?P<name>\w+)")],
    "rust": [
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"),
        ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)"), ("module", r"^\s*(?:pub\s+)?mod\s+(?P<name>\w+)"),
    ],
    "cpp": _C,
    "c": _C,
    "sql": [("table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?function\s+(?P<name>[\w.\"]+)")],
    "yaml": [("property", r"^\s*(?:-\s+)?(?P<name>[\w./-]+)\s*:(?:\s|$)")],
    "json": [("property", r"^\s*\"(?P<name>[^\"]+)\"\s*:")],
    "markdown": [("module", r"^#{1,6}\s+(?P<name>.+?)\s*#*$")],
    "dockerfile": [("resource", r"(?i)^from\s+(?:--\S+\s+)?(?P<name>\S+)"), ("variable", r"(?i)^(?P<name>run)\b")],
    "terraform": [("resource", r"^(?P<name>\w+)\s+(?:\"[^\"]*\"\s*)*\{")],
}
_FROM = r"""(?:import|export)\b[^'"`;]*?\bfrom\s*|\bimport\s+|\brequire\s*\(\s*|\bimport\s*\(\s*"""
IMPORTS: dict[str, str] = {
    **dict.fromkeys(("typescript", "tsx", "javascript", "jsx"), rf"""(?:{_FROM})(?P<q>["'`])(?P<spec>[^"'`\n]+)(?P=q)"""),
    "go": r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<spec>[^"\n]+)"\s*$""",
    **dict.fromkeys(("java", "kotlin"), r"(?m)^\s*import\s+(?:static\s+)?(?P<spec>[\w.]+?)(?:\.\*)?\s*(?:as\s+\w+\s*)?;?\s*$"),
    "csharp": r"(?m)^\s*using\s+(?:static\s+)?(?P<spec>[\w.]+)\s*;",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+(?P<spec>[\w:]+?)(?:::\{[^}]*\}|::\*)?\s*(?:as\s+\w+)?;",
    **dict.fromkeys(("c", "cpp"), r"""(?m)^\s*#\s*include\s*[<"](?P<spec>[^>"\n]+)[>"]"""),
    "markdown": r"\]\((?P<spec>[^)\s]+)",
    "dockerfile": r"(?im)^from\s+(?:--\S+\s+)?(?P<spec>\S+)",
}
HAS_CALLS = set(RULES) - {"yaml", "json", "markdown", "dockerfile"}
NOT_CALLED = set("if for while switch catch return function new await typeof sizeof do else elif def class fn func match with print_ lambda in and or not async super this".split())


def _blank(text: str, language: str) -> str:
    """``text`` with comments and the insides of strings as spaces; lines and places stay."""
    line = r"--[^\n]*" if language == "sql" else r"#[^\n]*" if language in ("python", "yaml", "dockerfile", "terraform") else r"//[^\n]*"
    pattern = rf"""/\*[\s\S]*?\*/|{line}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""

    def over(m: re.Match) -> str:
        s = m[0]
        inner = re.sub(r"[^\n]", " ", s)
        return s[0] + inner[1:-1] + s[-1] if s[0] in "\"'`" and len(s) > 1 else inner

    return re.sub(pattern, over, text)


def _doc(lines: list[str], row: int) -> str | None:
    """The comment that stands just above a line, at most 40 lines of it."""
    got: list[str] = []
    while row >= 0 and len(got) < 40:
        s = lines[row].strip()
        if not s and not got:
            row -= 1
            continue
        if not s.startswith(("//", "#", "*", "/*", '"""', "'''", "--")):
            break
        for p in (r"^/\*+", r"\*+/$", r"^//+", r"^#+", r"^\*+", r"^--+", r"^[\"']{3}", r"[\"']{3}$"):
            s = re.sub(p, "", s)
        got.insert(0, s.strip())
        row -= 1
    text = "\n".join(got).strip()
    return (text[:1197] + "…" if len(text) > 1200 else text) or None


def _signature(line: str) -> str:
    s = re.sub(r"\s*[{:]\s*$", "", line.strip())
    return s[:237] + "…" if len(s) > 240 else s


def _visibility(head: str, name: str) -> str:
    for word in ("private", "protected", "internal"):
        if re.search(rf"\b{word}\b", head[:80]):
            return word
    return "private" if name[:1] in "_#" else "public"


def _symbol(name, kind, start, end, container, line, doc, exported, complexity, column=1, end_column=1) -> dict:
    return {
        "name": name, "kind": kind, "start_line": start, "start_column": column, "end_line": end, "end_column": end_column, "container": container, "signature": _signature(line), "doc_comment": doc,
        "is_exported": exported, "is_async": bool(re.search(r"\basync\b", line)), "visibility": _visibility(line.strip(), name), "complexity": complexity,
    }


def enclosing(symbols: list[dict], line: int) -> str | None:
    """The qualified name of the innermost symbol around a line; of equals, the first."""
    best = None
    for s in symbols:
        if s["start_line"] <= line <= s["end_line"] and (best is None or s["end_line"] - s["start_line"] < best["end_line"] - best["start_line"]):
            best = s
    return None if best is None else f"{best['container']}.{best['name']}" if best["container"] else best["name"]


def chunk_ranges(symbols: list[dict], n_lines: int) -> list[dict]:
    """Top-level symbols, long ones in windows that overlap; without symbols, windows of the file."""
    out = []
    for s in symbols:
        if s["container"] is not None:
            continue
        a, b = s["start_line"], s["end_line"]
        step = MAX_CHUNK - OVERLAP if b - a >= MAX_CHUNK else b - a + 1
        out += [{"start_line": x, "end_line": min(x + MAX_CHUNK - 1, b), "symbol": s["name"]} for x in range(a, b + 1, step)]
    return out or [{"start_line": x, "end_line": min(x + MAX_CHUNK - 1, n_lines), "symbol": None} for x in range(1, n_lines + 1, MAX_CHUNK)]


class _Python(ast.NodeVisitor):
    BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match, ast.match_case, ast.BoolOp, ast.With, ast.AsyncWith)

    def __init__(self, lines: list[str]):
        self.lines, self.stack = lines, []
        self.symbols, self.refs, self.imports = [], [], []

    def _define(self, node, kind: str) -> None:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        doc = ast.get_docstring(node) or _doc(self.lines, start - 2)
        n = 1 + sum(isinstance(x, self.BRANCH) for x in ast.walk(node))
        self.symbols.append(_symbol(node.name, kind, start, node.end_lineno, self.stack[-1] if self.stack else None, self.lines[start - 1], doc, False, n, node.col_offset + 1, node.end_col_offset + 1))
        if kind == "class":
            self.stack.append(f"{self.stack[-1]}.{node.name}" if self.stack else node.name)
        self.generic_visit(node)
        if kind == "class":
            self.stack.pop()

    def visit_FunctionDef(self, node):
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.refs += [(b.id, "extends", b.lineno, None) for b in node.bases if isinstance(b, ast.Name)]
        self._define(node, "class")

    def visit_Module(self, node):
        for s in node.body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
            for t in targets:
                if isinstance(t, ast.Name):
                    self.symbols.append(_symbol(t.id, "constant", s.lineno, s.end_lineno, None, self.lines[s.lineno - 1], _doc(self.lines, s.lineno - 2), False, 1))
        self.generic_visit(node)

    def visit_Call(self, node):
        f = node.func
        if isinstance(f, ast.Name):
            self.refs.append((f.id, "call", f.lineno, None))
        elif isinstance(f, ast.Attribute):
            self.refs.append((f.attr, "call", f.end_lineno, f.value.id if isinstance(f.value, ast.Name) else None))
        self.generic_visit(node)

    def visit_Import(self, node):
        self.imports += [{"specifier": a.name, "symbols": [], "is_type_only": False, "line": node.lineno} for a in node.names]

    def visit_ImportFrom(self, node):
        spec = "." * node.level + (node.module or "")
        self.imports.append({"specifier": spec, "symbols": [a.name for a in node.names if a.name != "*"], "is_type_only": spec == "typing", "line": node.lineno})


def _by_rules(text: str, language: str, lines: list[str]) -> tuple[list[dict], list[tuple], list[dict]]:
    clean = _blank(text, language) if language not in ("markdown", "json") else text
    rows = clean.split("\n")
    rules = [(k, re.compile(p)) for k, p in RULES.get(language, [])]
    branch = re.compile(BRANCHES.get(language, C_LIKE))
    found: list[dict] = []
    stack: list[tuple[int, str]] = []
    for i, row in enumerate(rows):
        source = lines[i] if language == "json" else row
        for kind, rule in rules:
            m = rule.match(source if language != "terraform" else lines[i])
            if not m:
                continue
            name = m["name"].strip('"')
            end = _end(rows, i, language)
            while stack and stack[-1][0] < i:
                stack.pop()
            container = stack[-1][1] if stack else None
            if kind == "method" and container is None and language in ("typescript", "tsx", "javascript", "jsx"):
                break
            body = "\n".join(rows[i : end + 1])
            exported = bool(re.match(r"\s*export\b", row)) or bool(re.match(r"\s*pub\b", row)) or (language in ("java", "kotlin", "csharp") and bool(re.match(r"\s*(?:@\w+\s+)*(?:public|open|internal|protected|private)\b", row)))
            n = 1 + (len(branch.findall(body)) if kind in ("function", "method", "constructor", "class") else 0)
            found.append(_symbol(name, kind, i + 1, end + 1, container, lines[i], _doc(lines, i - 1), exported, n, len(row) - len(row.lstrip()) + 1, len(rows[end]) + 1))
            if kind in CONTAINERS and language != "markdown":
                stack.append((end, f"{container}.{name}" if container else name))
            break
    refs: list[tuple] = []
    if language in HAS_CALLS:
        defined = {(s["name"], s["start_line"]) for s in found}
        for m in re.finditer(rf"(?P<new>\bnew\s+)?(?:(?P<recv>{_ID})\s*\.\s*)?(?P<name>{_ID})\s*(?:<[\w\s,.]*>)?\(", clean):
            line = clean.count("\n", 0, m.start("name")) + 1
            if m["name"] not in NOT_CALLED and (m["name"], line) not in defined:
                refs.append((m["name"], "instantiate" if m["new"] else "call", line, m["recv"]))
        for m in re.finditer(rf"\b(extends|implements)\s+({_ID}(?:\s*,\s*{_ID})*)", clean):
            refs += [(n.strip(), m[1], clean.count("\n", 0, m.start()) + 1, None) for n in m[2].split(",")]
        if language == "go":
            refs += [(m[1], "instantiate", clean.count("\n", 0, m.start()) + 1, None) for m in re.finditer(r"&?\b([A-Z]\w*)\{", clean)]
        if language == "rust":
            refs += [(m[1], "implements", clean.count("\n", 0, m.start()) + 1, None) for m in re.finditer(r"\bimpl(?:<[^>]*>)?\s+(\w+)(?:<[^>]*>)?\s+for\b", clean)]
    imports = []
    if language in IMPORTS:
        for m in re.finditer(IMPORTS[language], text):
            line = text.count("\n", 0, m.start("spec")) + 1
            names = re.search(r"\{([^}]*)\}", m[0])
            symbols = [x for p in (names[1].split(",") if names else []) if re.match("[A-Za-z_$]", x := re.split(r"\s+as\s+", p.strip().removeprefix("type "))[0].strip())]
            if language == "rust":
                tail = re.search(r"::\{([^}]*)\}", m[0])
                symbols = [p.strip() for p in tail[1].split(",")] if tail else [m["spec"].split("::")[-1]]
            imports.append({"specifier": m["spec"].strip(), "symbols": symbols, "is_type_only": bool(re.match(r"import\s+type\b", m[0].strip())), "line": line})
    return found, refs, imports


def _end(rows: list[str], start: int, language: str) -> int:
    """The last line of a definition."""
    if language in ("yaml", "markdown", "json", "dockerfile"):
        return start
    depth, opened = 0, False
    for i in range(start, len(rows)):
        for c in rows[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth <= 0:
                    return i
            elif c == ";" and not opened and depth == 0:
                return i
        if not opened and i > start and not rows[i].strip():
            return i - 1
        if not opened and i - start > 20:
            return start
    return len(rows) - 1 if opened else start


def parse(rel_path: str, language: str, text: str) -> dict:
    """One row of ``PARSED``."""
    lines = text.split("\n")
    broken = False
    if language == "python":
        v = _Python(lines)
        try:
            v.visit(ast.parse(text[:MAX_CHARS]))
            symbols, refs, imports = sorted(v.symbols, key=lambda s: (s["start_line"], s["start_column"])), v.refs, v.imports
        except SyntaxError:
            symbols, refs, imports, broken = [], [], [], True
    else:
        symbols, refs, imports = _by_rules(text[:MAX_CHARS], language, lines)
    references = [{"name": n, "kind": k, "line": line, "from_symbol": enclosing(symbols, line), "receiver": r} for n, k, line, r in refs]
    ranges = chunk_ranges(symbols, len(lines))
    texts = [(f"{r['start_line']}:{r['end_line']}", "\n".join(lines[r["start_line"] - 1 : r["end_line"]])) for r in ranges]
    return {"rel_path": rel_path, "language": language, "symbols": symbols, "refs": references, "imports": imports, "ranges": ranges, "chunk_texts": list(dict(texts).items()), "syntax_errors": broken, "error": None}


def extract(files: DataFrame) -> DataFrame:
    """``PARSED`` rows of files (rel_path, language, text) that have a language and a text."""
    from .scan import _arrow

    target = _arrow(PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    row = parse(path, lang, text)
                except Exception as e:  # one file's failure is that file's row
                    row = dict.fromkeys(target.names) | {"rel_path": path, "language": lang, "error": f"{type(e).__name__}: {e}"[:300]}
                yield pa.RecordBatch.from_pylist([row], schema=target)

    return files.where("language IS NOT NULL AND text IS NOT NULL").select("rel_path", "language", "text").mapInArrow(run, PARSED)
