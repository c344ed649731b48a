"""Globs and ignore files as regular expressions."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """A path glob: ``**``, ``*``, ``?``, ``[...]``, ``{a,b}``; dots are like other characters."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
            continue
        if c == "*":
            n = len(glob) - len(glob[i:].lstrip("*")) - i
            out, i = out + (".*" if n > 1 else "[^/]*"), i + n
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


class Globs:
    def __init__(self, globs: list[str]):
        self.all = re.compile("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else None

    def match(self, path: str) -> bool:
        return bool(self.all and self.all.match(path))


class Ignore:
    """The rules of one ignore file, for paths relative to its folder."""

    def __init__(self, text: str):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            if line:
                body = glob_regex(line)[1:-1]
                self.rules.append((keep, only_dirs, re.compile(("^" if anchored else "^(?:.*/)?") + body + "$")))

    def ignores(self, path: str, is_dir: bool) -> bool:
        """By the last rule that fits the path or a folder above it."""
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            at, folder = "/".join(parts[:k]), k < len(parts) or is_dir
            out = False
            for keep, only_dirs, rule in self.rules:
                if (folder or not only_dirs) and rule.match(at):
                    out = not keep
            if out:
                return True
        return False
