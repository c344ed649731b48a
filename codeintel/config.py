"""Settings: defaults, then a file, then the environment, then arguments; arrays replace."""

from __future__ import annotations

import json
import os
from copy import deepcopy
from pathlib import Path
from typing import Any

from .functions.paths import LANGUAGES

_DIRS = ".git .gradle .hg .mypy_cache .next .nuxt .nyc_output .pytest_cache .svelte-kit .svn .terraform .tox .turbo .venv DerivedData Pods __pycache__ bin build coverage dist node_modules obj out target vendor venv"
_FILES = "*.lock *.map *.min.css *.min.js package-lock.json pnpm-lock.yaml yarn.lock"
_DENIED = ".env .env.* .netrc .npmrc *.jks *.key *.keystore *.p12 *.pem *.pfx *.secret credentials.json id_ed25519* id_rsa* service-account*.json"
DEFAULTS: dict[str, Any] = {
    "workspace": {
        "roots": [],
        "include": [],
        "exclude": [*(f"**/{d}/**" for d in _DIRS.split()), *(f"**/{f}" for f in _FILES.split())],
        "respect_gitignore": True,
        "follow_symlinks": False,
        "max_file_bytes": 2_000_000,
        "max_files": 250_000,
    },
    "languages": {"enabled": list(LANGUAGES), "extension_overrides": {}},
    "index": {"incremental": True, "watch": False, "debounce_ms": 750},
    "search": {"mode": "lexical", "rrf_k": 60, "limit": 12, "snippet_lines": 40, "boost": 0.35, "embeddings": {"enabled": False, "model_path": None}},
    "git": {"enabled": True, "max_commits": 5000, "merges": False},
    "security": {"deny": [*(f"**/{f}" for f in _DENIED.split()), *(f"**/{d}/**" for d in (".aws", ".gnupg", ".ssh", "secrets"))], "allow_writes": False},
    "output": {"max_bytes": 48_000, "reserve_bytes": 512},
    "documentation": {
        "include": ["README*", "doc/**/*.md", "docs/**/*.md", "**/ADR-*.md", "**/adr/**/*.md"],
        "openapi": [f"**/{n}.{{json,yaml,yml}}" for n in ("openapi", "swagger")],
    },
}
PREFIX = "CODEINTEL_"


def merged(base: dict, over: dict, where: str = "") -> dict:
    """``base`` with ``over`` laid on it; unknown keys are errors, but under extension_overrides."""
    out = deepcopy(base)
    for k, v in over.items():
        if k not in out and not where.endswith("extension_overrides."):
            raise ValueError(f"unknown setting {where}{k}")
        out[k] = merged(out[k], v, f"{where}{k}.") if isinstance(out.get(k), dict) and isinstance(v, dict) else deepcopy(v)
    return out


def from_environment(env: dict[str, str]) -> dict:
    """``CODEINTEL_SEARCH__LIMIT=20`` sets search.limit; values are JSON, or text."""
    out: dict = {}
    for name, raw in sorted(env.items()):
        if not name.startswith(PREFIX):
            continue
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        at = out
        *path, last = name[len(PREFIX) :].lower().split("__")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def load(path: str | None = None, env: dict[str, str] | None = None, arguments: dict | None = None, roots: list[str] | None = None) -> dict:
    """The settings in force; ``roots`` given as arguments win outright."""
    out = deepcopy(DEFAULTS)
    if path and Path(path).exists():
        out = merged(out, json.loads(Path(path).read_text()))
    out = merged(out, from_environment(dict(os.environ) if env is None else env))
    out = merged(out, arguments or {})
    if roots:
        out["workspace"]["roots"] = list(roots)
    s = out["search"]
    if s["mode"] not in ("lexical", "hybrid") or not 0 <= s["boost"] <= 1 or not 1 <= s["limit"] <= 200:
        raise ValueError("search settings out of range")
    if s["mode"] == "hybrid" and not s["embeddings"]["enabled"]:
        raise ValueError("hybrid search needs embeddings")
    if s["embeddings"]["enabled"] and not s["embeddings"]["model_path"]:
        raise ValueError("embeddings need a local model")
    unknown = set(out["languages"]["enabled"]) - set(LANGUAGES)
    if unknown:
        raise ValueError(f"unknown languages {sorted(unknown)}")
    return out
