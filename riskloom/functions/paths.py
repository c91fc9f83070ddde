"""Path predicates: which files a rule looks at, and which files a scan skips."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.spec import RuleSpec

# Directory names that a scan leaves out.
EXCLUDED_DIRS = (
    ".git", "node_modules", "__pycache__", ".next", "dist", "build", "venv", ".venv", ".tox",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "egg-info", ".eggs", "site-packages",
)

# Suffixes of files that are not text.
BINARY_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flv", ".wmv",
    ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar",
    ".exe", ".dll", ".so", ".dylib", ".bin",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".pyc", ".pyo", ".class", ".o", ".obj",
    ".sqlite", ".db", ".sqlite3",
    ".lock",
)

# Fixed value: files above this many bytes are not source code.
MAX_FILE_BYTES = 1_048_576


def any_of(tests: Iterable[Column]) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def ends_with_any(path: Column, suffixes: Iterable[str]) -> Column:
    return any_of(path.endswith(suffix) for suffix in suffixes)


def base_name(path: Column) -> Column:
    """Lower-case name after the last slash or backslash."""
    return F.lower(F.regexp_extract(path, r"[^/\\]*$", 0))


def parent_dirs(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def suffix(path: Column) -> Column:
    """Lower-case suffix; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


# ---- gates of rules -------------------------------------------------------------------


def _is_requirements(base: Column) -> Column:
    return base.contains("requirement") & (base.endswith(".txt") | base.endswith(".in"))


def _is_setup(base: Column) -> Column:
    return base.isin("setup.py", "setup.cfg", "pyproject.toml")


def gate_key(rule: RuleSpec) -> tuple:
    return (rule.gate, rule.extensions)


def gate(key: tuple, path: Column) -> Column:
    """Predicate for one ``(gate, extensions)`` pair of a rule."""
    name, extensions = key
    base = base_name(path)
    if name is None:
        return ends_with_any(path, extensions) if extensions else F.lit(True)
    if name == "pip_related":
        return base.contains("requirement") | base.contains("dockerfile") | ends_with_any(path, extensions)
    if name == "requirements":
        return _is_requirements(base)
    if name == "requirements_or_setup":
        return _is_requirements(base) | _is_setup(base)
    if name == "denylist_files":
        return _is_requirements(base) | _is_setup(base) | base.endswith(".py")
    if name == "denylist_requirements":
        return base.contains("requirement") & (_is_requirements(base) | base.endswith(".py"))
    if name == "denylist_imports":
        return base.endswith(".py")
    if name == "dockerfile":
        return F.lower(path).endswith("dockerfile") | path.contains("Dockerfile")
    raise ValueError(f"unknown gate {name!r}")


# ---- filters of a corpus --------------------------------------------------------------


def in_excluded_dir(path: Column, names: Iterable[str] = EXCLUDED_DIRS) -> Column:
    return F.arrays_overlap(parent_dirs(path), F.array(*[F.lit(name) for name in names]).cast("array<string>"))


def in_hidden_dir(path: Column) -> Column:
    return F.exists(
        parent_dirs(path),
        lambda d: (d.startswith(".") & (d != ".github")) | d.endswith(".egg-info"),
    )


def has_binary_suffix(path: Column) -> Column:
    return suffix(path).isin(*BINARY_SUFFIXES)
