"""What paths and markers tell about files and projects, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of a file extension, as queries see it.
QUERY_LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "mjs": "javascript", "php": "php", "html": "html", "htm": "html", "rs": "rust", "java": "java", "kt": "java", "rb": "ruby", "swift": "swift", "c": "cpp", "h": "cpp", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "cs": "csharp"}
#: Language of a file extension, as an inventory of a tree sees it.
INVENTORY_LANGUAGES = {"go": "go", "py": "python", "php": "php", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp"}
#: What a scan classifies.
SCAN_LANGUAGES = {"go": "go", "php": "php", "py": "python", "html": "html", "htm": "html", "md": "markdown"}
#: Directories that scans leave out.
SCAN_SKIPS = [".git", ".idea", ".vscode", "node_modules", "vendor", "dist", "build", "storage", "public"]
INVENTORY_SKIPS = ["node_modules", "vendor", "target", "build", "dist", "__pycache__", "venv"]
RESOURCE_SKIPS = ["vendor", "node_modules", ".git", "bin", "qdrant_data", "docs-backup", ".venv", "__pycache__"]
#: Markers of a workspace root, by precedence.
MARKERS = [".git", "go.mod", "composer.json", "artisan", "package.json", "Cargo.toml", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", ".project", ".vscode"]
PROJECT_TYPES = {"go.mod": "go", "artisan": "laravel", "composer.json": "php", "index.html": "html", "index.htm": "html", "package-lock.json": "html", "vite.config.js": "html", "vite.config.ts": "html", "package.json": "nodejs", "Cargo.toml": "rust", "pyproject.toml": "python", "setup.py": "python", "pom.xml": "maven", "build.gradle": "gradle", ".git": "git"}
MARKER_LANGUAGES = {"go.mod": "go", "package.json": "javascript", "Cargo.toml": "rust", "pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "composer.json": "php", "pom.xml": "java", "build.gradle": "java", "Gemfile": "ruby", "Package.swift": "swift"}
PRIMARY_LANGUAGES = {"go.mod": "go", "go.sum": "go", "requirements.txt": "python", "setup.py": "python", "pyproject.toml": "python", "Pipfile": "python", "composer.json": "php", "package.json": "javascript", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "Gemfile": "ruby"}
PROJECT_LANGUAGES = {"": "go", "go": "go", "unknown": "go", "php": "php", "php-laravel": "php", "laravel": "php", "html": "html", "web": "html", "static-html": "html", "python": "python", "py": "python", "django": "python", "flask": "python", "fastapi": "python"}
EXTENSIONS = {"go": [".go"], "python": [".py"], "php": [".php"], "javascript": [".js", ".jsx", ".mjs"], "typescript": [".ts", ".tsx"], "java": [".java"], "rust": [".rs"], "ruby": [".rb"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".h"], "c++": [".cpp", ".cc", ".cxx", ".hpp", ".h"], "csharp": [".cs"], "c#": [".cs"]}

#: Collections are named after this unless a workspace says otherwise.
DEFAULT_PREFIX = "chunks"


def lookup(key: Column, table: dict[str, str], default: Column | str | None = "") -> Column:
    """The value of a key in a small table of fixed values."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), default if isinstance(default, Column) else F.lit(default))


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the last part, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def query_language(path: Column) -> Column:
    return lookup(extension(path), QUERY_LANGUAGES)


def inventory_language(path: Column) -> Column:
    return lookup(extension(path), INVENTORY_LANGUAGES)


def skipped(path: Column, names: list[str], dotted: bool = False) -> Column:
    """Whether a directory of the path is left out, by its name."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(parts, lambda p: p.isin(names) | (p.startswith(".") if dotted else F.lit(False)))


def project_type(marker: Column) -> Column:
    return lookup(marker, PROJECT_TYPES, "unknown")


def marker_language(marker: Column) -> Column:
    return lookup(marker, MARKER_LANGUAGES)


def primary_language(markers: Column, has_tsconfig: Column) -> Column:
    """Language of the first marker that tells one; empty without."""
    known = F.filter(F.transform(markers, lambda m: F.when((m == "package.json") & has_tsconfig, "typescript").otherwise(lookup(m, PRIMARY_LANGUAGES))), lambda x: x != "")
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.lit(""))


def project_language(kind: Column) -> Column:
    """Which analyzer a project type asks for; unknown kinds stay."""
    k = F.lower(F.trim(kind))
    return lookup(k, PROJECT_LANGUAGES, k)


def extensions_of(language: Column) -> Column:
    pairs = F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*(F.lit(e) for e in v)))))
    return F.coalesce(F.try_element_at(pairs, F.lower(language)), F.array().cast("array<string>"))


def workspace_id(root: Column) -> Column:
    return F.left(F.sha2(F.encode(root, "utf-8"), 256), F.lit(12))


def collection_name(prefix: Column, workspace: Column, language: Column) -> Column:
    """prefix-workspace-language, without the last part for an empty language."""
    return F.concat_ws("-", F.coalesce(F.nullif(prefix, F.lit("")), F.lit(DEFAULT_PREFIX)), workspace, F.nullif(language, F.lit("")))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern is part of the path (plain text, no wildcard)."""
    return F.coalesce(F.exists(F.array(*(F.lit(p) for p in patterns)), lambda p: F.contains(path, p)), F.lit(False))


def valid_root(path: Column, home: str) -> Column:
    """Not the root, the home directory or anything that begins with /tmp."""
    return ~((path == "/") | (path == home) | path.startswith("/tmp"))


def resource_title(path: Column) -> Column:
    """The name without extension, - and _ as blanks, each word with an upper-case initial and the rest as it is."""
    words = F.filter(F.split(F.translate(F.regexp_replace(basename(path), r"\.[^.]*$", ""), "-_", "  "), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")
