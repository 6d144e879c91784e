"""Source text to symbols: plain functions (path, content) -> list of chunk dicts."""

from __future__ import annotations

import json

FIELDS = ["type", "name", "package", "language", "file_path", "uri", "start_line", "end_line", "selection_start_line", "selection_end_line", "signature", "docstring", "code", "metadata"]


def chunk(kind: str, name: str, language: str, path: str, start: int = 0, end: int = 0, *, package: str = "", signature: str = "", docstring: str = "", code: str = "", **metadata) -> dict:
    """A chunk; metadata values become JSON texts."""
    meta = {k: json.dumps(v, ensure_ascii=False) for k, v in metadata.items()}
    return {"type": kind, "name": name, "package": package, "language": language, "file_path": path, "uri": f"file://{path}", "start_line": start, "end_line": end, "selection_start_line": start, "selection_end_line": start, "signature": signature, "docstring": docstring, "code": code, "metadata": meta}


def lines_of(content: str, start: int, end: int) -> str:
    """Lines start to end, 1-based and inclusive."""
    return "\n".join(content.split("\n")[start - 1 : end])
