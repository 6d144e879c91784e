"""The parameters of the search tools: what each takes, and what of it is wrong."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FORMATS = ["markdown", "json"]


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str = "string"
    required: bool = False
    default: object = None


def needs(name: str, kind: str = "string") -> Parameter:
    return Parameter(name, kind, True)


FILE, PACKAGE, LIMIT = Parameter("file_path"), Parameter("package"), Parameter("limit", "number", default=5)
FORMAT = Parameter("output_format", default="markdown")

#: The tools with the names of their parameters.
TOOLS: dict[str, list[Parameter]] = {
    "search_code": [needs("query"), FILE, LIMIT, FORMAT],
    "search_docs": [needs("query"), FILE, LIMIT, FORMAT],
    "hybrid_search": [needs("query"), FILE, LIMIT, FORMAT],
    "get_function_details": [needs("function_name"), FILE, PACKAGE, FORMAT],
    "find_type_definition": [needs("type_name"), FILE, PACKAGE, FORMAT],
    "find_implementations": [needs("symbol_name"), FILE, PACKAGE, FORMAT],
    "list_package_exports": [needs("package"), FILE, Parameter("symbol_type"), FORMAT],
    "get_code_context": [needs("file_path"), needs("start_line", "number"), needs("end_line", "number"), Parameter("context_lines", "number", default=5)],
    "index_workspace": [FILE],
}


class ToolError(ValueError):
    """What is wrong with a call."""


def check(tool: str, given: dict) -> dict:
    """The call's parameters with defaults; unknown tools and names, missing or wrong values are a ToolError that names them.

    Numbers may come as strings or floats without a fraction. A limit below 1 is the default; lines begin at 1.
    """
    if tool not in TOOLS:
        raise ToolError(f"unknown tool {tool}")
    known = {p.name: p for p in TOOLS[tool]}
    if extra := sorted(set(given) - set(known)):
        raise ToolError(f"{tool} has no parameter {', '.join(extra)}")
    out = {}
    for p in known.values():
        value = given.get(p.name)
        if p.kind == "number" and value is not None:
            try:
                number = float(value)
            except (TypeError, ValueError):
                raise ToolError(f"{p.name} must be a number") from None
            if number != int(number):
                raise ToolError(f"{p.name} must be a whole number")
            value = int(number)
        elif value is not None and not isinstance(value, str):
            raise ToolError(f"{p.name} must be text")
        if p.required and (value is None or value == ""):
            raise ToolError(f"{p.name} is required")
        out[p.name] = p.default if value is None else value
    if out.get("limit") is not None and out["limit"] < 1:
        out["limit"] = LIMIT.default
    if "output_format" in out and out["output_format"] not in FORMATS:
        raise ToolError(f"output_format must be one of {', '.join(FORMATS)}")
    if tool == "get_code_context":
        if out["start_line"] < 1 or out["end_line"] < out["start_line"]:
            raise ToolError("lines begin at 1, and end_line isn't before start_line")
        out["context_lines"] = max(0, out["context_lines"])
    return out


def schemas(spark: SparkSession) -> DataFrame:
    """(tool, parameter, kind, required, default_value) of every tool."""
    rows = [(tool, p.name, p.kind, p.required, "" if p.default is None else str(p.default)) for tool, ps in TOOLS.items() for p in ps]
    return spark.createDataFrame(rows, "tool string, parameter string, kind string, required boolean, default_value string")
