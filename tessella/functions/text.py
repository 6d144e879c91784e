"""Scalar functions over text as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME, WORD_64 = 14695981039346656037, 1099511628211, 18446744073709551616

#: HTTP verbs by action name, and by its beginning.
ACTION_VERBS = {"index": ["GET"], "show": ["GET"], "create": ["GET"], "edit": ["GET"], "store": ["POST"], "update": ["PUT", "PATCH"], "destroy": ["DELETE"]}
PREFIX_VERBS = [("get", ["GET"]), ("show", ["GET"]), ("list", ["GET"]), ("create", ["POST"]), ("store", ["POST"]), ("update", ["PUT", "PATCH"]), ("delete", ["DELETE"]), ("destroy", ["DELETE"])]
#: Return types of relations.
RELATION_TYPES = {"hasOne": "HasOne", "hasMany": "HasMany", "belongsTo": "BelongsTo", "belongsToMany": "BelongsToMany", "hasManyThrough": "HasManyThrough", "morphTo": "MorphTo", "morphMany": "MorphMany", "morphToMany": "MorphToMany", "morphedByMany": "MorphedByMany"}


def tokens(query: Column) -> Column:
    """Lower-cased words of a query, split at any Unicode white space, repeats kept."""
    return F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda t: t != "")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a literal part; 0 for an empty or null part or text."""
    n = F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")
    return F.coalesce(F.when(F.length(part) > 0, n), F.lit(0).cast("long"))


def lexical_score(text: Column, words: Column) -> Column:
    """Sum of the occurrences of every word (an array) in the lower-cased text."""
    low = F.lower(text)
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + occurrences(low, w).cast("double"))


def fnv1a_64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a decimal string."""
    kind = "decimal(20,0)"
    pairs = F.filter(F.split(F.hex(F.encode(text, "utf-8")), "(?<=\\G..)"), lambda b: b != "")

    def step(h: Column, b: Column) -> Column:
        # XOR touches the low byte only; the product needs 40 digits, so the high and low halves are multiplied apart.
        low = (h % 256).cast("int")
        x = h - low.cast(kind) + low.bitwiseXOR(F.conv(b, 16, 10).cast("int")).cast(kind)
        high, rest = F.floor(x / F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(11,0)"), (x % F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(11,0)")
        top = ((high * F.lit(FNV_PRIME).cast("decimal(13,0)")) % F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(11,0)") * F.lit(1 << 32).cast("decimal(11,0)")
        return ((top.cast("decimal(24,0)") + (rest * F.lit(FNV_PRIME).cast("decimal(13,0)")).cast("decimal(24,0)")) % F.lit(str(WORD_64)).cast("decimal(24,0)")).cast(kind)

    return F.aggregate(pairs, F.lit(str(FNV_OFFSET)).cast(kind), step).cast("string")


def truncate_bytes(text: Column, n: int) -> Column:
    """The first n bytes; a sequence that is cut becomes U+FFFD."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, n).cast("string")))


def normalize_whitespace(text: Column) -> Column:
    """Trimmed lines (any Unicode white space), blank ones dropped."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), "\n")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def snake_case(name: Column) -> Column:
    """An underscore before every A-Z but the first character, then lower case."""
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def attribute_kind(method: Column) -> Column:
    """accessor (getXAttribute), mutator (setXAttribute) or null."""
    m = F.when(F.length(method) > 12, F.regexp_extract(method, "^(get|set).*Attribute$", 1))
    return F.when(m == "get", "accessor").when(m == "set", "mutator")


def attribute_name(method: Column) -> Column:
    return F.when(attribute_kind(method).isNotNull(), snake_case(F.regexp_extract(method, "^[gs]et(.*)Attribute$", 1)))


def scope_name(method: Column) -> Column:
    """The query scope of a method scopeX: its rest with a lower-case initial; null for others."""
    return F.when(method.startswith("scope") & (F.length(method) > 5), F.concat(F.lower(F.substring(method, 6, 1)), F.substring(method, F.lit(7), F.length(method))))


def http_methods(action: Column) -> Column:
    """HTTP verbs that an action name suggests."""
    low = F.lower(action)
    arrays = lambda v: F.array(*(F.lit(x) for x in v))
    out = F.array().cast("array<string>")
    for prefix, verbs in reversed(PREFIX_VERBS):
        out = F.when(low.startswith(prefix), arrays(verbs)).otherwise(out)
    for name, verbs in reversed(ACTION_VERBS.items()):
        out = F.when(low == name, arrays(verbs)).otherwise(out)
    return out


def relation_return_type(kind: Column, model: Column) -> Column:
    """HasMany<Model> and the like; the kind as it is where unknown."""
    base = kind
    for k, v in RELATION_TYPES.items():
        base = F.when(kind == k, v).otherwise(base)
    return F.when(F.coalesce(model, F.lit("")) != "", F.concat(base, F.lit("<"), model, F.lit(">"))).otherwise(base)


def is_constant(name: Column) -> Column:
    """Starts with an upper-case letter and has no lower-case one."""
    return name.rlike(r"^\p{Lu}") & ~name.rlike(r"[\p{L}&&[^\p{Lu}]]")


def indent_width(line: Column) -> Column:
    """Width of leading blanks; a tab counts four."""
    return F.length(F.replace(F.regexp_extract(line, "^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


def base_type(name: Column) -> Column:
    """The innermost type of a generic: List[User] is User, Dict[str, User] is User. Nesting to eight levels."""

    def peel(t: Column) -> Column:
        inner = F.substring(t, F.instr(t, "[") + 1, F.length(t) - F.instr(t, "[") - 1)
        return F.when(F.instr(t, "[") > 0, F.when(F.contains(inner, F.lit(",")), F.trim(F.substring_index(inner, ",", -1))).otherwise(inner)).otherwise(t)

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), name, lambda t, _: peel(t))


def split_csv(text: Column) -> Column:
    """Trimmed items between commas, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def snippet(code: Column, symbol: Column, around: int = 2) -> Column:
    """The lines around the first line that holds the symbol; empty where none does."""
    lines = F.split(code, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, symbol)), F.lit(True)).cast("int")
    low = F.greatest(at - around, F.lit(1))
    high = F.least(at + around, F.size(lines))
    return F.when(at > 0, F.array_join(F.slice(lines, low, high - low + 1), "\n")).otherwise("")


def read_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive; null unless 1 <= start <= end <= lines (a final newline opens a line)."""
    lines = F.split(text, "\n", -1)
    return F.when((start >= 1) & (start <= end) & (end <= F.size(lines)), F.array_join(F.slice(lines, start, end - start + 1), "\n"))


def embed_text(doc: Column, signature: Column, code: Column) -> Column:
    """What is embedded of a chunk: its non-blank parts, a blank line between; null if there is none."""
    blank = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "") != ""
    out = F.array_join(F.filter(F.array(doc, signature, code), blank), "\n\n")
    return F.when(out != "", out)


def exported(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Z]"), F.lit(False))


def coalesce_path(*names: Column) -> Column:
    """The first non-empty one; empty where none is."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in names), F.lit(""))


def in_namespace(package: Column, prefix: str) -> Column:
    """The namespace itself or one below it, parts between backslashes."""
    return F.coalesce((package == prefix) | package.startswith(prefix + "\\"), F.lit(False))


def heading_level(tag: Column) -> Column:
    """1 to 6 for h1 to h6 (of either case), else 0."""
    return F.when(F.lower(tag).rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).otherwise(0)


def first_character(text: Column) -> Column:
    """The first code point; empty for an empty text."""
    return F.substring(text, 1, 1)


def doc_examples(doc: Column) -> Column:
    """array<string>: the indented lines of a comment after `Example:`, `Usage:` or a Go code fence, up to a fence or an empty line after them.

    A fold over the lines: what is open, what it holds, what is finished. One level of indentation is taken off.
    """
    start = F.struct(F.lit(False).alias("open"), F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        begins = bare.startswith("Example:") | bare.startswith("Usage:") | bare.contains("```go")
        ends = s["open"] & (bare.contains("```") | ((bare == "") & (s["held"] != "")))
        code = s["open"] & line.rlike("^(    |\t)")
        done = F.when(ends & ~begins & (s["held"] != ""), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])
        held = F.when(begins | ends, "").when(code, F.concat(s["held"], F.regexp_replace(line, "^(    \t?|\t)", ""), F.lit("\n"))).otherwise(s["held"])
        return F.struct((begins | (s["open"] & ~ends)).alias("open"), held.alias("held"), done.alias("out"))

    # An empty line at the end closes what the comment leaves open.
    return F.aggregate(F.split(F.concat(doc, F.lit("\n")), "\n", -1), start, step, lambda s: s["out"])
