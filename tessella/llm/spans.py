"""Places of regular-expression matches as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Matches whose places are summed up in one step; places of such groups are summed up among themselves.
GROUP = 256


def match_spans(text: Column, pattern: str, *groups: int, sign: Column | None = None) -> Column:
    """array<struct<start, end, g0, ...>>: leftmost non-overlapping matches, in code points, with the named groups.

    split() gives what lies between the matches and regexp_extract_all() the matches; running lengths give the places.
    The pattern must not match the empty string. sign: a cheaper condition without which there is no match.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(found[0])), lambda g: F.length(g)).alias("gap"), F.transform(found[0], lambda m: F.length(m)).alias("size"), *(x.alias(f"g{i}") for i, x in enumerate(found)))
    fields = [f"g{i}" for i in range(len(found))]
    kind = f"array<struct<start:int,end:int,{','.join(f'{f}:string' for f in fields)}>>"
    number = lambda n: F.lit(n).cast("int")

    def place(part: Column, at: Column) -> Column:
        """Spans of up to GROUP matches, the first gap of which begins at a place."""

        def step(s: Column, x: Column) -> Column:
            lo = s["at"] + x["gap"]
            hi = lo + x["size"]
            return F.struct(hi.alias("at"), F.concat(s["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"), *(x[f].alias(f) for f in fields)))).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])

    def whole(rows: Column) -> Column:
        parts = F.transform(F.sequence(number(0), F.floor((F.size(rows) - 1) / GROUP).cast("int")), lambda i: F.slice(rows, i * GROUP + 1, number(GROUP)))
        return F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, starts(p), place)))[0]

    def starts(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.aggregate(p, number(0), lambda s, x: s + x["gap"] + x["size"]))
        begin = F.struct(number(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    there = text.rlike(pattern) if sign is None else sign & text.rlike(pattern)
    return F.when(there, F.transform(F.array(rows), whole)[0]).otherwise(F.array().cast(kind))
