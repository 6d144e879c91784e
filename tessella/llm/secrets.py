"""Secret scans: assignments, access identifiers and hexadecimal keys, and credentials in several parts.

Method: multipart linking. Besides the base patterns, weak candidates are gathered: identifiers (client_id=..., user: ...),
short or unlabelled secrets, and endpoints (scheme://host). Each is an interval; a scope is a document. Candidates
and base spans of a document are joined by their intervals, widened by `reach` code points: a weak identifier is reported only
with a secret or an endpoint nearby, a weak secret only with an identifier or an endpoint nearby; endpoints
are never reported. The join sweeps the intervals in order, each against the nearest base span and the nearest complement on
either side, so no pairs are made. Spans may overlap each other: an identifier and a part are told by themselves. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.spans import match_spans
from tessella.plans.shared import materialize

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more
KINDS = ["assign", "access", "hex", "identifier", "part"]

#: Weak candidates.
IDENTIFIER = r"""(?<![A-Za-z0-9])(?i:access_?key(?:_?id)?|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D"'<>]{3,}"""

#: Code points between the parts of one credential.
REACH = 200


def _spans(found: Column, kind: int, keep=None) -> Column:
    """Spans with the place of their kind."""
    kept = F.filter(found, keep) if keep else found
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, base, linked) of every row of docs(doc_id, text, ...).

    base and linked are sorted arrays of struct<start, kind, end> (kind: place in KINDS; code points, end exclusive): what the base patterns
    find, and the weak candidates that complementary parts support. Weak candidates that overlap a base span
    are dropped. Null text is empty. Repeated rows give repeated results; a null doc_id is an id like others; other columns
    are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named, here = F.col("text").rlike("[:=]"), F.col("text")
    rows = docs.select("doc_id", text.alias("text")).withColumn("assigned", match_spans(here, ASSIGN, 2, sign=named))
    base = F.concat(_spans(F.col("assigned"), 0, lambda x: F.length(x["g1"]) >= 12), _spans(match_spans(here, ACCESS, sign=here.contains("AKIA")), 1), _spans(match_spans(here, HEX), 2))
    mixed = lambda x: x["g0"].rlike("[0-9]") & x["g0"].rlike("[A-Z]") & x["g0"].rlike("[a-z]")
    short = lambda x: (F.length(x["g1"]) < 12) & (F.length(x["g1"]) >= 6)
    weak = F.concat(_spans(match_spans(here, IDENTIFIER, sign=named), 3), _spans(F.col("assigned"), 4, short), _spans(match_spans(here, TOKEN), 4, mixed))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), F.array_sort(base).alias("base"), weak.alias("weak"), _spans(match_spans(here, ENDPOINT, sign=here.contains("://")), 5).alias("ends"))
    rows = materialize(rows, "spans")

    # Equal rows have equal parts, so one of them stands for all.
    parts = rows.where(F.size("weak") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", F.explode(F.concat("base", "weak", "ends")).alias("x")).select("doc_id", "h", "x.*")
    # At one place base spans come first: the furthest end before and the nearest start after tell whether one overlaps.
    order = Window.partitionBy("doc_id", "h").orderBy("start", "kind", "end")
    sure = F.col("kind") < 3
    parts = parts.withColumn("base_end", F.max(F.when(sure, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("base_start", F.min(F.when(sure, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)))
    hidden = F.coalesce(F.col("base_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("end"), F.lit(False))
    parts = parts.where(~F.col("kind").isin(3, 4) | ~hidden)
    role = F.when(F.col("kind").isin(1, 3), "identifier").when(F.col("kind") == 5, "endpoint").otherwise("secret")
    parts = parts.withColumn("role", role)
    ahead = Window.partitionBy("doc_id", "h").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("doc_id", "h").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    for name in ("identifier", "secret", "endpoint"):
        parts = parts.withColumn(f"{name}_before", F.max(F.when(F.col("role") == name, F.col("end"))).over(ahead))
    for name in ("identifier", "secret", "endpoint"):
        parts = parts.withColumn(f"{name}_after", F.min(F.when(F.col("role") == name, F.col("start"))).over(behind))

    def near(name: str) -> Column:
        return F.coalesce(F.col("start") - F.col(f"{name}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{name}_after") - F.col("end") <= reach, F.lit(False))

    supported = near("endpoint") | F.when(F.col("role") == "secret", near("identifier")).otherwise(near("secret"))
    linked = parts.where(F.col("kind").isin(3, 4) & supported).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))
    linked = linked.select(F.col("doc_id").alias("of"), F.col("h").alias("oh"), "linked")
    out = rows.join(linked, rows.doc_id.eqNullSafe(linked.of) & (rows.h == linked.oh), "left")
    return out.select("doc_id", "base", F.coalesce("linked", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("linked"))


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def secret_digests(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs; see scan_secrets()."""
    found = scan_secrets(docs, reach)
    count = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *count, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "linked"))).alias("spans"))


def _is(kind: int):
    return lambda x: x["kind"] == kind


def _any_case(words: str) -> str:
    """A pattern of ASCII letters in either case, whatever the engine's folding."""
    return "".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in words)


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _found(name: str, pattern: str) -> str:
    """A table of SQL: the matches of a pattern with their ends, in code points."""
    p = _quoted(pattern)
    return f"""{name} AS (SELECT doc_id, m, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM
 (SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d)))"""


#: The patterns for SQL, which can't look behind: what must come before is matched, too.
_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = f"({_any_case('password|passwd|secret|token|api_?key')}){_GIVEN}([A-Za-z0-9+/_.=-]+)"
_IDENTIFIER = f"(^|[^A-Za-z0-9])(?:{_any_case('access_?key')}(?:{_any_case('_?id')})?|{_any_case('client_?id|user_?name|user|login|account')}){_GIVEN}[A-Za-z0-9+/_.@-]{{3,}}"
_TOKEN = r"(^|[^A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}"
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_found("fa", _ASSIGN)}, {_found("fk", "AKIA[A-Z0-9]+")}, {_found("fh", "[0-9a-f]+")}, {_found("fi", _IDENTIFIER)}, {_found("ft", _TOKEN)},
 {_found("fe", ENDPOINT)},
a AS (SELECT *, length(regexp_extract(m, '{_quoted(_ASSIGN)}', 2)) AS n FROM fa),
base AS (SELECT doc_id, e - length(m) AS s, 0 AS k, e FROM a WHERE n >= 12 UNION ALL SELECT doc_id, e - length(m), 1, e FROM fk WHERE length(m) >= 18 UNION ALL SELECT doc_id, e - length(m), 2, e FROM fh WHERE length(m) >= 16),
cand AS (SELECT doc_id, e - length(m) + length(regexp_extract(m, '{_quoted(_IDENTIFIER)}', 1)) AS s, 3 AS k, e FROM fi UNION SELECT doc_id, e - length(m), 4, e FROM a WHERE n BETWEEN 6 AND 11
 UNION SELECT doc_id, e - length(m) + length(regexp_extract(m, '{_TOKEN}', 1)), 4, e FROM ft WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')),
weak AS (SELECT * FROM cand w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
part AS (SELECT *, CASE WHEN k IN (1, 3) THEN 'i' WHEN k = 5 THEN 'e' ELSE 's' END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak UNION ALL SELECT doc_id, e - length(m), 5, e FROM fe)),
linked AS (SELECT DISTINCT w.doc_id, w.s, w.k, w.e FROM part w JOIN part x ON x.doc_id = w.doc_id AND x.role <> w.role AND w.s - x.e <= {REACH} AND x.s - w.e <= {REACH} WHERE w.k IN (3, 4)),
told AS (SELECT *, ['assign', 'access', 'hex', 'identifier', 'part'][k + 1] || ':' || s || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM linked))
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
 sha256(coalesce(string_agg(x, ',' ORDER BY s, k, e) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, k, e), '') AS spans FROM d LEFT JOIN told USING (doc_id) GROUP BY d.doc_id"""
