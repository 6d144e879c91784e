"""Scalar functions against plain Python models."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as T
from tessella.operators import analyze as A

few = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def fnv(text: str) -> str:
    h = 14695981039346656037
    for b in text.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return str(h)


@few
@given(st.lists(st.text(max_size=12), min_size=1, max_size=5))
def test_fnv(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(T.fnv1a_64(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == [fnv(t) for t in texts]


def pieces(text: str, most: int) -> list[str]:
    """Paragraphs as a loop."""
    out, buf = [], ""
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        if not line.strip() and buf:
            out, buf = [*out, buf], ""
            continue
        if buf and len(buf.encode()) + len(line.encode()) + 1 > most:
            out, buf = [*out, buf], ""
        buf += line + "\n"
    return [x.strip() for x in [*out, buf] if x.strip()]


@few
@given(st.text(alphabet="ab é\n\r", max_size=80))
def test_markdown_pieces(spark, text):
    assert one(spark, text, lambda c: A.markdown_pieces(c, 10)) == pieces(text, 10)


def test_markdown_line_over_the_limit_stays_whole(spark):
    assert one(spark, "a\n" + "x" * 1500 + "\nb", A.markdown_pieces) == ["a", "x" * 1500, "b"]


@few
@given(st.text(alphabet="ab", max_size=20), st.text(alphabet="ab", min_size=1, max_size=3))
def test_occurrences(spark, text, part):
    assert one(spark, text, lambda c: T.occurrences(c, F.lit(part))) == text.count(part)


@pytest.mark.parametrize(("s", "e", "want"), [(1, 2, "a\nb"), (0, 5, None), (4, 4, ""), (3, 2, None)])
def test_read_lines(spark, s, e, want):
    assert one(spark, "a\nb\nc\n", lambda c: T.read_lines(c, F.lit(s), F.lit(e))) == want


@pytest.mark.parametrize(("name", "want"), [("List[User]", "User"), ("Optional[str]", "str"), ("Dict[str, User]", "User"), ("X", "X")])
def test_base_type(spark, name, want):
    assert one(spark, name, T.base_type) == want


@pytest.mark.parametrize(("prefix", "ws", "want"), [("", "abc123", P.DEFAULT_PREFIX + "-abc123"), ("myproject", "x1", "myproject-x1")])
def test_collection_name(spark, prefix, ws, want):
    assert one(spark, prefix, lambda c: P.collection_name(c, F.lit(ws), F.lit(""))) == want


def test_truncation_in_a_sequence(spark):
    assert one(spark, "aéé", lambda c: T.truncate_bytes(c, 4)) == "aé�"
    assert one(spark, "aé", lambda c: T.truncate_bytes(c, 4)) == "aé"


def test_http_methods_and_scopes(spark):
    assert one(spark, "updateAll", T.http_methods) == ["PUT", "PATCH"]
    assert one(spark, "other", T.http_methods) == []
    assert one(spark, "scope", T.scope_name) is None


def test_embedder_is_deterministic_and_has_length_one(spark):
    from tessella.functions.embed import embed, with_retry

    v = one(spark, "some words here", embed)
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-5
    assert one(spark, "", embed) == [0.0] * 64
    calls = []

    def fails_twice(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert with_retry(fails_twice, sleep=lambda _: None)(5) == 5 and len(calls) == 3


def test_embedder_by_plain_loops():
    from zlib import crc32

    from tessella.functions.embed import hashing_embedder

    texts = ["", " ", "One two TWO three", "é ü\tone\n" * 40, "x" * 5000, *(" ".join(f"w{(i * j) % 37}" for j in range(i)) for i in range(60))]
    for dimension in (1, 7, 64):
        for text, got in zip(texts, hashing_embedder(dimension)(texts), strict=True):
            want = [0.0] * dimension
            for w in text.lower().split():
                want[crc32(w.encode()) % dimension] += 1 if crc32(w.encode()) >> 16 & 1 else -1
            norm = sum(x * x for x in want) ** 0.5 or 1.0
            assert all(abs(a - b / norm) < 1e-6 for a, b in zip(got.tolist(), want, strict=True))


def test_snippet_takes_the_first_line(spark):
    assert one(spark, "1\n2\nfoo\n4\n5\nfoo", lambda c: T.snippet(c, F.lit("foo"))) == "1\n2\nfoo\n4\n5"
    assert re.match("", one(spark, "x", lambda c: T.snippet(c, F.lit("foo"))))
