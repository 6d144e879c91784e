"""Nulls, empty and very long texts, repeated rows, ties, clashing names and empty tables, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import bpe, media, mixing, ngram_join, pii, quality, secrets, spotsigs, url_filters, warc

CLASHES = ["ids", "h", "size", "rule", "n", "score", "component_id", "draws", "block", "copies", "n_replaced", "label", "stats", "digest", "packed", "held_out", "items", "ref", "base", "linked", "weak", "tokens", "bucket", "target", "taken", "_made"]
LONG = "word after word in the long text of it " * 6000
TEXTS = ["the quick brown fox jumps over the lazy dog again and again", None, "", " \n\t ", LONG, "mail a.b@c.example.org token = abcdefghijkl"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 2 else "en", None if i == 2 else f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "text without an id, but with words", "en", "s0", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.coalesce(2).cache()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://A.b.org/x?q", "x" * 200), (2, "ftp://b.org", "x" * 200), (2, "ftp://b.org", "x" * 200), (3, None, None), (None, "no scheme", "x" * 200), (4, "", ""), (5, "https://x/" + "p" * 70000, LONG * 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (0, 1), (2, 0), (4, None), (None, 1), (99, 0)], "doc_id long, quality int")


def operators(spark, docs, pages, labels):
    rules = spark.createDataFrame(url_filters.RULES + [("block", None, "/"), ("block", "x.org", None)], "verdict string, host string, path string")
    return {
        "urls": lambda: url_filters.judge_urls(pages, rules),
        "mixing": lambda: mixing.mix_sources(docs, [3, 1, 2], shard_words=500),
        "secrets": lambda: secrets.secret_digests(docs),
        "ngrams": lambda: ngram_join.ngram_components(docs, 4, 85),
        "quality": lambda: quality.classify(docs, labels),
        "pii": lambda: pii.pseudonymize(docs, "k"),
        "media": lambda: media.media_digests(docs),
        "bpe": lambda: bpe.token_digests(docs),
        "spotsigs": lambda: spotsigs.fingerprints(docs),
        "warc": lambda: warc.read_archives(spark, warc.write_archives(pages)),
    }


NAMES = ["urls", "mixing", "secrets", "ngrams", "quality", "pii", "media", "bpe", "spotsigs", "warc"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, docs, pages, labels, name):
    source, key = (pages, "page_id") if name in ("urls", "warc") else (docs, "doc_id")
    out = operators(spark, docs, pages, labels)[name]().collect()
    want = sorted(str(r[key]) for r in source.select(key).collect())
    assert sorted(str(r[key]) for r in out) == want


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, docs, pages, labels, name):
    assert operators(spark, docs.limit(0), pages.limit(0), labels.limit(0))[name]().collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_repeated_rows_agree(spark, docs, pages, labels, name):
    out = [r for r in operators(spark, docs, pages, labels)[name]().collect() if r[0] == (2 if name in ("urls", "warc") else 0)]
    assert len(out) > 1 and all(str(r) == str(out[0]) for r in out)


def test_defined_results(spark, docs, pages, labels):
    ops = operators(spark, docs, pages, labels)
    by = {r.doc_id: r for r in ops["ngrams"]().collect()}
    assert (by[1].n_shingles, by[1].component_id, by[3].n_shingles, by[0].component_id) == (0, 1, 0, 0) and by[None].component_id is None
    assert {r.doc_id: r for r in ops["bpe"]().collect()}[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: r for r in ops["media"]().collect()}[1].payload_bytes == 192
    got = {r.page_id: r for r in ops["urls"]().collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.b.org", "/x", "org/", "allow")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict, got[2].rule) == ("", "", None, "allow", None)
    w = {r.page_id: r for r in ops["warc"]().collect()}
    assert (w[1].record_type, w[2].record_type, w[2].refers_to, w[3].record_type, w[None].refers_to) == ("response", "revisit", 1, "response", 1)
    assert all(r.score == 0.5 for r in quality.classify(docs, labels.limit(0)).collect())


def test_bytes_of_texts_that_share_a_padded_picture(spark):
    rows = [(1, ""), (2, " "), (3, "abc"), (4, "abc "), (4, "abc  "), (5, None), (None, "abc   ")]
    out = media.media_digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in out) == sorted((str(d), len(t or "")) for d, t in rows)
    assert len({r.media_sha256 for r in out}) == 2


@pytest.mark.parametrize("i", range(5))
def test_pipeline_stages(spark, docs, labels, tmp_path, i):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[i]
    out = stage(spark, docs, f"file://{tmp_path}")
    if i < 4:
        assert out.columns == corpus_pipeline.COLUMNS
    rows = out.collect()
    if name.startswith("mixing"):  # rows with and without an id are drawn, blank texts never
        assert {r.doc_id for r in rows} >= {0, 4, None} and all((r.text or "").strip() for r in rows)
    elif i >= 2:
        assert sum(r.doc_id is None for r in rows) == 2
    assert stage(spark, docs.limit(0), f"file://{tmp_path}").collect() == []
