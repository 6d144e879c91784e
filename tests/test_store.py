"""Files, stores, streams and the parts that need folders."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tessella.operators import analyze as A
from tessella.operators import search as S
from tessella.operators import vector as V
from tessella.sources import files, store
from tessella.streaming import watch


def test_scan_and_index_of_a_tree(spark, tmp_path):
    for name, text in {"README.md": "# A\n\nText\n", "src/a.py": "def f():\n    return 1\n", "vendor/b.py": "def g(): pass\n", "src/c.go": "package c\nfunc F() {}\n", "docs/my_guide.md": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    scan = files.classify(files.scan(spark, str(tmp_path))).cache()
    assert {(r.path.split("/")[-1], r.language) for r in scan.collect()} == {("README.md", "markdown"), ("a.py", "python"), ("c.go", "go"), ("my_guide.md", "markdown")}
    rows = A.index_rows(A.analyze(scan))
    assert {r.name for r in rows.collect()} == {"f", "F"}
    assert A.markdown_chunks(scan.where("language = 'markdown'")).count() == 3
    titles = {r.title: r.description for r in files.resources(scan, str(tmp_path)).collect()}
    assert titles == {"README": "README documentation", "My Guide": "Technical documentation"}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0], "w", "go"), (2, [], "w", "go"), (None, [1.0], "w", "py")], "id long, embedding array<double>, workspace_id string, language string")
    s = store.Store(spark, f"file://{tmp_path}/t")
    assert not s.exists()
    s.create(rows)
    assert s.exists() and s.read().count() == 1
    s.create(rows)
    s.replace(spark.createDataFrame([(7, [1.0], "w", "py")], rows.schema))
    assert sorted(r.id for r in s.read().collect()) == [1, 7]
    with pytest.raises(NotImplementedError):
        s.clear()
    s.drop()
    assert not s.exists()
    assert store.rejected(rows).count() == 2


def test_zero_and_null_vectors_have_no_score(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, 1.0])], "id long, embedding array<double>")
    assert [(r.id, r.score) for r in V.top_k(rows, [1.0, 0.0], 5).collect()] == [(4, 0.707107)]


def test_fusion(spark):
    found = spark.createDataFrame([(1, "foo bar foo", 0.8), (2, "none", 0.9)], "id long, content string, score double")
    got = S.fuse(found, F.array(F.lit("foo"))).collect()
    assert [(r.id, r.lexical, r.hybrid) for r in got] == [(1, 2.0, 0.88)]
    assert S.fuse(found, F.array(F.lit("zzz"))).count() == 2


def test_usages(spark):
    rows = spark.createDataFrame([(1, "Impl1", "f", 1, "p", "Foo() + Foo()"), (2, "Impl2", "f", 9, "p", "Foo()"), (3, "Foo", "f", 20, "p", "Foo")], "id long, name string, file string, start_line int, package string, code string")
    assert [(r.name, r.occurrences) for r in S.usages(rows, "Foo").collect()] == [("Impl1", 2), ("Impl2", 1)]


def test_debounce_of_a_stream(spark, tmp_path):
    e = spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,x) AS ts, 'write' AS event_type FROM VALUES (0), (2), (4), (60), (500) AS t(x)")
    e.write.parquet(f"file://{tmp_path}/e")
    out = f"file://{tmp_path}/o"
    bursts = watch.debounce(watch.read_events(spark, f"file://{tmp_path}/e", e.schema), late="10 seconds")
    q = bursts.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.events for r in spark.read.parquet(out).collect()) in ([1, 3], [1, 1, 3])
    assert sorted(r.events for r in watch.debounce(e).collect()) == [1, 1, 3]


def test_index_workspace_follows_changes(spark, tmp_path):
    import os

    from tessella.plans.index import Config, index_workspace

    root, table = tmp_path / "ws", f"file://{tmp_path}/index"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("def f():\n    return 1\n")
    (root / "src/b.go").write_text("package b\nfunc B() {}\n")
    (root / "README.md").write_text("# One\n\nTwo\n")
    assert index_workspace(spark, str(root), table) == {"added": 3}
    names = lambda: sorted(r["name"] for r in spark.read.parquet(f"{table}/chunks").collect())
    assert names() == ["", "", "B", "f"]
    assert index_workspace(spark, str(root), table) == {"unchanged": 3}
    (root / "src/a.py").write_text("def g():\n    return 22\n")
    os.remove(root / "src/b.go")
    (root / "src/c.php").write_text("<?php function h() { return 1; }\n")
    assert index_workspace(spark, str(root), table) == {"unchanged": 1, "modified": 1, "deleted": 1, "added": 1}
    assert names() == ["", "", "g", "h"]
    assert index_workspace(spark, str(root), table) == {"unchanged": 3}
    assert Config.load({"dimension": 8}, {"TESSELLA_EXCLUDE": "a, b"}) == Config(dimension=8, exclude=["a", "b"])
    with pytest.raises(ValueError):
        Config.load({}, {"TESSELLA_OTHER": "1"})


def test_index_flag_and_collections(spark, tmp_path):
    from tessella.plans import index

    path = f"file://{tmp_path}/x"
    files = spark.createDataFrame([("/w/a.md", "text", 1), ("/w/b.py", "x = 1", 2)], "path string, content string, size long").withColumn("mod_time", F.lit("2024-01-02").cast("timestamp"))
    flag, other = index.IndexFlag(spark, path, "w"), index.IndexFlag(spark, path, "w")
    assert flag.start() and not other.start() and other.is_indexing()
    assert index.ensure_indexed(spark, files, path, "w") == "indexing"
    flag.stop()
    assert index.ensure_indexed(spark, files, path, "w") == "indexed" and index.ensure_indexed(spark, files, path, "w") == "there"
    assert index.acquire(spark, path, "w", "python", 2) and not index.acquire(spark, path, "w2", "go", 3)
    with pytest.raises(ValueError):
        index.acquire(spark, path, "w2", "go", 2)
    # The last file of a language takes its partition along; a second workspace stays.
    index.index_files(spark, files, path, "w2")
    assert index.index_files(spark, files.where("path LIKE '%md'"), path, "w") == {"deleted": 1, "unchanged": 1}
    left = {(r.workspace_id, r.language) for r in store.collections(store.Store(spark, f"{path}/chunks").read()).collect()}
    assert left == {("w", "markdown"), ("w2", "markdown"), ("w2", "python")}


def test_several_folders_are_indexed(spark, tmp_path):
    from tessella.plans import index

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("text")
    got = index.index_all(spark, [str(tmp_path / "a"), str(tmp_path / "none")], f"file://{tmp_path}/t", recreate=True)
    assert got[str(tmp_path / "a")] == {"added": 1} and "Exception" in got[str(tmp_path / "none")]


def test_rows_that_are_equally_new(spark):
    base = spark.createDataFrame([(1, "old", 0)], "id long, v string, n long")
    for news in ([(1, "a", 5), (1, "b", 5)], [(1, "b", 5), (1, "a", 5)]):
        assert [(r.id, r.v) for r in store.upsert(base, spark.createDataFrame(news, base.schema), "id", "n").collect()] == [(1, "b")]


def test_tool_parameters():
    from tessella.plans.tools import ToolError, check

    assert check("search_code", {"query": "x"}) == {"query": "x", "file_path": None, "limit": 5, "output_format": "markdown"}
    assert check("hybrid_search", {"query": "x", "limit": "7"})["limit"] == 7 and check("search_docs", {"query": "x", "limit": 0})["limit"] == 5
    for tool, args, told in [("none", {}, "unknown tool"), ("search_code", {}, "query is required"), ("search_code", {"query": ""}, "required"), ("search_code", {"query": "x", "y": 1}, "no parameter y"), ("search_code", {"query": 3}, "must be text"), ("search_code", {"query": "x", "limit": "a"}, "number"), ("search_code", {"query": "x", "limit": 1.5}, "whole"), ("search_code", {"query": "x", "output_format": "xml"}, "markdown, json"), ("get_code_context", {"file_path": "f", "start_line": 4, "end_line": 3}, "end_line")]:
        with pytest.raises(ToolError, match=told):
            check(tool, args)


def test_embedder_is_that_of_single_words():
    from zlib import crc32

    import numpy as np

    from tessella.functions.embed import hashing_embedder

    texts = ["the Cat the", "", "a b c a"]
    got = hashing_embedder(8)(texts)
    for row, text in zip(got, texts, strict=True):
        want = np.zeros(8)
        for w in text.lower().split():
            want[crc32(w.encode()) % 8] += 1 if crc32(w.encode()) >> 16 & 1 else -1
        assert np.allclose(row, want / (np.linalg.norm(want) or 1), atol=1e-6)


def test_small_tables_are_dealt_and_others_lie_as_they_are(spark):
    from tessella.plans.shared import spread

    path = f"{SF}/documents.parquet"
    small = spread(spark.read.parquet(path))
    assert small.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert small.exceptAll(spark.read.parquet(path)).count() == 0 and small.count() == spark.read.parquet(path).count()
    plan = small.where("doc_id > 5").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:" in plan and "text" not in plan.split("ReadSchema")[1]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        large = spark.read.parquet(path)
        assert spread(large) is large
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
