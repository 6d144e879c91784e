"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.shared import materialize


#: Up to so many links (16 bytes each) one task finds the components by itself.
FEW_LINKS = 200_000


def few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) to (v, component), by union-find."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(v) for v in up], pa.int64())], ["v", "component"])


def connected_components(links: DataFrame, rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(v, component) of every end of links (a, b): the smallest id that it reaches.

    Contraction: every vertex points to the smallest among itself and its neighbours (a map-side minimum, so a vertex with
    many links is one row a task), pointers are followed until they end (each time twice as far, so long chains take few
    steps), and links are drawn anew between the ends. Only vertices that are smaller than all their neighbours are left
    for the next round. Labels are then read backwards through the rounds. Rounds are written tables; nothing but whether
    something is left comes to the driver. Up to `few` links go through one task instead. Null ends and loops are ignored; repeated links count once.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return materialize(df.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    links = tidy(links)
    if links.limit(few + 1).count() <= few:
        return materialize(links.coalesce(1).mapInArrow(few_components, "v long, component long"), "labels")
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select("b", "a"))
        step = materialize(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v").alias("p"), F.lit(True).alias("moved")), "pointers")
        for _ in range(rounds):
            further = step.select(F.col("v").alias("p"), F.col("p").alias("q"))
            twice = step.join(further, "p").select("v", F.col("q").alias("p"))
            last = step.select(F.col("v").alias("p"), F.col("p").alias("q"))
            step = materialize(twice.join(last, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            if step.where("moved").isEmpty():
                break
        step = step.select("v", "p")
        steps.append(step)
        links = links.join(step.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(step.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        links = tidy(links.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    if not steps:
        return links.select(F.col("a").alias("v"), F.col("b").alias("component"))
    labels = steps[-1].select("v", F.col("p").alias("component"))
    for step in reversed(steps[:-1]):
        later = labels.select(F.col("v").alias("p"), "component")
        labels = materialize(step.join(later, "p", "left").select("v", F.coalesce("component", "p").alias("component")), "labels")
    return labels
