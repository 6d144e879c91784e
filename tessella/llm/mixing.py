"""Mixing sources to target weights.

Method: a splitting tree. The rows of a source are dealt to blocks by a keyed hash (a random permutation, cut). The
mix takes an exact number of blocks of every source: whole passes over the source, then the blocks in order until
the target's words are reached. These quotas are split between two halves of the output shards by a multivariate hypergeometric
draw, the halves likewise, down to single shards; so a shard's composition is as that of a shuffled whole, and sums are exact. Each shard then
takes the next blocks of every source (disjoint by construction), and rows are put in random order inside a shard.

DataFrame operations only. Hypergeometric numbers are drawn by inversion: from the mode outwards until the probability mass
passes a hash-derived uniform number, with log factorials from Stirling's series. All draws depend on seed, doc_id, text and
source only, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.shared import materialize

#: Blocks of every source for each output shard: enough that a shard's mixture is fine-grained.
BLOCKS_A_SHARD = 64
#: Words of an output shard.
SHARD_WORDS = 4_000_000
#: Sources up to which the table of sources (about 50 bytes each) is broadcast, and blocks (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES, BROADCAST_BLOCKS = 100_000, 200_000
#: Levels of the tree that one row is split by at once (2**6 nodes).
LEVELS = 6
#: Blocks whose running sums are made in one window.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = "struct<first:bigint,width:bigint,size:bigint,held:array<struct<sid:bigint,n:bigint,low:bigint>>>"
DRAWS = "array<struct<pass:bigint,shard:bigint>>"


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    h = F.xxhash64(*(F.lit(p) if isinstance(p, (str, int)) else p for p in parts))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def log_factorial(n: Column) -> Column:
    """log(n!) for whole n >= 0: a table of small values, Stirling's series beyond."""
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.element_at(small, F.least(n, F.lit(15)).cast("int") + 1)).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items out of `total` are marked, at the quantile u of a fixed order of outcomes.

    The walk ends 20 standard deviations and 40 steps from the mode: what lies beyond has a probability that doubles can't add to the rest.
    """
    low, high = F.greatest(F.lit(0), drawn + marked - total), F.least(drawn, marked)
    mode = F.greatest(low, F.least(high, F.floor((drawn + 1).cast("double") * (marked + 1) / (total + 2)).cast("long")))
    top = F.exp(log_choose(marked, mode) + log_choose(total - marked, drawn - mode) - log_choose(total, drawn))
    sd = F.sqrt(drawn.cast("double") * marked * F.greatest(total - marked, F.lit(0)) / (F.greatest(total, F.lit(1)) * F.greatest(total, F.lit(1))))
    steps = F.least(high - low, F.ceil(20 * sd).cast("long") + 40)
    state = F.struct(top.alias("mass"), mode.alias("up"), top.alias("p_up"), mode.alias("down"), top.alias("p_down"), F.when((u < top) | (low == high), mode).alias("result"), low.alias("low"), high.alias("high"), total.alias("n"), marked.alias("k"), drawn.alias("d"), u.alias("u"))

    def step(s: Column, i: Column) -> Column:
        """The next outcome: above and below the mode in turn, where there is one."""
        may_up, may_down = s["up"] < s["high"], s["down"] > s["low"]
        upward = may_up & ((i % 2 == 1) | ~may_down)
        downward = ~upward & may_down
        p_up = s["p_up"] * ((s["k"] - s["up"]) * (s["d"] - s["up"])).cast("double") / ((s["up"] + 1) * (s["n"] - s["k"] - s["d"] + s["up"] + 1))
        p_down = s["p_down"] * (s["down"] * (s["n"] - s["k"] - s["d"] + s["down"])).cast("double") / ((s["k"] - s["down"] + 1) * (s["d"] - s["down"] + 1))
        mass = s["mass"] + F.when(upward, p_up).when(downward, p_down).otherwise(0.0)
        up, down = F.when(upward, s["up"] + 1).otherwise(s["up"]), F.when(downward, s["down"] - 1).otherwise(s["down"])
        here = F.when(upward, up).otherwise(down)
        done = F.when(s["result"].isNotNull(), s["result"]).when((s["u"] < mass) & (upward | downward), here)
        moved = F.struct(mass.alias("mass"), up.alias("up"), F.when(upward, p_up).otherwise(s["p_up"]).alias("p_up"), down.alias("down"), F.when(downward, p_down).otherwise(s["p_down"]).alias("p_down"), done.alias("result"), s["low"].alias("low"), s["high"].alias("high"), s["n"].alias("n"), s["k"].alias("k"), s["d"].alias("d"), s["u"].alias("u"))
        return F.when(s["result"].isNotNull(), s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1))), state, step, lambda s: F.coalesce(s["result"], s["up"]))


def with_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sources(source, source_size, ...) with sid (place in order of code points, null last) and target (words).

    Targets sum up to share * all sizes, in proportion to weights (repeating by sid), at most `most` times a source's size;
    what a capped source leaves is shared by weight among the others. With r = cap / weight in ascending order, a source is
    capped if the words left after the sources before it, per weight left, reach its r: one pass finds all.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    out = sources.withColumn("sid", (F.row_number().over(one) - 1).cast("long")).withColumn("weight", w)
    out = out.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("budget", share * F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct("ratio", "sid", "level"))).over(whole)["level"]
    return out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final)).drop("weight", "cap", "ratio", "budget", "all_weight", "level", "capped")


def halves(node: Column, seed: int) -> Column:
    """A node's two halves, each with its share of every source (none with 0); a single shard stays."""
    left_width = F.floor((node["width"] + 1) / 2).cast("long")
    to_left = F.floor(node["size"] * left_width / node["width"]).cast("long")
    start = F.struct(node["size"].alias("total"), to_left.alias("drawn"), F.array().cast("array<bigint>").alias("left"))

    def draw(s: Column, x: Column) -> Column:
        got = F.when(s["total"] <= 0, F.lit(0).cast("long")).otherwise(hypergeometric(s["total"], x["n"], s["drawn"], uniform(seed, node["width"], node["first"], x["sid"])))
        return F.transform(F.array(got), lambda g: F.struct((s["total"] - x["n"]).alias("total"), (s["drawn"] - g).alias("drawn"), F.concat(s["left"], F.array(g)).alias("left")))[0]

    def both(left: Column) -> Column:
        mine = F.zip_with(node["held"], left, lambda x, n: F.struct(x["sid"].alias("sid"), n.alias("n"), x["low"].alias("low")))
        other = F.zip_with(node["held"], left, lambda x, n: F.struct(x["sid"].alias("sid"), (x["n"] - n).alias("n"), (x["low"] + n).alias("low")))
        some = lambda held: F.filter(held, lambda x: x["n"] > 0)
        return F.array(
            F.struct(node["first"].alias("first"), left_width.alias("width"), to_left.alias("size"), some(mine).alias("held")),
            F.struct((node["first"] + left_width).alias("first"), (node["width"] - left_width).alias("width"), (node["size"] - to_left).alias("size"), some(other).alias("held")),
        ).cast(f"array<{NODE}>")

    split = F.transform(F.array(F.aggregate(node["held"], start, draw, lambda s: s["left"])), both)[0]
    return F.when(node["width"] > 1, split).otherwise(F.array(node).cast(f"array<{NODE}>"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, sid, low, n): of quotas(sid, quota), the exact number each shard takes, and where its run begins.

    A node of the tree holds the numbers of the sources that it has anything of. Its halves' numbers are drawn from the node
    alone, so LEVELS levels grow inside a row, and the rows are then dealt anew. Shards hold equal numbers of blocks (to within one).
    """
    held = F.sort_array(F.collect_list(F.struct("sid", F.col("quota").alias("n"), F.lit(0).cast("long").alias("low"))))
    root = quotas.where("quota > 0").agg(held.alias("held"), F.coalesce(F.sum("quota"), F.lit(0)).cast("long").alias("size"))
    nodes = root.select(F.struct(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("width"), "size", "held").cast(NODE).alias("node"))
    depth = math.ceil(math.log2(max(shards, 1)))
    for done in range(0, depth, LEVELS):
        if done:
            nodes = nodes.repartition("node.first")
        levels = F.sequence(F.lit(1), F.lit(min(LEVELS, depth - done)))
        grown = F.aggregate(levels, F.array("node").cast(f"array<{NODE}>"), lambda ns, _: F.flatten(F.transform(ns, lambda n: halves(n, seed))))
        nodes = materialize(nodes.select(F.explode(grown).alias("node")), "nodes")
    return nodes.select(F.col("node.first").alias("shard"), F.explode("node.held").alias("x")).select("shard", "x.sid", "x.low", "x.n").where("n > 0")


def running(table: DataFrame) -> DataFrame:
    """table(sid, block, words) with at (place among its source's blocks), before (words of the blocks before) and count (of its source's blocks).

    Sums run over RUN blocks at a time, and over the runs.
    """
    table = table.withColumn("run", F.floor(F.col("block") / RUN))
    order, before = Window.partitionBy("sid").orderBy("run"), Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = table.groupBy("sid", "run").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("c"))
    zero = F.lit(0).cast("long")
    runs = runs.select("sid", "run", F.coalesce(F.sum("w").over(before), zero).alias("words_before"), F.coalesce(F.sum("c").over(before), zero).alias("blocks_before"), F.sum("c").over(Window.partitionBy("sid")).alias("count"))
    inside = Window.partitionBy("sid", "run").orderBy("block")
    out = table.join(runs, ["sid", "run"])
    return out.select("sid", "block", "words", (F.col("blocks_before") + F.row_number().over(inside) - 1).alias("at"), (F.col("words_before") + F.sum("words").over(inside) - F.col("words")).alias("before"), "count")


def mix_rows(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: int = 11, shard_words: int = SHARD_WORDS, blocks: int | None = None) -> DataFrame:
    """(row, size, source_size, target, draws): every row of docs(doc_id, text, source, ...) once, as the struct `row` of all its columns.

    size: words of the text (null: 0). draws: array of pass, shard, words and order, one for each time the mix takes the row: whole in whole passes;
    the row at which a source's quota ends is taken in part, by its first words (rows that are equal in doc_id, source and text share that part
    evenly, rounded down). order is the row's random key inside the shard.

    A source's taken words are its target rounded down, as far as its words and that sharing allow; a row's are at most ceil(most) times
    its size, and rows without words are never drawn. Null sources are one source, the last. Null ids and repeated rows are rows like others. An empty
    table gives an empty result. Texts go through no shuffle while the table of blocks can be broadcast.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    sized = materialize(docs.select(F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(with_targets(sources, weights, share, most), "sources")
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    shards = max(1, math.ceil(total / shard_words))
    blocks = blocks or BLOCKS_A_SHARD * shards
    goal = F.floor(F.col("target") + 1e-6).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.select("source", "sid", "source_size", "target", passes.alias("passes"), (goal - passes * F.col("source_size")).alias("rest"))
    few_sources = F.broadcast if n_sources <= BROADCAST_SOURCES else lambda df: df

    block = F.pmod("key", F.lit(blocks))
    known = sized.join(few_sources(plan.select(F.col("source").alias("s"), "sid")), F.col("source").eqNullSafe(F.col("s"))).select("sid", block.alias("block"), "key", "size")
    table = running(known.groupBy("sid", "block").agg(F.sum("size").alias("words")))
    table = materialize(table.join(few_sources(plan.select("sid", "passes", "rest")), "sid"), "blocks")
    part = (F.col("rest") > F.col("before")).cast("long")
    quotas = table.groupBy("sid").agg((F.first("passes") * F.first("count") + F.sum(part)).alias("quota"))
    runs = split_quotas(quotas, shards, seed).select("sid", "shard", F.explode(F.sequence("low", F.col("low") + F.col("n") - 1)).alias("item"))
    items = table.where("passes > 0 OR rest > before").select("sid", "block", "at", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") + part - 1)).alias("pass"))
    items = items.select("sid", "block", "pass", (F.col("pass") * F.col("count") + F.col("at")).alias("item"))
    draws = items.join(runs, ["sid", "item"]).groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))

    # Where the quota ends inside a block: keys below the cut are taken whole, those at it share what is left.
    ends = table.where("rest > before AND rest < before + words").select("sid", "block", (F.col("rest") - F.col("before")).alias("left"))
    at_keys = known.join(F.broadcast(ends) if n_sources <= BROADCAST_SOURCES else ends, ["sid", "block"]).groupBy("sid", "left", "key").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
    upto = F.sum("w").over(Window.partitionBy("sid").orderBy("key"))
    cuts = at_keys.withColumn("upto", upto).where("upto >= left").groupBy("sid").agg(F.min(F.struct("key", F.floor((F.col("left") - F.col("upto") + F.col("w")) / F.col("n")).alias("share"))).alias("cut"))
    table = table.join(draws, ["sid", "block"], "left").join(few_sources(cuts), "sid", "left")
    table = materialize(table.select("sid", "block", F.coalesce("draws", F.array().cast(DRAWS)).alias("draws"), F.when((F.col("rest") > F.col("before")) & (F.col("rest") < F.col("before") + F.col("words")), F.col("cut")).alias("cut")), "drawn")
    few_blocks = F.broadcast if table.count() <= BROADCAST_BLOCKS else lambda df: df

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key")).withColumn("block", block)
    rows = rows.join(few_sources(plan.select(F.col("source").alias("s"), "sid", "source_size", "target", "passes")), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.join(few_blocks(table), ["sid", "block"])
    cut = F.when(F.col("cut").isNull() | (F.col("key") < F.col("cut.key")), F.col("size")).when(F.col("key") == F.col("cut.key"), F.least("size", "cut.share")).otherwise(0)
    words = lambda d: F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(cut)
    taken = F.transform("draws", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), words(d).alias("words"), F.xxhash64(F.lit(seed), F.col("key"), d["pass"], d["shard"]).alias("order")))
    return rows.select("row", "size", "source_size", "target", F.filter(taken, lambda d: d["words"] > 0).alias("draws"))


def mix_sources(docs: DataFrame, weights: list[float], **settings) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, draws) of every row; see mix_rows(). taken: words, repeats counted."""
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return mix_rows(docs.select("doc_id", "text", "source"), weights, **settings).select("row.doc_id", F.col("row.source").cast("string").alias("source"), "size", "source_size", "target", taken.alias("taken"), "draws")


def shards(mix: DataFrame) -> DataFrame:
    """mix with a row for each draw, as shard, pass, words and order in place of draws: a shard's rows together, in random order.

    Partitions are ranges of shard and order, so they are of like size however many shards there are; a shard that is cut goes on in the next one.
    """
    rows = mix.withColumn("d", F.explode("draws")).drop("draws").select("*", "d.*").drop("d")
    return rows.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")
