"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Every source's target: its weight's share of all words, at most ``cap`` times its own words, the excess
   reshared by weight. With caps c, weights w and total T the targets are min(c, w * level), where level is the
   largest (T - caps before) / (W - weights before) along the sources in order of c / w.
2. Documents are dealt to blocks by hash. A source's quota is whole passes over its blocks, then a permuted run of
   blocks, then of the block at the run's end as many documents as still fit best.
3. All quota units go down a binary tree: at each node a random permutation sends the first half left. The counts of a
   source below a node so are multivariate hypergeometric draws; at the leaves they are exact quotas of shards.
4. Each shard draws its quota from a second permutation of the source's units, disjoint from the other shards'.
5. apply_mixture() shuffles locally: a shard's copies are dealt to parts by hash and ordered by hash within; write_mixture() writes a folder a shard.

Blocks hold at least ``least_block`` words and are at most about ``most_blocks`` in number, so that the tables of blocks
and units are bounded however large the input is. All draws are hashes: reruns agree.

Null text has size 0 and is never taken; a null source is a source, last in order. Rows that agree in id, source and text
are dealt as one and share their fate. An empty table gives no rows. The table of sources is ordered by one task, at some 60 bytes a source. Only the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, word_count

#: Sources up to which their table is broadcast; it has some 60 bytes a row.
BROADCAST_SOURCES = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size -> with source_no, weight, total, target. One row per source, so one task orders them."""
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    no = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    df = sizes.select("source", "source_size", no.alias("source_no"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    df = df.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * cap)
    df = df.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weights", F.sum("weight").over(everything))
    before = W.orderBy(F.col("ceiling") / F.col("weight"), "source_no").rowsBetween(W.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    df = df.withColumn("level", (F.col("total") - spent("ceiling")) / (F.col("all_weights") - spent("weight")))
    df = df.withColumn("level", F.max("level").over(everything))
    return df.select("source", "source_size", "source_no", "weight", "total", F.least("ceiling", F.col("weight") * F.col("level")).alias("target"))


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def plan_mixture(
    docs: DataFrame, shards: int = 16, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17,
    least_block: int = 16_384, most_blocks: int = 32_768, doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per distinct (doc_id, text_key, source): n_rows, size, source_size, target, copies ARRAY<INT> (the shard of each copy)."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = materialise(rows.groupBy("doc_id", "text_key", "source").agg(F.count("*").alias("n_rows"), F.first("size").alias("size")))
    targets = materialise(source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")), weights, cap))
    small = targets.count() <= BROADCAST_SOURCES
    side = F.broadcast(targets) if small else targets
    block_words = F.greatest(F.lit(float(least_block)), F.col("total") / most_blocks)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    rows = rows.withColumnRenamed("source", "own").join(side, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), n_blocks))

    # 2: quotas in blocks
    blocks = rows.groupBy("source_no", "block").agg(F.sum(F.col("size") * F.col("n_rows")).alias("block_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = blocks.where(F.col("block_size") > 0)
    passes = F.floor(F.col("target") / F.col("source_size"))
    run = W.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", F.lit(seed + 1)), "block").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.withColumn("upto", F.sum("block_size").over(run)).withColumn("rest", F.col("target") - passes * F.col("source_size"))
    whole = (F.col("upto") <= F.col("rest")).cast("int")
    partial = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("block_size") < F.col("rest"))
    blocks = blocks.select("source_no", "block", (passes.cast("int") + whole).alias("n_whole"), F.when(partial, F.col("rest") - F.col("upto") + F.col("block_size")).otherwise(F.lit(0.0)).alias("fill"))
    n_units = F.col("n_whole") + (F.col("fill") > 0).cast("int")
    units = blocks.where(n_units > 0).select("source_no", "block", "fill", "n_whole", F.explode(F.sequence(F.lit(0), n_units - 1)).alias("copy"))
    units = units.select("source_no", "block", "copy", "fill", (F.col("copy") == F.col("n_whole")).alias("partial"))
    units = materialise(units)

    # 3: the tree
    tree = units.select("source_no", "block", "copy", F.lit(0).alias("node"))
    for level in range(shards.bit_length() - 1):
        at = W.partitionBy("node")
        rank = F.row_number().over(at.orderBy(F.xxhash64("source_no", "block", "copy", F.lit(seed + 2 + level)), "source_no", "block", "copy"))
        right = (rank > F.floor((F.count("*").over(at) + F.pmod(F.xxhash64("node", F.lit(seed + level)), F.lit(2))) / 2)).cast("int")
        tree = tree.select("source_no", "block", "copy", (F.col("node") * 2 + right).alias("node"))
    # 4: each shard's draw, disjoint
    quota = tree.select("source_no", F.col("node").alias("shard"), F.row_number().over(W.partitionBy("source_no").orderBy("node")).alias("place"))
    order = W.partitionBy("source_no").orderBy(F.xxhash64("source_no", "block", "copy", F.lit(seed - 1)), "block", "copy")
    drawn = units.withColumn("place", F.row_number().over(order)).join(quota, ["source_no", "place"])
    entry = F.struct("copy", "shard", "partial", "fill")
    drawn = drawn.groupBy("source_no", "block").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # at most cap + 1 a block

    within = W.partitionBy("source_no", "block").orderBy(F.xxhash64("doc_id", "text_key", F.lit(seed - 2)), "doc_id", "text_key")
    upto = F.sum(F.col("size") * F.col("n_rows")).over(within.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).join(drawn, ["source_no", "block"], "left")
    fits = lambda e: ~e["partial"] | (F.col("upto") - F.col("size") * F.col("n_rows") / 2 <= e["fill"])
    copies = F.transform(F.filter(F.coalesce("entries", F.array()), fits), lambda e: e["shard"])
    return rows.select("doc_id", "text_key", "source", "n_rows", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.array().cast("array<int>")).alias("copies"))


def mixture_summary(plan: DataFrame) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken, copies."""
    each = plan.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")


def apply_mixture(docs: DataFrame, plan: DataFrame, shards: int = 16, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard: str | None = "shard") -> DataFrame:
    """The documents, each as often as the plan takes it, in random order within their shard, with its copy's shard in a column of that name (None: without), which replaces one of docs.

    Documents without words are in no copy; rows that agree in id, source and text are each copied as their plan says. A shard is dealt to parts,
    in all 8 a shuffle partition, so that partitions are even; each is sorted by hash. Copies of a document get places of their own.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("_id"), text_key(text).alias("_key"), F.col(source).alias("_own"))
    taken = plan.where(F.size("copies") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), F.col("source").alias("_source"), "copies")
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")) & F.col("_own").eqNullSafe(F.col("_source"))
    each = rows.join(taken, same).select("row", "_id", "_key", F.posexplode("copies").alias("_copy", "_shard"))
    parts = -(-8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    each = each.withColumn("_place", F.xxhash64("_id", "_key", "_copy", F.lit(seed))).withColumn("_part", F.pmod(F.xxhash64("_place", F.lit(seed)), F.lit(parts)))
    each = each.repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", "_place")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != shard]
    return each.select(*kept, *([F.col("_shard").alias(shard)] if shard else []))


def write_mixture(mixed: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard; files keep the order that apply_mixture() gives. An empty mix writes no folder of a shard."""
    mixed.write.partitionBy(shard).parquet(path)
