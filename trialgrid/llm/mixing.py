"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. Per source the documents stand in a pseudo-random
order (a digest of seed and doc_id); whole passes over the source and one
partial pass, up to the target, give the stream that is drawn. The stream is
cut into blocks of equally many words, so a source's quota is an exact number
of blocks. A binary tree over the output shards splits the quotas: at each node
the left half's blocks are a multivariate hypergeometric draw from the node's
quotas. Shard by shard each source hands out disjoint runs of its blocks, and a
shard orders its own rows by a second digest.

Positions come from prefix sums in two steps (inside hash buckets of a source
whose number follows its rows, then over bucket totals), so that a source with
a third of all rows isn't ordered in one task. One row per source (totals,
quotas of a tree node) is treated as metadata: it must fit in a task.

Defined cases: a null text has size 0; a null source is a source, last in
order; a null doc_id is an id like any other; rows that agree in doc_id, source
and text are drawn alike; a source without words has target 0; an empty table
gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.llm.common import hex_fraction, pick, word_count
from trialgrid.session import written

ROWS_PER_BUCKET = 16384
#: A mix is cut into so many shards at least, and so many words a shard at most on average.
LEAST_SHARDS, WORDS_PER_SHARD = 16, 1 << 23
LEAST_BLOCK_WORDS, MOST_BLOCKS = 2048, 1_000_000


def source_targets(sources: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.0,
                   max_epochs: float = 3.0) -> DataFrame:
    """Adds `target` to rows (source_key, source, source_size): `share` of all
    words by weight, never above `max_epochs` times the source's size, the
    excess going to the others by weight. In order of the level at which they
    reach their cap, the sources before the solution are at their caps; the
    common level is the largest one over all such prefixes."""
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = (sources.withColumn("weight", weight)
              .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    every = Window.partitionBy(F.lit(1))
    by_level = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = ((F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), zero))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)))
    return (capped.withColumn("level", level).withColumn("level", F.max("level").over(every))
            .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
            .drop("weight", "cap", "level"))


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` blocks, drawn without replacement from `total`, are
    among the `marked` ones: the inverse of the distribution function at `u`.
    Weights run from 12 standard deviations below the mode to 12 above it;
    what lies outside is below the precision of a double."""

    def ratio(x, k):  # P(k) / P(k - 1)
        return ((x.marked - k + 1).cast("double") * (x.draws - k + 1)
                / (k.cast("double") * (x.total - x.marked - x.draws + k)))

    def bounds(x):
        low = F.greatest(F.lit(0), x.draws + x.marked - x.total)
        high = F.least(x.draws, x.marked)
        part = x.marked.cast("double") / F.greatest(x.total, F.lit(1))
        mode = F.floor((x.draws + 1).cast("double") * (x.marked + 1) / (x.total + 2))
        deviation = F.sqrt(F.greatest(F.lit(0.0), x.draws * part * (1 - part) * (x.total - x.draws)
                                      / F.greatest(x.total - 1, F.lit(1))))
        width = F.ceil(12 * deviation) + 4
        return F.struct(x.total.alias("total"), x.marked.alias("marked"), x.draws.alias("draws"), x.u.alias("u"),
                        F.greatest(low, F.least(high, mode) - width).cast("bigint").alias("a"),
                        F.least(high, mode + width).cast("bigint").alias("b"))

    def steps(x):
        return F.when(x.b > x.a, F.sequence(x.a + 1, x.b)).otherwise(F.array().cast("array<bigint>"))

    def invert(x):
        whole = F.aggregate(steps(x), F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s")),
                            lambda acc, k: F.struct((acc.w * ratio(x, k)).alias("w"),
                                                    (acc.s + acc.w * ratio(x, k)).alias("s"))).s
        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), x.a.alias("k"), (x.u * whole).alias("goal"))
        return F.aggregate(steps(x), start, lambda acc, k: F.struct(
            (acc.w * ratio(x, k)).alias("w"), (acc.s + acc.w * ratio(x, k)).alias("s"),
            F.when(acc.s >= acc.goal, acc.k).otherwise(k).alias("k"), acc.goal.alias("goal"))).k

    given = F.struct(total.cast("bigint").alias("total"), marked.cast("bigint").alias("marked"),
                     draws.cast("bigint").alias("draws"), u.alias("u"))
    return _let(_let(given, bounds), invert)


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(shard, source_key, quota) for quotas (source_key, quota): level by level
    each tree node's quotas are split between its two halves of shards."""
    tree = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("source_key", F.col("quota").alias("k"))))
                                .alias("q"))
    tree = tree.select(F.lit(0).cast("bigint").alias("first"), F.lit(n_shards).cast("bigint").alias("shards"), "q")

    def draw(acc, x):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("first"), F.col("shards"), x.source_key), 11)
        k = F.when(acc.n > 0, hypergeometric(acc.total, x.k, acc.n, u / F.lit(float(2 ** 53)))).otherwise(F.lit(0))
        return _let(k.cast("bigint"), lambda left: F.struct(
            F.concat(acc.left, F.array(left)).alias("left"), (acc.n - left).alias("n"),
            (acc.total - x.k).alias("total")))

    for _ in range(math.ceil(math.log2(max(1, n_shards)))):
        half = tree.withColumn("half", F.ceil(F.col("shards") / 2).cast("bigint"))
        half = half.withColumn("n", F.aggregate("q", F.lit(0).cast("bigint"), lambda acc, x: acc + x.k))
        start = F.struct(F.array().cast("array<bigint>").alias("left"),
                         F.round(F.col("n") * F.col("half") / F.col("shards")).cast("bigint").alias("n"),
                         F.col("n").alias("total"))
        drawn = half.withColumn("left", F.aggregate("q", start, draw).left)
        lower = F.struct(F.col("first"), F.col("half").alias("shards"),
                         F.zip_with("q", "left", lambda x, k: F.struct(x.source_key, k.alias("k"))).alias("q"))
        upper = F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("shards") - F.col("half")).alias("shards"),
                         F.zip_with("q", "left", lambda x, k: F.struct(x.source_key, (x.k - k).alias("k"))).alias("q"))
        tree = (drawn.select(F.explode(F.array(lower, upper)).alias("node"))
                .select("node.*").where(F.col("shards") > 0))
    return (tree.select(F.col("first").alias("shard"), F.explode("q").alias("x"))
            .select("shard", "x.source_key", F.col("x.k").alias("quota")))


def mix(documents: DataFrame, weights: tuple = (5.0, 2.0, 1.0), share: float = 1.0, max_epochs: float = 3.0,
        n_shards: int | None = None, seed: int = 20, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """One row per drawn copy of a document, and one with null `copy` and
    `shard` for each document that isn't drawn: doc_id, source, size,
    fingerprint (of the text), n_alike (rows that agree in all of these),
    row_no (numbers the documents of a source), copy, shard, block, rank (orders
    a shard), source_size, target."""
    spark = documents.sparkSession
    text = F.col("text")
    rows = (pick(documents, doc_id=id_col, text=text_col, source=source_col)
            .select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("fingerprint"))
            .groupBy("doc_id", "source", "size", "fingerprint").agg(F.count(F.lit(1)).alias("n_alike")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = written(rows.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
                   .withColumn("digest", F.md5(F.concat_ws("|", F.lit(str(seed)), name).cast("binary")))
                   .withColumn("weight", F.col("size") * F.col("n_alike")), "mix-rows")
    sources = rows.groupBy("source_key", "source").agg(F.sum("weight").alias("source_size"),
                                                       F.count(F.lit(1)).alias("source_rows"))
    block = F.greatest(F.lit(LEAST_BLOCK_WORDS),
                       F.ceil(F.sum("target").over(Window.partitionBy(F.lit(1))) / MOST_BLOCKS)).cast("bigint")
    sources = written(source_targets(sources, weights, share, max_epochs).withColumn("block_words", block)
                      .withColumn("quota", F.ceil(F.col("target") / F.col("block_words")).cast("bigint"))
                      .withColumn("buckets", F.ceil(F.col("source_rows") / ROWS_PER_BUCKET).cast("bigint")),
                      "mix-sources")

    placed = (rows.drop("source").join(sources, "source_key")
              .withColumn("bucket", F.floor(hex_fraction(F.col("digest")) * F.col("buckets"))))
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("digest", "doc_id", "size", "fingerprint")
    earlier = F.sum("weight").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    placed = (placed.withColumn("words_before", F.coalesce(earlier, F.lit(0)))
              .withColumn("rows_before", F.row_number().over(in_bucket) - 1))
    totals = (rows.select("source_key", "digest", "weight").join(sources.select("source_key", "buckets"), "source_key")
              .groupBy("source_key", F.floor(hex_fraction(F.col("digest")) * F.col("buckets")).alias("bucket"))
              .agg(F.sum("weight").alias("bucket_words"), F.count(F.lit(1)).alias("bucket_rows")))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source_key", "bucket",
                           F.coalesce(F.sum("bucket_words").over(ahead), F.lit(0)).alias("words_ahead"),
                           F.coalesce(F.sum("bucket_rows").over(ahead), F.lit(0)).alias("rows_ahead"))
    placed = (placed.join(totals, ["source_key", "bucket"])
              .withColumn("position", F.col("words_before") + F.col("words_ahead"))
              .withColumn("row_no", F.col("rows_before") + F.col("rows_ahead")))

    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    partial = (F.col("position") + F.col("weight") / 2 < rest).cast("bigint")
    copies = placed.withColumn("passes", passes).withColumn("copies", (F.col("passes") + partial).cast("bigint"))
    drawn = copies.withColumn("copy", F.explode_outer(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))))
    drawn = drawn.withColumn("block", F.floor((F.col("copy") * F.col("source_size") + F.col("position"))
                                              / F.col("block_words")).cast("bigint"))

    if n_shards is None:
        words = sources.agg(F.sum("target")).first()[0] or 0
        n_shards = max(LEAST_SHARDS, math.ceil(words / WORDS_PER_SHARD))
    shares = split_quotas(sources.where("quota > 0").select("source_key", "quota"), n_shards, seed)
    handed = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = shares.withColumn("given", F.coalesce(F.sum("quota").over(handed), F.lit(0))).where("quota > 0")
    slots = runs.select("source_key", "shard",
                        F.explode(F.sequence(F.col("given"), F.col("given") + F.col("quota") - 1)).alias("slot"))
    # a shard draws its blocks from anywhere in its source: slots are block numbers in an order drawn by the seed
    drawn_order = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(seed), "source_key", "block"), "block")
    permuted = (sources.where("quota > 0").select("source_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)).alias("block"))
                .withColumn("slot", (F.row_number().over(drawn_order) - 1).cast("bigint")))  # MOST_BLOCKS rows and one per source
    blocks = permuted.join(slots, ["source_key", "slot"]).drop("slot")
    shuffled = drawn.join(blocks, ["source_key", "block"], "left")
    rank = F.when(F.col("shard").isNotNull(), F.md5(F.concat_ws("|", F.lit(str(seed)), "shard", name, "copy").cast("binary")))
    return shuffled.withColumn("rank", rank).select(
        "doc_id", "source", "size", "fingerprint", "n_alike", "source_key", "row_no", "copy", "shard", "block", "rank",
        "source_size", "target")


def taken(mixed: DataFrame) -> DataFrame:
    """One row per document of `mix`: doc_id, size, source_size, target, taken."""
    words = F.sum(F.when(F.col("shard").isNotNull(), F.col("size")).otherwise(F.lit(0)))
    per_document = (mixed.groupBy("source_key", "row_no")
                    .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "n_alike")],
                         words.cast("bigint").alias("taken")))
    return (per_document.withColumn("alike", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_alike"))))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The rows of `documents`, each as often as the mix draws it, dealt by
    shard and locally shuffled inside each."""
    mixed = mix(documents, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    drawn = (mixed.where("shard IS NOT NULL")
             .select(F.col("doc_id").alias("_i"), F.col("fingerprint").alias("_f"), F.col("source").alias("_s"),
                     F.col("shard").alias("_shard"), F.col("rank").alias("_rank")))
    names = documents.columns
    at = {c: i for i, c in reversed(list(enumerate(names)))}
    numbered = documents.toDF(*[f"c{i}" for i in range(len(names))])
    doc, text, source = (F.col(f"c{at[c]}") for c in (id_col, text_col, source_col))
    joined = numbered.join(drawn, F.xxhash64(text).eqNullSafe(F.col("_f")) & doc.eqNullSafe(F.col("_i"))
                           & source.eqNullSafe(F.col("_s")))
    dealt = joined.repartition("_shard").sortWithinPartitions("_shard", "_rank")
    return dealt.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
