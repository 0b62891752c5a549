"""Mixing sources to target weights by temperature.

Token shares p are raised to an exponent a and normalised: q = p**a / sum p**a. Small exponents flatten the mixture, which
raises its entropy and repeats small sources more. The exponent in [0, 1] is bisected (each step in ``CUTS`` points at once, one
sum over the table of sources) to the largest that reaches ``entropy`` (nats), or the smallest whose repetition stays within
``repeat``: the ratio of the most to the least repeated source.

The budget, if not given, is the least at which every source appears whole. A source's quota is q * budget tokens: whole epochs,
then part of one. Documents are dealt to ``BLOCKS`` blocks per source by hash; every epoch has its own permutation of the
blocks, and the last epoch takes blocks in that order until the quota is spent; of the block that does not fit whole it takes the
documents of smallest hash that still fit. ``mix_key`` in [0, 1) orders the mixture: sources interleave by their quotas.

Only DataFrame expressions: a hot source is dealt over its blocks, and what is joined to the documents is one row per source and
block.

Defined results: a null source is a source of its own; null and empty texts have 0 tokens and come with their block; sources without
a token come once; with one source q is 1; repeated rows repeat; an empty table gives an empty table; input columns named ``epoch`` or
``mix_key`` come out as ``in_epoch`` and ``in_mix_key``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, set_aside, table

BLOCKS, CUTS, ROUNDS = 512, 16, 5
#: Rows of the table of blocks that may be sent to every executor (some 80 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000


def n_words(text: Column) -> Column:
    """Words between ASCII white space."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def uniform(*values: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*values), F.lit(1 << 52)) / float(1 << 52)


def exponent(sources: DataFrame, entropy: float | None, repeat: float | None) -> float:
    """Bisects the exponent over sources (p > 0)."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        sums = [
            F.struct(
                F.sum(F.pow("p", F.lit(a))).alias("z"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias("l"),
                F.max(F.pow("p", F.lit(a - 1))).alias("most"), F.min(F.pow("p", F.lit(a - 1))).alias("least"),
            ).alias(f"x{i}")
            for i, a in enumerate(points)
        ]
        got = sources.agg(*sums).first()
        if entropy is not None:  # falls as the exponent grows: the largest that reaches it
            met = [math.log(x["z"]) - a * x["l"] / x["z"] >= entropy - 1e-12 for a, x in zip(points, got, strict=True)]
            if not met[0]:
                return low
            last = max(i for i, m in enumerate(met) if m)
            low, high = points[last], points[min(last + 1, CUTS)]
        else:  # falls as the exponent grows: the smallest within the limit
            met = [x["most"] / x["least"] <= repeat + 1e-12 for x in got]
            first = next((i for i, m in enumerate(met) if m), CUTS)
            low, high = points[max(first - 1, 0)], points[first]
    return low if entropy is not None else high


def plan(slim: DataFrame, entropy: float | None, repeat: float | None, budget: float | None) -> DataFrame:
    """(src, blk, whole, part, limit, t, quota): how often each block comes, and where. slim: src, blk, u, n."""
    blocks = materialise(slim.groupBy("src", "blk").agg(F.sum("n").alias("n")))
    sources = blocks.groupBy("src").agg(F.sum("n").alias("t"))
    total = sources.agg(F.sum("t")).first()[0] or 0
    shares = materialise(sources.withColumn("p", F.col("t") / F.lit(float(max(total, 1)))))
    some = shares.where("p > 0")
    a = exponent(some, entropy, repeat) if total else 1.0
    got = some.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.min(F.pow("p", F.lit(a - 1))).alias("least")).first()
    z = got["z"] or 1.0
    spend = budget if budget is not None else total * z / (got["least"] or 1.0)
    quota = F.when(F.col("p") > 0, F.pow("p", F.lit(a)) / z * spend).otherwise(0.0)
    shares = shares.withColumn("quota", quota)
    # a quota within a millionth of whole epochs is whole
    shares = shares.withColumn("rep", F.when(F.col("t") > 0, F.col("quota") / F.col("t")).otherwise(1.0)).withColumn("whole", F.floor(F.col("rep") + 1e-6).cast("int"))
    shares = shares.withColumn("rest", F.greatest(F.col("quota") - F.col("whole") * F.col("t"), F.lit(0.0)) * (F.col("rep") - F.col("whole") > 1e-6).cast("double"))
    wide = blocks.join(shares, "src").withColumn("order", F.xxhash64("src", "blk", "whole"))
    run = Window.partitionBy("src").orderBy("order", "blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = wide.withColumn("end", F.sum("n").over(run)).withColumn("at", F.col("end") - F.col("n"))
    wide = materialise(wide.withColumn("part", (F.col("end") <= F.col("rest")) & (F.col("rest") > 0)).withColumn("edge", (F.col("at") < F.col("rest")) & (F.col("end") > F.col("rest"))))
    # of the one block per source that does not fit whole: the hash below which documents still fit
    edge = wide.where("edge").select("src", "blk", (F.col("rest") - F.col("at")).alias("room"))
    inside = slim.join(F.broadcast(edge) if edge.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else edge, ["src", "blk"])
    upto = Window.partitionBy("src", "blk").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    limit = inside.withColumn("sum", F.sum("n").over(upto)).where("sum <= room").groupBy("src", "blk").agg(F.max("u").alias("limit"))
    wide = wide.join(limit, ["src", "blk"], "left")
    return materialise(wide.select("src", "blk", "whole", "part", "limit", "t", F.greatest("quota", F.col("whole") * F.col("t"), F.lit(1.0)).alias("quota")))


def mix(docs: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs as often as the mixture takes them, with epoch and mix_key; one of entropy and repeat is given."""
    if (entropy is None) == (repeat is None):
        raise ValueError("give either entropy or repeat")
    docs = set_aside(docs, "epoch", "mix_key")
    inner = docs.withColumns({
        "__src": F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")),
        "__u": uniform(F.col(id_col), F.lit(1)),
        "__n": n_words(F.col(text_col)),
    }).withColumn("__blk", F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(BLOCKS)).cast("int"))
    slim = materialise(inner.select(F.col("__src").alias("src"), F.col("__blk").alias("blk"), F.col("__u").alias("u"), F.col("__n").alias("n")))
    blocks = plan(slim, entropy, repeat, budget)
    small = blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    blocks = blocks.select(*[F.col(c).alias(f"__{c}_") for c in blocks.columns])
    wide = inner.join(F.broadcast(blocks) if small else blocks, (F.col("__src") == F.col("__src_")) & (F.col("__blk") == F.col("__blk_")))
    copies = F.col("__whole_") + (F.col("__part_") | F.coalesce(F.col("__u") <= F.col("__limit_"), F.lit(False))).cast("int")
    wide = wide.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    # every epoch has its own order of the blocks; the last one lasts as long as what is left of the quota
    lasts = F.least(F.col("__t_").cast("double"), F.greatest(F.col("__quota_") - F.col("epoch") * F.col("__t_"), F.lit(0.0)))
    turned = uniform(F.col("__src"), F.col("epoch"), F.col("__blk")) * (1 - 1 / BLOCKS) + F.col("__u") / BLOCKS
    key = (F.col("epoch") * F.col("__t_") + turned * lasts) / F.col("__quota_")
    mix_key = F.least(F.greatest(key, F.lit(0.0)), F.lit(1 - 2**-52))
    return wide.select(*docs.columns, "epoch", mix_key.alias("mix_key"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, repeat=2.0).select("doc_id", "source", "epoch", "mix_key")
