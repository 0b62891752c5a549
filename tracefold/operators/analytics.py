"""Evaluation statistics: small-sample tests, percentiles, sums that need every part, pairs, funnels, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_tail(x: Column, row: Column, col: Column, n: Column) -> Column:
    """P of a hypergeometric count (col of n are marked, row are drawn) of at least x.

    Weights relative to the likeliest count follow from one another, so the sum over all of them scales them and no factorial occurs. By Hoeffding's bound
    all counts farther from it than REACH times the root of the smallest margin have a probability below the smallest double together: they are zero
    in any case, and the steps grow with the root of n.
    """
    row, col, n = (c.cast("double") for c in (row, col, n))
    rest = n - row - col
    low, high = F.greatest(-rest, F.lit(0.0)), F.least(row, col)
    mode = F.least(F.greatest(F.floor((row + 1) * (col + 1) / (n + 2)).cast("double"), low), high)
    reach = F.ceil(REACH * F.sqrt(F.least(row, col, n - row, n - col))) + 2

    def steps(last: Column, ratio) -> Column:
        some = F.when(last != mode, F.slice(F.sequence(mode.cast("long"), last.cast("long")), 2, 1 << 30)).otherwise(F.array().cast("array<bigint>"))

        def add(acc: Column, at: Column) -> Column:
            w = acc["w"] * ratio(at.cast("double"))
            return F.struct(w.alias("w"), (acc["all"] + w).alias("all"), (acc["tail"] + F.when(at >= x, w).otherwise(0.0)).alias("tail"))

        zero = F.lit(0.0)
        return F.aggregate(some, F.struct(F.lit(1.0).alias("w"), zero.alias("all"), zero.alias("tail")), add)

    up = steps(F.least(high, mode + reach), lambda k: (row - k + 1) * (col - k + 1) / (k * (rest + k)))
    down = steps(F.greatest(low, mode - reach), lambda k: (k + 1) * (rest + k + 1) / ((row - k) * (col - k)))
    return (up["tail"] + down["tail"] + F.when(mode >= x, 1.0).otherwise(0.0)) / (up["all"] + down["all"] + 1)


#: 2 * REACH ** 2 is 750, and exp(-750) is no double.
REACH = 375**0.5


def fisher_one_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P of a table at least as extreme as [[a, b], [c, d]] towards large a, margins fixed."""
    return F.least(upper_tail(a, a + b, a + c, a + b + c + d), F.lit(1.0))


def best_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The smallest p that the margins allow: could any outcome have been significant?"""
    return upper_tail(F.least(a + b, a + c), a + b, a + c, a + b + c + d)


def nearest_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float], half_even: bool = True) -> DataFrame:
    """Per keys the values at index round(p / 100 * (n - 1)) in ascending order, nulls apart. Equal values are counted before they are sorted, and no group is gathered."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wide = counted.withColumn("__upto", F.sum("__c").over(order)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    turn = F.bround if half_even else F.round
    at = {name: turn((F.col("__n") - 1) * F.lit(p / 100)) for name, p in ranks.items()}
    return wide.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") > i, F.col(value))).alias(name) for name, i in at.items()])


def paired_latency(starts: DataFrame, responses: DataFrame, key: str, at: str) -> DataFrame:
    """Responses with the time since the first start of the same key; null where no start is known."""
    first = starts.groupBy(key).agg(F.min(at).alias("started_at"))
    return responses.join(first, key, "left").withColumn("latency", F.col(at) - F.col("started_at"))


def summary(df: DataFrame, keys: list[str], values: list[str], cost: Column | None = None) -> DataFrame:
    """Per keys the mean of what is known of each value, how many rows know it, and the cost if every row has one."""
    parts = [x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.count(v).alias(f"n_{v}"))]
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), *parts, *([all_or_nothing_sum(cost).alias("cost")] if cost is not None else []))


def validity(gates: dict[str, Column]) -> dict[str, Column]:
    """Whether a run counts, and the names of the gates that it fails, in order; a gate that is unknown is failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))
    return {"valid": F.size(failed) == 0, "failed_gates": F.array_join(failed, ",")}


def excluded(df: DataFrame, keys: list[str], gates: dict[str, Column], measures: dict[str, list[str]]) -> DataFrame:
    """(keys, excluded, runs_excluded): the measures that some run's failed gates make unfit, sorted, and how many runs fail a gate. measures: gate to what it spoils."""
    failed = [(g, F.coalesce(~c, F.lit(True))) for g, c in gates.items()]
    spoiled = F.flatten(F.array(*[F.when(bad, F.array(*[F.lit(m) for m in measures[g]])).otherwise(F.array().cast("array<string>")) for g, bad in failed]))
    any_bad = F.coalesce(F.array_max(F.array(*[bad for _, bad in failed])), F.lit(False))
    one = df.select(*keys, F.array_distinct(spoiled).alias("m"), any_bad.alias("bad"))
    counts = one.groupBy(*keys).agg(F.count_if("bad").alias("runs_excluded"))
    sets = one.select(*keys, F.explode("m").alias("m")).groupBy(*keys).agg(F.array_sort(F.collect_set("m")).alias("excluded"))  # as many as there are measures
    return counts.join(sets, keys, "left").select(*keys, F.coalesce("excluded", F.array().cast("array<string>")).alias("excluded"), "runs_excluded")


def median(value: str | Column) -> Column:
    return F.percentile(value, 0.5)


def all_or_nothing_sum(value: str | Column) -> Column:
    """The sum if every row carries the value, else null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def difference(treatment: Column, baseline: Column) -> Column:
    """Null where either side is missing."""
    return treatment - baseline


def percent_change(treatment: Column, baseline: Column) -> Column:
    """Null where a side is missing or the baseline is zero."""
    return F.when(baseline != 0, (treatment - baseline) / baseline * 100)


#: Measurement statuses from strongest to weakest.
STATUSES = ("MEASURED", "DERIVED", "ESTIMATED", "INCONCLUSIVE", "UNAVAILABLE")


def weakest_status(*statuses: Column) -> Column:
    place = lambda s: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in STATUSES]), s), F.lit(len(STATUSES)))
    worst = F.greatest(*[place(s) for s in statuses]) if len(statuses) > 1 else place(statuses[0])
    return F.element_at(F.array(*[F.lit(x) for x in STATUSES]), worst.cast("int"))


def best_class(df: DataFrame, keys: list[str], cls: str, priority: list[str]) -> DataFrame:
    """The rows of the one class per keys that comes first in priority; classes never add up."""
    place = F.array_position(F.array(*[F.lit(x) for x in priority]), F.col(cls))
    known = df.withColumn("__p", place).where("__p > 0")
    best = F.rank().over(Window.partitionBy(*keys).orderBy("__p"))
    return known.withColumn("__r", best).where("__r = 1").drop("__p", "__r")


def matched_pairs(baseline: DataFrame, treatment: DataFrame, key: str, same: list[str], value: str) -> DataFrame:
    """Full outer pairs on key; the reasons why a pair is dropped, and the difference of those that stand."""
    b, t = baseline.alias("b"), treatment.alias("t")
    both = b.join(t, F.col(f"b.{key}") == F.col(f"t.{key}"), "full_outer")
    reasons = F.array_compact(F.array(
        F.when(F.col(f"b.{key}").isNull(), F.lit("no baseline")), F.when(F.col(f"t.{key}").isNull(), F.lit("no treatment")),
        *[F.when(F.col(f"b.{key}").isNotNull() & F.col(f"t.{key}").isNotNull() & ~F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(f"{c} differs")) for c in same],
    ))
    out = both.select(F.coalesce(f"b.{key}", f"t.{key}").alias(key), F.col(f"b.{value}").alias("baseline"), F.col(f"t.{value}").alias("treatment"), reasons.alias("dropped"))
    return out.withColumn("delta", F.when(F.size("dropped") == 0, F.col("treatment") - F.col("baseline")))


def first_failed_stage(df: DataFrame, keys: list[str], ordinal: str = "ordinal", stage: str = "stage", ok: str = "ok") -> DataFrame:
    """Per keys the first stage that failed (null: none), and how many passed before it."""
    bad = F.when(~F.col(ok), F.col(ordinal))
    return df.groupBy(*keys).agg(F.min_by(stage, bad).alias("failed_stage"), F.coalesce(F.min(bad), F.max(ordinal) + 1).alias("reached"))


def coverage(found: Column, wanted: Column) -> dict[str, Column]:
    """Which of the wanted markers were found: lists, ratio, all."""
    hit, miss = F.array_intersect(wanted, found), F.array_except(wanted, found)
    return {"hits": hit, "missing": miss, "ratio": F.try_divide(F.size(hit).cast("double"), F.size(F.array_distinct(wanted)).cast("double")), "all_found": F.size(miss) == 0}


def precision_recall(listed: Column, relevant: Column) -> dict[str, Column]:
    """Paths match if one ends with the other at a component; null where the denominator is empty."""
    same = lambda a, b: (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))
    good = F.filter(listed, lambda x: F.exists(relevant, lambda r: same(x, r)))
    met = F.filter(relevant, lambda r: F.exists(listed, lambda x: same(x, r)))
    share = lambda a, b: F.try_divide(F.size(a).cast("double"), F.size(b).cast("double"))
    return {"precision": share(good, listed), "recall": share(met, relevant)}


def three_valued_and(check: str) -> Column:
    """An aggregate: true if a check is declared and all declared ones hold; null if none is declared."""
    return F.when(F.count(check) > 0, F.bool_and(check))


def verdict(usable: Column, valid_b: Column, valid_t: Column, correct_b: Column, correct_t: Column, value_b: Column, value_t: Column, threshold: float) -> Column:
    """The first rule that applies, in a fixed order."""
    change = percent_change(value_t, value_b)
    return (
        F.when(~usable, "UNUSABLE").when(~valid_b, "BASELINE_INVALID").when(~valid_t, "TREATMENT_INVALID")
        .when(correct_b.isNull() | correct_t.isNull(), "CORRECTNESS_UNKNOWN").when(correct_b & ~correct_t, "WORSE").when(~correct_b & correct_t, "BETTER")
        .when(~correct_b & ~correct_t, "BOTH_WRONG").when(change.isNull(), "NO_TELEMETRY").when(change <= -threshold, "BETTER").when(change >= threshold, "WORSE").otherwise("TIE")
    )


def pooled_verdicts(pairs: DataFrame, keys: list[str], verdicts: list[str]) -> DataFrame:
    """Per keys how often each verdict fell, how many pairs compare (no reason against them), and the median change of those alone."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in verdicts]
    fair = F.when(F.col("comparable"), F.col("change"))
    return pairs.groupBy(*keys).agg(*counts, F.count_if(F.col("comparable")).alias("comparable_pairs"), median(fair).alias("median_change"))


def first_loss(layers: DataFrame, keys: list[str]) -> DataFrame:
    """layers (keys, ordinal, layer, present: true, false or null for not applicable): where a present fact first goes missing."""
    order = Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("present", ignorenulls=True).over(order)
    lost = F.when(F.col("present").isNotNull() & ~F.col("present") & F.coalesce(before, F.lit(False)), F.col("ordinal"))
    marked = layers.withColumn("__l", lost)
    return marked.groupBy(*keys).agg(F.min_by("layer", F.when(F.col("__l").isNotNull(), F.col("__l"))).alias("lost_at"), F.max(F.coalesce("present", F.lit(False))).alias("ever_present"))


def first_match(actions: DataFrame, keys: list[str], match: Column, forbidden: Column) -> DataFrame:
    """(keys, found, steps, position, tool, target, forbidden_first) of actions (keys, index, tool, target): the first that matches, and how many come before it.

    forbidden_first: an action that must not come first did. One window, in which nothing counts any more once an action has matched.
    """
    order = Window.partitionBy(*keys).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    hit, bad = F.coalesce(match, F.lit(False)), F.coalesce(forbidden, F.lit(False))
    over = F.coalesce(F.max(hit).over(order), F.lit(False))
    marked = actions.withColumns({"__hit": hit, "__bad": bad}).withColumn("__over", over)
    first = F.when(F.col("__hit") & ~F.col("__over"), F.struct("index", "tool", "target"))
    out = marked.groupBy(*keys).agg(
        F.max(first).alias("__f"), F.count_if(~F.col("__over") & ~F.col("__hit")).alias("__n"), F.max(F.col("__bad") & ~F.col("__over") & ~F.col("__hit")).alias("forbidden_first"),
    )
    found = F.col("__f").isNotNull()
    return out.select(*keys, found.alias("found"), F.when(found, F.col("__n")).alias("steps"), F.col("__f.index").alias("position"), F.col("__f.tool").alias("tool"), F.col("__f.target").alias("target"), "forbidden_first")


def before_first_edit(actions: DataFrame, keys: list[str], edits: Column, reads: Column, own: Column) -> DataFrame:
    """(keys, reads, rereads, own_rereads, first_edit): reads before the first edit, those of a target read before, those of them of own files, and what is edited first."""
    order = Window.partitionBy(*keys).orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(edits).over(order), F.lit(False))
    again = F.coalesce(F.max(reads).over(Window.partitionBy(*keys, "target").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    marked = actions.withColumns({"__e": edits, "__r": reads, "__own": own, "__again": again}).withColumn("__over", over)
    read = F.col("__r") & ~F.col("__over") & ~F.col("__e")
    return marked.groupBy(*keys).agg(
        F.count_if(read).alias("reads"), F.count_if(read & F.col("__again")).alias("rereads"), F.count_if(read & F.col("__again") & F.col("__own")).alias("own_rereads"),
        F.max(F.when(F.col("__e") & ~F.col("__over"), F.col("target"))).alias("first_edit"),
    )


def captured(facts: DataFrame, rows: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(session_id, fact, checkpoint_id, captured, rows): whether the ledger held a fact by the watermark of the session's last checkpoint.

    facts: session_id, fact; rows: session_id, fact, event_id; checkpoints: session_id, checkpoint_id, watermark. Without a checkpoint nothing is captured.
    """
    last = checkpoints.groupBy("session_id").agg(F.max(F.struct("checkpoint_id", "watermark")).alias("c")).select("session_id", "c.*")
    held = rows.join(last.select("session_id", "watermark"), "session_id").where("event_id <= watermark").groupBy("session_id", "fact").agg(F.count("*").alias("n"))
    full = facts.distinct().join(last, "session_id", "left").join(held, ["session_id", "fact"], "left")
    return full.select("session_id", "fact", "checkpoint_id", F.coalesce(F.col("n") > 0, F.lit(False)).alias("captured"), F.coalesce("n", F.lit(0).cast("long")).alias("rows"))
