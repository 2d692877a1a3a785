"""Completeness, coverage and gates: what must hold before derived rows are believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_complete(batches: DataFrame, positions: DataFrame, stamps: DataFrame) -> DataFrame:
    """H1: declared counts are the actual ones, and every required engine is stamped."""
    counts = positions.groupBy("batch").agg(F.count("*").alias("actual"), F.sum("debt").alias("actual_debt"))
    seen = stamps.groupBy("batch").agg(F.collect_set("engine").alias("stamped"))
    rows = batches.join(counts, "batch", "left").join(seen, "batch", "left")
    missing = F.array_except("required", F.coalesce("stamped", F.array().cast("array<string>")))
    complete = (F.col("declared") == F.coalesce("actual", F.lit(0))) & (F.size(missing) == 0) & (F.col("declared_debt") == F.coalesce("actual_debt", F.lit(0)))
    return rows.select("batch", complete.alias("complete"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def timeline(params: DataFrame, events: DataFrame) -> DataFrame:
    """H2: two ledgers on one shape."""
    a = params.select("asset", "block", "log_index", F.lit("param").alias("kind"), "ltv", "threshold", "bonus")
    return a.unionByName(events.select("asset", "block", "log_index", F.lit("event").alias("kind"), "amount"), allowMissingColumns=True)


def candidates(*parts: DataFrame) -> DataFrame:
    """H3, H4: accounts that any of the parts names."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def source_conflicts(balances: DataFrame) -> DataFrame:
    """H5: accounts and sides whose balances come from several sources."""
    key = ["engine", "account", "side"]
    return balances.groupBy(*key).agg(F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1).select(*key, F.array_join("s", ",").alias("sources"))


def without_conflicts(balances: DataFrame) -> DataFrame:
    """H5: the balances of accounts and sides with one source."""
    return balances.join(source_conflicts(balances), ["engine", "account", "side"], "left_anti")


def epoch_gate(required: DataFrame, cursors: DataFrame, epochs: DataFrame) -> DataFrame:
    """H6: for every required engine ok, no_cursor, wrong_chain or unacknowledged."""
    newest = epochs.groupBy("chain").agg(F.max("epoch").alias("epoch"))
    rows = required.join(cursors.select("engine", F.col("chain").alias("own"), "acked"), "engine", "left").join(newest, "chain", "left")
    reason = F.when(F.col("own").isNull(), "no_cursor").when(F.col("own") != F.col("chain"), "wrong_chain").when(F.col("acked") < F.coalesce("epoch", F.lit(0)), "unacknowledged").otherwise("ok")
    return rows.select("engine", reason.alias("reason"))


def coverage_ok(covered_from: Column, genesis: Column, revision: Column, least: Column, binding: Column, wanted: Column) -> Column:
    """H7: the claim reaches back far enough, is new enough and bound alike; a requirement of 0 is no requirement met."""
    return F.coalesce((genesis > 0) & (least > 0) & (covered_from <= genesis) & (revision >= least) & binding.eqNullSafe(wanted), F.lit(False))


def merged_coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """H8: the earlier start if revision and binding agree, else the new claim alone."""
    both = new.join(old.select("engine", F.col("covered_from").alias("o_from"), F.col("revision").alias("o_rev"), F.col("binding").alias("o_bind")), "engine", "left")
    same = (F.col("o_rev") == F.col("revision")) & (F.col("o_bind") == F.col("binding"))
    return both.select("engine", F.when(same, F.least("covered_from", "o_from")).otherwise(F.col("covered_from")).alias("covered_from"), "revision", "binding")


def supersession_legs(stamps: DataFrame, cursors: DataFrame) -> DataFrame:
    """H9: why a batch is superseded: cursor absent, epoch moved, rewound."""
    rows = stamps.join(cursors.select("engine", F.col("acked").alias("now_acked"), F.col("block").alias("now_block")), "engine", "left")
    legs = F.array(
        F.when(F.col("now_acked").isNull(), F.lit("absent")), F.when(F.col("now_acked") != F.col("acked"), F.lit("epoch")), F.when(F.col("now_block") < F.col("block"), F.lit("rewound"))
    )
    return rows.select("batch", "engine", F.explode(F.filter(legs, lambda x: x.isNotNull())).alias("leg"))


def vector_changes(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Keys at which any field differs, with the first differing field."""
    a = old.select(*key, *(F.col(f).alias(f"o_{f}") for f in fields), F.lit(1).alias("_o"))
    b = new.select(*key, *(F.col(f).alias(f"n_{f}") for f in fields), F.lit(1).alias("_n"))
    both = a.join(b, key, "full")
    first = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
    for f in fields:
        first = first.when(~F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}")), f)
    return both.withColumn("change", first).filter("change is not null").select(*key, "change")


def moved_rewinds(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Engines whose epoch changed since the baseline, or whose pin is above the cursor now."""
    rows = baseline.join(current.select("engine", F.col("acked").alias("now"), "block"), "engine")
    return rows.filter((F.col("acked") != F.col("now")) | (F.col("pin") > F.col("block"))).select("engine", "pin", "block")


def unseen(subjects: DataFrame, *sources: DataFrame) -> DataFrame:
    """Subjects without a row in any source."""
    out = subjects
    for s in sources:
        out = out.join(s.select("account").distinct(), "account", "left_anti")
    return out


def unpruned_epochs(epochs: DataFrame, cursors: DataFrame) -> DataFrame:
    """Epochs that some engine of their chain has not acknowledged."""
    least = cursors.groupBy("chain").agg(F.min("acked").alias("least"))
    return epochs.join(least, "chain", "left").filter("least is null or epoch > least").drop("least")


def scale_violations(rows: DataFrame, scales: dict[str, int]) -> DataFrame:
    """Rows whose decimals are not their engine's."""
    scale = F.create_map(*(F.lit(x) for kv in scales.items() for x in kv))[F.col("engine")]
    return rows.filter(~F.col("value_decimals").eqNullSafe(scale))


def newest_label(batches: DataFrame) -> DataFrame:
    """Whether a batch is the newest complete one, superseded, or newer than it but incomplete."""
    top = batches.agg(F.max(F.when(F.col("complete"), F.col("batch"))).alias("top"))  # one row
    label = F.when(F.col("batch") == F.col("top"), "newest").when(F.col("batch") < F.col("top"), "superseded").otherwise("pending")
    return batches.join(F.broadcast(top)).select("batch", "complete", label.alias("label"))
