"""Folds of an event ledger into balances.

Events have engine, block, tx, log_index, seq, event_type, account, asset, side and a nullable delta.  Most folds
are sums and need no order; those that do keep their order in windows per account and asset, never per engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.exact import ceil_div, floor_div

KEY = ("engine", "account", "asset", "side")
ORDER = ("block", "log_index", "seq")


def balance_fold(events: DataFrame) -> DataFrame:
    """Sum of the deltas of rows with a side, and the newest block, per balance."""
    rows = events.filter(F.col("delta").isNotNull() & (F.col("side") != ""))
    return rows.groupBy(*KEY).agg(F.sum("delta").alias("amount"), F.max("block").alias("updated_block"))


def borrow_deltas(events: DataFrame, rates: DataFrame, unit: int = 1_000_000) -> DataFrame:
    """An amount is turned into index units of its block: borrows are rounded up, repayments down and negative.

    An event without a rate of its asset in its block is not dropped: it has a null delta and `missing_rate`.
    """
    rate = rates.groupBy("asset", "block").agg(F.max("value").alias("index"))
    joined = events.filter(F.col("event_type").isin("borrow", "repay")).join(rate, ["asset", "block"], "left")
    scaled = F.col("amount") * F.lit(unit)
    delta = F.when(F.col("event_type") == "borrow", ceil_div(scaled, F.col("index"))).otherwise(-floor_div(scaled, F.col("index")))
    return joined.select("tx", "log_index", "seq", "account", "asset", "block", "event_type", "amount", delta.alias("units"), F.col("index").isNull().alias("missing_rate"))


def overdrawn(events: DataFrame) -> DataFrame:
    """Events after which the running balance of their account and asset is negative."""
    run = Window.partitionBy(*KEY).orderBy(*ORDER, "tx").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.filter(F.col("delta").isNotNull() & (F.col("side") != "")).withColumn("balance", F.sum("delta").over(run))
    return rows.filter("delta < 0 and balance < 0").select(*KEY, *ORDER, "tx", "delta", "balance")


def regime_deltas(events: DataFrame, rates: DataFrame, cut: tuple[int, int], ray: int = 1_000_000) -> DataFrame:
    """C4: before the cut (block, log_index) both directions round half up; from it on borrows up and repayments down."""
    rate = rates.groupBy("asset", "block").agg(F.max("value").alias("index"))
    joined = events.filter(F.col("event_type").isin("borrow", "repay")).join(rate, ["asset", "block"])
    scaled, index = F.col("amount") * F.lit(ray), F.col("index")
    old = F.struct("block", "log_index") < F.struct(F.lit(cut[0]).cast("long"), F.lit(cut[1]).cast("long"))
    half_up = floor_div(scaled + floor_div(index, F.lit(2)), index)
    borrow = F.col("event_type") == "borrow"
    size = F.when(old, half_up).when(borrow, ceil_div(scaled, index)).otherwise(floor_div(scaled, index))
    return joined.select("tx", "log_index", "seq", "account", "asset", "block", "event_type", F.when(borrow, size).otherwise(-size).alias("units"), old.alias("old_regime"))


def writeoff_before(events: DataFrame) -> DataFrame:
    """Repayments whose transaction and account had a record row (a write-off) earlier count as nothing."""
    before = Window.partitionBy("tx", "account").orderBy("log_index", "seq").rowsBetween(Window.unboundedPreceding, -1)
    flag = F.coalesce(F.max((F.col("event_type") == "record").cast("int")).over(before), F.lit(0)) == 1
    rows = events.withColumn("written_off", flag).filter("event_type = 'repay'")
    return rows.select("tx", "log_index", "seq", "account", "asset", F.when(F.col("written_off"), 0).otherwise(F.col("delta")).alias("delta"), "written_off")


def share_fold(events: DataFrame, cut: int, unit: int = 1_000_000) -> DataFrame:
    """Scaled shares per account and asset from nominal mints (amount > 0) and burns (amount < 0) with an index.

    A holder's nominal balance is floor(shares * index / unit); after an event the shares are recovered from the new nominal
    balance, half up before the cut block and rounded up from it on.  What comes next depends on what was recovered,
    so rows stream in order through sorted partitions.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shares = None, 0
        for batch in batches:
            out, moved = [], []
            for account, asset, block, amount, index in zip(*(batch.column(c).to_pylist() for c in ("account", "asset", "block", "amount", "index")), strict=True):
                if (account, asset) != own:
                    own, shares = (account, asset), 0
                nominal = max(0, shares * index // unit + amount)
                after = (nominal * unit + index // 2) // index if block < cut else -(-nominal * unit // index)
                moved.append(after - shares)
                shares = after
                out.append(shares)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("account", "asset", "block", "log_index", "amount")] + [pa.array(moved, pa.int64()), pa.array(out, pa.int64())], ["account", "asset", "block", "log_index", "amount", "moved", "shares"])

    ordered = events.repartition("account", "asset").sortWithinPartitions("account", "asset", "block", "log_index", "seq", "amount")
    return ordered.select("account", "asset", "block", "log_index", "amount", "index").mapInArrow(fold, "account long, asset long, block long, log_index long, amount long, moved long, shares long")


def transfer_fan_out(events: DataFrame, recipient: Column) -> DataFrame:
    """A transfer is two rows: seq 0 takes from the sender, seq 1 gives to the recipient."""
    legs = F.array(F.struct(F.lit(0).alias("part"), F.col("account").alias("party"), (-F.col("amount")).alias("moved")), F.struct(F.lit(1).alias("part"), recipient.alias("party"), F.col("amount").alias("moved")))
    return events.select("tx", "log_index", "seq", "asset", F.explode(legs).alias("leg")).select("tx", "log_index", "seq", "asset", "leg.*")


def preceding_index(actions: DataFrame, updates: DataFrame) -> DataFrame:
    """Each action takes the last update of the same transaction and asset with a smaller log index; none: null."""
    a = actions.select("tx", "asset", "log_index", "seq", "account", F.lit(None).cast("long").alias("index"), F.lit(1).alias("is_action"))
    u = updates.select("tx", "asset", "log_index", "seq", F.lit(None).cast("long").alias("account"), "index", F.lit(0).alias("is_action"))
    before = Window.partitionBy("tx", "asset").orderBy("log_index", "is_action", "seq").rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(u).withColumn("taken", F.last("index", ignorenulls=True).over(before))
    return both.filter("is_action = 1").select("tx", "asset", "log_index", "seq", "account", F.col("taken").alias("index"))


def liquidation_fan_out(liquidations: DataFrame) -> DataFrame:
    """One debt row (part 0) and a row per seized asset (parts 1..n) from (tx, account, debt, seized: array)."""
    rows = liquidations.select("tx", "account", F.concat(F.array(F.struct(F.lit(None).cast("long").alias("asset"), (-F.col("debt")).alias("moved"))), F.transform("seized", lambda s: F.struct(s["asset"].alias("asset"), (-s["amount"]).alias("moved")))).alias("legs"))
    return rows.select("tx", "account", F.posexplode("legs").alias("part", "leg")).select("tx", "account", "part", "leg.asset", "leg.moved")


def residue_rows(events: DataFrame, more_order: tuple[str, ...] = ()) -> DataFrame:
    """The second repayment of an account and asset in a transaction that leaves exactly 1 gets a row of -1."""
    key = ["tx", "account", "asset", "side"]
    place = Window.partitionBy(*key).orderBy("log_index", "seq", *more_order)
    rows = events.filter(F.col("delta").isNotNull()).withColumn("place", F.row_number().over(place)).withColumn("left", F.sum("delta").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("place = 2 and left = 1").select(*key, "log_index", F.lit(-1).cast("long").alias("delta"))


def record_rows(events: DataFrame) -> DataFrame:
    """C11: rows that only record: no delta, no side, and what they say as a map."""
    payload = F.create_map(F.lit("amount"), F.col("amount").cast("string"), F.lit("asset"), F.col("asset").cast("string"))
    return events.filter("event_type = 'record'").select("tx", "log_index", "seq", "account", F.lit(None).cast("long").alias("delta"), F.lit("").alias("side"), payload.alias("payload"))


def genesis_rows(seeds: DataFrame) -> DataFrame:
    """(account, amounts: array) as positive rows; seq is the place in the array."""
    return seeds.select("account", F.posexplode("amounts").alias("seq", "delta")).withColumn("seq", F.col("seq").cast("long"))


def touched_documents(events: DataFrame, balances: DataFrame, low: int, high: int, side: str = "debt") -> DataFrame:
    """One document of balances for each account touched in the blocks low..high."""
    touched = events.filter(F.col("block").between(low, high) & F.col("delta").isNotNull()).select("account").distinct()
    rows = balances.filter(F.col("side") == side).join(touched, "account", "left_semi")
    return balance_documents(rows)


def balance_documents(balances: DataFrame) -> DataFrame:
    """Per account an `asset:amount` document in order of assets, and how many entries it has."""
    sums = balances.groupBy("account", "asset").agg(F.sum("amount").alias("amount"))
    entries = F.array_sort(F.collect_list(F.struct("asset", "amount")))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["asset"], e["amount"])), ",")
    return sums.groupBy("account").agg(text.alias("document"), F.count("*").alias("entries"))


def rewound(events: DataFrame, target: int) -> DataFrame:
    """C14: balances as if nothing above the target block had come; accounts without debt rows left are dropped."""
    kept = events.filter(F.col("block") <= target)
    alive = kept.filter("side = 'debt' and delta is not null").select("engine", "account").distinct()
    return balance_fold(kept).join(alive, ["engine", "account"], "left_semi")


def rewind_target(cursors: DataFrame, epochs: DataFrame, requested: int) -> DataFrame:
    """Per engine the lower of the request and the deepest epoch that it has not acknowledged."""
    deep = cursors.join(epochs, (epochs.chain == cursors.chain) & (epochs.epoch > cursors.acked), "left").groupBy("engine").agg(F.min("rewound_to").alias("deepest"))
    return deep.select("engine", F.least(F.lit(requested).cast("long"), F.coalesce("deepest", F.lit(requested).cast("long"))).alias("target"))
