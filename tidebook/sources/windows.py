"""Ledger tables by chain and block bucket (A1, A2), and windows of several tables applied in one commit (A3)."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidebook.sources.shared import children, dealt
from tidebook.sources.tables import Divergence, _content, read_or_empty

#: Blocks of a bucket.
SPAN = 10_000
#: A batch of at most so many buckets names each of them to the scan; one of more names its range on each chain.
NAMED_BUCKETS = 1000
#: Up to so many addresses are broadcast to a scan.
BROADCAST_ADDRESSES = 1_000_000
LOG_KEY = ["chain", "block", "log_index"]


def _bucket(span: int) -> Column:
    return F.floor(F.col("block") / span).cast("long")


def _in_buckets(rows: DataFrame) -> Column:
    """A condition on chain and bucket that holds for the buckets of some rows; their table is pruned by it."""
    own = rows.select("chain", "bucket").distinct()
    few = own.limit(NAMED_BUCKETS + 1).collect()
    if len(few) <= NAMED_BUCKETS:
        chains = {c: sorted(r.bucket for r in few if r.chain == c) for c in {r.chain for r in few}}
        parts = [(F.col("chain") == c) & F.col("bucket").isin(b) for c, b in chains.items()]
    else:
        parts = [(F.col("chain") == r.chain) & F.col("bucket").between(r.low, r.high) for r in own.groupBy("chain").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).collect()]
    return functools.reduce(lambda a, b: a | b, parts, F.lit(False))


def append_log(batch: DataFrame, path: str, span: int = SPAN, tasks: int | None = None) -> int:
    """A2: appends the rows of a batch that the ledger at a path lacks; how many there were.

    A row's key is its place (chain, block, log_index).  Equal rows are one; a known key with other content is an error,
    and then nothing is written.  The ledger lies in folders by chain and bucket of blocks, and only the buckets of the
    batch are read, once, so a batch costs the same whatever the ledger holds.  Batch and known rows are exchanged once, by
    key, over so many tasks; what is new goes once more to the buckets, of which a large one is written by several tasks.
    """
    spark = batch.sparkSession
    rows = dealt(batch, tasks, *LOG_KEY).dropDuplicates().withColumn("bucket", _bucket(span))
    rows = rows.withColumn("_c", _content(batch.columns, LOG_KEY))
    try:
        there = spark.read.parquet(path).select(*batch.columns, "bucket")
        # repeats make no other buckets, so the columns of a place are enough
        known = there.where(_in_buckets(batch.select("chain", _bucket(span).alias("bucket")))).select(batch.columns)
        known = dealt(known, tasks, *LOG_KEY).select(*LOG_KEY, _content(batch.columns, LOG_KEY).alias("_k"))
        met = rows.join(known, LOG_KEY, "left").persist()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        met = rows.withColumn("_k", F.lit(None).cast("string")).persist()
    try:
        bad = met.groupBy(*LOG_KEY).agg(F.count_distinct("_c").alias("n"), F.max(F.coalesce(F.col("_k") != F.col("_c"), F.lit(False))).alias("other")).where("n > 1 or other")
        if not bad.isEmpty():
            raise Divergence(f"rows with a known key of {LOG_KEY} have another content")
        fresh = met.where("_k is null").drop("_c", "_k")
        n = fresh.count()
        if n:
            fresh.hint("rebalance", "chain", "bucket").write.mode("append").partitionBy("chain", "bucket").parquet(path)
        return n
    finally:
        met.unpersist()


def scan_log(spark: SparkSession, path: str, addresses: DataFrame, low: int, high: int, chain: str | None = None, span: int = SPAN, column: str = "address") -> DataFrame:
    """A1: the ledger's rows of some emitting addresses (a table of one column) in a range of blocks, ends included, of one
    chain or all, in order; folders outside the range are not read, and blocks are filtered in the files."""
    rows = spark.read.parquet(path).where(F.col("bucket").between(low // span, high // span) & F.col("block").between(low, high))
    rows = rows.where(F.col("chain") == chain) if chain is not None else rows
    own = addresses.select(F.col(addresses.columns[0]).alias(column)).distinct()
    few = own.limit(BROADCAST_ADDRESSES + 1).count() <= BROADCAST_ADDRESSES
    return rows.join(F.broadcast(own) if few else own, column, "left_semi").orderBy("chain", "block", "log_index").drop("bucket")


# ---- A3

COMMIT = "engine string, seq long, commit string, after long, through long, covered_from long, base boolean"
BALANCE_KEY = ["account", "asset", "side"]


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The commit records of a folder: what is not named here was never applied."""
    return read_or_empty(spark, f"{folder}/commits/*/*", spark.createDataFrame([], COMMIT).schema)


def _last(spark: SparkSession, folder: str, engine: str):
    return commits(spark, folder).where(F.col("engine") == engine).orderBy(F.desc("seq")).first()


def _table(spark: SparkSession, folder: str, name: str, of: DataFrame, schema) -> DataFrame:
    """Rows of the commits `of`; each lies in a folder of its own, so others are not read."""
    try:
        rows = spark.read.parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.join(F.broadcast(of.select("commit")), "commit", "left_semi").drop("commit")


def _write_commit(spark: SparkSession, folder: str, engine: str, row: tuple) -> None:
    """The record that makes a window visible: a new file under the next number, which a second writer can't write too."""
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("error").parquet(f"{folder}/commits/{engine}/{row[1]:012d}")


def _differ(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables of the same columns have other rows, or rows another number of times, in one pass over both."""
    both = one.withColumn("_n", F.lit(1)).unionByName(other.withColumn("_n", F.lit(-1)))
    return not both.groupBy(*one.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty()


def apply_window(folder: str, engine: str, events: DataFrame, rates: DataFrame, after: int, through: int, covered_from: int | None = None, compact: int = 16) -> bool:
    """A3: applies the typed events and rates of the blocks (after, through] of an engine; whether it was new.

    events: tx, log_index, seq, account, asset, side, block, delta; rates: asset, kind, block, value.  Written are events,
    rates and balances, each to a folder of the window, and last of all one record with cursor (through) and coverage (the
    least covered_from so far); readers go through the records, so a run that ends before the last leaves them where they
    were, and what it wrote is never read.  A window at or below the cursor is a replay: without change it is nothing, with
    one an error, as are windows that don't begin at the cursor and rows outside the window.  Balances are sums of the
    window's deltas; every compact-th record has those of all windows before it, so readers add up less than that many.
    """
    spark = events.sparkSession
    inside = (F.col("block") > after) & (F.col("block") <= through)
    if not events.where(~inside).isEmpty() or not rates.where(~inside).isEmpty():
        raise ValueError("a row is outside the window")
    last = _last(spark, folder, engine)
    if last and through <= last.through:
        of = commits(spark, folder).where((F.col("engine") == engine) & (F.col("through") > after) & (F.col("after") < through))
        for name, df in (("events", events), ("rates", rates)):
            known = _table(spark, folder, name, of, df.schema).where(inside).select(df.columns)
            if _differ(df, known):
                raise Divergence(f"{name} of a window that was applied have another content")
        return False
    if last and after != last.through:
        raise ValueError(f"the window begins after {after}, the cursor is at {last.through}")
    commit, seq = uuid.uuid4().hex, (last.seq if last else 0) + 1
    base = seq % compact == 0
    events.write.parquet(f"{folder}/events/commit={commit}")
    rates.write.parquet(f"{folder}/rates/commit={commit}")
    sums = events.where("delta is not null").groupBy(*BALANCE_KEY).agg(F.sum("delta").alias("amount"), F.max("block").alias("updated_block"))
    if base:
        sums = _merged(balances_of(spark, folder, engine, sums.schema).unionByName(sums))
    sums.write.parquet(f"{folder}/balances/commit={commit}")
    least = min((x for x in (covered_from, last.covered_from if last else None) if x is not None), default=None)
    _write_commit(spark, folder, engine, (engine, seq, commit, after, through, least, base))
    return True


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BALANCE_KEY).agg(F.sum("amount").alias("amount"), F.max("updated_block").alias("updated_block"))


def balances_of(spark: SparkSession, folder: str, engine: str, schema="account long, asset long, side string, amount long, updated_block long") -> DataFrame:
    """The balances of an engine as of its last commit: those of the last compacted one and of all after it."""
    own = commits(spark, folder).where(F.col("engine") == engine)
    since = own.where("base").agg(F.max("seq")).first()[0] or 0
    return _merged(_table(spark, folder, "balances", own.where(F.col("seq") >= since), schema))


def events_of(spark: SparkSession, folder: str, engine: str, schema) -> DataFrame:
    """The events of an engine's committed windows."""
    return _table(spark, folder, "events", commits(spark, folder).where(F.col("engine") == engine), schema)


def cursors(spark: SparkSession, folder: str) -> DataFrame:
    """Engine, number of windows, cursor and coverage."""
    return commits(spark, folder).groupBy("engine").agg(F.max("seq").alias("windows"), F.max("through").alias("through"), F.min("covered_from").alias("covered_from"))


def leftovers(spark: SparkSession, folder: str) -> list[str]:
    """Folders of windows that no record names: of runs that ended before theirs, or of one that is under way."""
    known = {r.commit for r in commits(spark, folder).select("commit").collect()}
    return [f"{folder}/{t}/{c}" for t in ("events", "rates", "balances") for c in children(spark, f"{folder}/{t}") if c.startswith("commit=") and c[7:] not in known]
