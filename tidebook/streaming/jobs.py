"""Structured Streaming jobs on logs, prices and batches: appends, folds, rollups and freshness with restartable state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.sources.shared import children, removed, tasks_for
from tidebook.sources.tables import append, newest_wins, read_or_empty


def confirmed(events: DataFrame, heads: DataFrame, confirmations: int) -> DataFrame:
    """M1: rows at or below the head less the confirmations."""
    head = heads.agg((F.max("block") - confirmations).alias("safe"))
    return events.join(F.broadcast(head)).filter("block <= safe").drop("safe")


def frontier(required: DataFrame, cursors: DataFrame) -> DataFrame:
    """M2: how far an engine may go: the least cursor of its streams, none if one of them has no cursor."""
    rows = required.join(cursors, "stream", "left")
    return rows.groupBy("engine").agg(F.when(F.count_if(F.col("block").isNull()) == 0, F.min("block")).alias("frontier"))


def verified_ancestor(logs: DataFrame, headers: DataFrame) -> DataFrame:
    """M3: the highest block whose stored hash is the canonical one."""
    rows = logs.select("block", "hash").distinct().join(headers, "block").filter(F.col("hash") == F.col("header_hash"))
    return rows.agg(F.max("block").alias("ancestor"))


def append_stream(events: DataFrame, path: str, key: list[str], checkpoint: str, gate: Callable[[], bool] = lambda: True) -> StreamingQuery:
    """A2, M4: appends each micro-batch once, however often it is replayed; refuses while the gate is closed."""

    def write(batch: DataFrame, _: int) -> None:
        if not gate():
            raise RuntimeError("a rewind is not acknowledged")
        append(batch, path, key)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unacknowledged(epochs: DataFrame, acks: DataFrame) -> DataFrame:
    """M4: the lowest target per engine of the rewinds (engine, epoch, target) beyond its acknowledged epoch (engine, acked)."""
    open_ = epochs.join(acks, "engine", "left").filter(F.col("epoch") > F.coalesce("acked", F.lit(-1)))
    return open_.groupBy("engine").agg(F.min("target").alias("target"))


def retracted(events: DataFrame, epochs: DataFrame, acks: DataFrame) -> DataFrame:
    """M4: the rows that stand; those above the target of an unacknowledged rewind of their engine are out.  Targets, one row
    per engine, go to the events, as one engine has nearly all of these."""
    return events.join(F.broadcast(unacknowledged(epochs, acks)), "engine", "left").filter("target is null or block <= target").drop("target")


def rewind_gate(spark: SparkSession, control: str) -> Callable[[], bool]:
    """M4: a gate for append_stream that reads the tables `epochs` and `acks` under a folder at each micro-batch: it is closed
    while a rewind is not acknowledged."""

    def is_open() -> bool:
        epochs = read_or_empty(spark, f"{control}/epochs", "engine string, epoch long, target long")
        acks = read_or_empty(spark, f"{control}/acks", "engine string, acked long").groupBy("engine").agg(F.max("acked").alias("acked"))
        return unacknowledged(epochs, acks).isEmpty()

    return is_open


_MANIFEST = "bucket int, folder long, checkpoint string, batch long"


def upsert_stream(rows: DataFrame, path: str, key: list[str], version: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the newest row of each key.

    Keys fall into buckets; a micro-batch rewrites the buckets that it touches, each by several tasks if it is large, over
    tasks whose number grows with the rows, and then writes a manifest of where each bucket lies, so readers (see upserted) find whole states only, and a repeated micro-batch writes the same folders.
    Folders that the last two states don't need are removed then.
    The manifest names the stream's checkpoint: a stream with another one is refused, as its numbers begin anew.
    """

    usual = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession  # of the stream alone, so its number of shuffle partitions can follow each micro-batch
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        log = read_or_empty(spark, f"{path}/manifest", _MANIFEST)
        if not log.filter(F.col("checkpoint") != checkpoint).isEmpty():
            raise ValueError(f"{path} belongs to a stream with another checkpoint")
        base = {r.bucket: r.folder for r in log.filter(F.col("batch") == number - 1).collect()}
        if not base and not log.filter(F.col("batch") < number).isEmpty():
            raise ValueError(f"the state before batch {number} is not there")
        placed = batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        sizes = {r[0]: r[1] for r in placed.groupBy("_bucket").count().collect()}
        touched = list(sizes)
        known = [f"{path}/data/batch={base[b]}/_bucket={b}" for b in touched if b in base]
        before = spark.read.schema(batch.schema).parquet(*known) if known else spark.createDataFrame([], batch.schema)
        tasks = tasks_for(spark, sum(sizes.values()) + before.count())
        ways = -(-tasks // max(1, len(touched)))
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        merged = newest_wins(before, batch, key, version).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        merged.repartition(tasks, F.col("_bucket"), F.pmod(F.hash(*key), F.lit(ways))).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/batch={number}")
        base |= dict.fromkeys(touched, number)
        rows = [(b, f, checkpoint) for b, f in sorted(base.items())] or [(-1, number, checkpoint)]
        spark.createDataFrame(rows, "bucket int, folder long, checkpoint string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
        _swept(spark, path, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _swept(spark: SparkSession, path: str, number: int) -> None:
    """Removes what neither the state of this micro-batch nor that before it needs; readers of older states are behind."""
    log = read_or_empty(spark, f"{path}/manifest", _MANIFEST)
    needed = {(r.folder, r.bucket) for r in log.filter(F.col("batch").between(number - 1, number)).collect()}
    for batch in children(spark, f"{path}/data"):
        buckets = [b for b in children(spark, f"{path}/data/{batch}") if b.startswith("_bucket=")]
        old = [b for b in buckets if (int(batch.split("=")[1]), int(b.split("=")[1])) not in needed]
        for b in old if len(old) < len(buckets) else [""]:
            removed(spark, f"{path}/data/{batch}/{b}".rstrip("/"))
    for batch in children(spark, f"{path}/manifest"):
        if batch.startswith("batch=") and int(batch.split("=")[1]) < number - 1:
            removed(spark, f"{path}/manifest/{batch}")


def upserted(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that upsert_stream keeps, as of its last complete micro-batch."""
    log = read_or_empty(spark, f"{path}/manifest", _MANIFEST)
    last = log.agg(F.max("batch")).first()[0]
    places = [f"{path}/data/batch={r.folder}/_bucket={r.bucket}" for r in log.filter((F.col("batch") == last) & (F.col("bucket") >= 0)).collect()] if last is not None else []
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def running_balances(events: DataFrame) -> DataFrame:
    """M5: balances per account and asset as a streaming aggregation."""
    return events.filter("delta is not null").groupBy("account", "asset").agg(F.sum("delta").alias("amount"), F.max("block").alias("block"))


def write_off_fold(events: DataFrame) -> DataFrame:
    """Per account and asset, what each row moves and the balance after it; a record row takes what the balance is.

    A record sets the balance to 0, so a balance is the running sum of deltas less what that sum was at the last record:
    windows of one order, hence one exchange and one sort.  streaming.ordered has the same fold on a stream.
    """
    return folded_rows(events.withColumn("_before", F.lit(0)), "_before").drop("seq")


def folded_rows(events: DataFrame, before: str) -> DataFrame:
    """write_off_fold() of events that carry the balance before the first of their account and asset (null: 0), with seq."""
    w = Window.partitionBy("account", "asset").orderBy("block", "log_index", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    record, start = F.col("event_type") == "record", F.coalesce(before, F.lit(0)).cast("long")
    rows = events.withColumn("_sum", F.sum(F.when(record, 0).otherwise(F.col("delta"))).over(upto))
    rows = rows.withColumn("balance", F.col("_sum") - F.coalesce(F.last(F.when(record, F.col("_sum")), ignorenulls=True).over(upto), -start))
    moved = F.when(record, -F.coalesce(F.lag("balance").over(w), start)).otherwise(F.col("delta"))
    return rows.select("account", "asset", "block", "log_index", "seq", moved.alias("moved"), "balance")


def neutralized(prices: DataFrame, anchors: DataFrame, boundary: int) -> DataFrame:
    """M6: rows above a boundary are invalid; those whose block is an anchor are anchored, others dangling."""
    known = anchors.select("block").distinct().withColumn("_a", F.lit(True))
    rows = prices.join(known, "block", "left")
    above = F.col("block") > boundary
    return rows.select("asset", "source", "block", "log_index", "price", (F.col("valid") & ~above).alias("valid"), F.when(above, F.when(F.col("_a"), "anchored").otherwise("dangling")).otherwise("kept").alias("class"))


def prices_rewound(prices: DataFrame, owned: list[str], target: int) -> DataFrame:
    """M7: rows of the owned sources above a target are gone."""
    return prices.filter(~(F.col("source").isin(owned) & (F.col("block") > target)))


def stale_feeds(prices: DataFrame, registry: DataFrame, now: int) -> DataFrame:
    """M8: feeds whose last usable row is older than heartbeat and grace; unseen ones count from when they went live."""
    last = prices.filter("valid").groupBy("source").agg(F.max("as_of").alias("last"))
    rows = registry.join(last, "source", "left").withColumn("age", F.lit(now) - F.coalesce("last", "live_from"))
    return rows.select("source", "age", (F.col("age") > F.col("heartbeat") + F.col("grace")).alias("stale"))


def newest_states(prices: DataFrame) -> DataFrame:
    """M9: newest usable and newest invalid time per feed; also as an update-mode stream."""
    return prices.groupBy("source").agg(F.max(F.when(F.col("valid"), F.col("as_of"))).alias("usable"), F.max(F.when(~F.col("valid"), F.col("as_of"))).alias("invalid"))


def hourly(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Tumbling hours of a time column ts: rows, sum and newest value; with a watermark as an append-mode stream."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.max_by("cents", "event_id").alias("newest")).select(F.col("w.start").alias("hour"), "event_type", "n", "total", "newest")


def count_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose counts differ; a key that is missing counts 0."""
    both = before.select(*key, F.col("n").alias("was")).join(after.select(*key, F.col("n").alias("now")), key, "full").fillna(0, ["was", "now"])
    return both.filter("was <> now")


def missing_headers(events: DataFrame, headers: DataFrame) -> DataFrame:
    """Blocks of events that have no header."""
    return events.select("block").distinct().join(headers.select("block").distinct(), "block", "left_anti")
