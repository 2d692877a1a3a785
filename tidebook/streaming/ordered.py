"""M5: the ordered fold of a ledger as a stream: rows may come out of order, what they give does not depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.sources.shared import children, removed
from tidebook.sources.tables import read_or_empty
from tidebook.streaming.jobs import folded_rows

#: Kinds of rows that are no events: what is above the block of a discard was rewound, a heartbeat only moves the watermark.
DISCARD, HEARTBEAT = "discard", "heartbeat"
FOLDED = "account long, asset long, block long, log_index long, moved long, balance long"
#: Every so many micro-batches all balances are written; in between, those that changed.
COMPACT = 16
_KEY = ["account", "asset"]
_WAITING = "account long, asset long, block long, log_index long, seq long, event_type string, delta long"
_BALANCES = "account long, asset long, balance long, batch long"
_MARK = "batch long, due long, base long"


def _current(spark: SparkSession, state: str, base: int, last: int) -> DataFrame:
    """The balances after micro-batch `last`: of those written since `base`, the newest of each account and asset."""
    paths = [f"{state}/balances/{b}" for b in children(spark, f"{state}/balances") if base <= int(b.split("=")[1]) <= last]
    rows = spark.read.schema(_BALANCES).option("basePath", f"{state}/balances").parquet(*paths) if paths else spark.createDataFrame([], _BALANCES)
    return rows.groupBy(*_KEY).agg(F.max_by("balance", "batch").alias("before"))


def fold_batch(batch: DataFrame, number: int, path: str, delay: int) -> None:
    """Folds what a micro-batch and the rows that wait bring below the watermark, and writes the state after it.

    State is rows that wait and balances as of the watermark, tables under the path; the mark of a micro-batch (watermark,
    and since when balances count) is written last.  A repeated micro-batch reads the state of the one before and writes
    the same folders again.
    """
    spark, state = batch.sparkSession, f"{path}/state"
    mark = None
    if number:
        mark = read_or_empty(spark, f"{state}/marks", _MARK).filter(F.col("batch") == number - 1).first()
        if mark is None:
            raise ValueError(f"the state before micro-batch {number} is not there")
    seen = batch.agg(F.max("block").alias("high"), F.count_if(F.col("event_type") == DISCARD).alias("discards")).first()
    dues = [d for d in (mark and mark.due, seen.high if seen.high is None else seen.high - delay) if d is not None]
    due = max(dues, default=None)
    columns = [c.split()[0] for c in _WAITING.split(", ")]
    rows = batch.select(columns).filter(~F.col("event_type").isin(DISCARD, HEARTBEAT))
    if mark is not None:
        rows = rows.filter(F.lit(True) if mark.due is None else F.col("block") > mark.due).unionByName(read_or_empty(spark, f"{state}/waiting/batch={number - 1}", _WAITING))
    rows = rows.repartition(*_KEY).dropDuplicates()
    if seen.discards:
        rewound = batch.filter(F.col("event_type") == DISCARD).groupBy(*_KEY).agg(F.min("block").alias("_to"))
        rows = rows.join(rewound, _KEY, "left").filter("_to is null or block <= _to").drop("_to")
    ripe = rows.filter(F.lit(False) if due is None else F.col("block") <= due)
    before = _current(spark, state, mark.base, number - 1) if mark else spark.createDataFrame([], "account long, asset long, before long")
    folded_rows(ripe.join(before, _KEY, "left"), "before").write.mode("overwrite").parquet(f"{path}/batch={number}")
    rows.filter(F.lit(True) if due is None else F.col("block") > due).write.mode("overwrite").parquet(f"{state}/waiting/batch={number}")
    done = spark.read.parquet(f"{path}/batch={number}")
    after = done.groupBy(*_KEY).agg(F.max_by("balance", F.struct("block", "log_index", "seq")).alias("balance"))
    base = mark.base if mark and number - mark.base < COMPACT else number
    if mark and base == number:
        after = before.join(after, _KEY, "full").select(*_KEY, F.coalesce("balance", "before").alias("balance"))
    after.write.mode("overwrite").parquet(f"{state}/balances/batch={number}")
    spark.createDataFrame([(due, base)], "due long, base long").coalesce(1).write.mode("overwrite").parquet(f"{state}/marks/batch={number}")
    if mark:
        _swept(spark, state, {"waiting": number - 1, "balances": mark.base, "marks": number - 1})


def _swept(spark: SparkSession, state: str, since: dict[str, int]) -> None:
    """Removes what neither the state of this micro-batch nor that before it needs."""
    for table, first in since.items():
        for b in children(spark, f"{state}/{table}"):
            if b.startswith("batch=") and int(b.split("=")[1]) < first:
                removed(spark, f"{state}/{table}/{b}")


def ordered_fold_stream(events: DataFrame, path: str, checkpoint: str, delay: int) -> StreamingQuery:
    """The fold of a stream of (account, asset, block, log_index, seq, event_type, delta) over what there is: FOLDED rows,
    each once (see folded).

    A row of kind record takes what the balance is at its place, others add their delta.  Rows are held until the watermark
    (the highest block less the delay) has passed them, then folded in order of block, log_index and seq; equal rows count
    once, as a replay does.  Rows that come after their block was folded are dropped: a ledger that is rewound so far is
    folded anew.  A discard row of an account and asset takes back its held rows above the block, those of the same
    micro-batch included.  Each micro-batch overwrites its own folders, so a repeated one gives no row twice.
    """
    stream = events.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, path, delay))
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def folded(spark: SparkSession, path: str) -> DataFrame:
    """What ordered_fold_stream() has written."""
    return read_or_empty(spark, f"{path}/batch=*", spark.createDataFrame([], FOLDED).schema)
