"""The driver's tables in the roles that the operators know: ledgers, prices, rates, parameters, sweeps, legs.

Each view exists twice: as a DataFrame, and as the SQL that oracles are put before.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.sources.shared import LEAST_ROWS, MOST_ROWS, tasks_for

EPOCH_DAY, EPOCH_MINUTE = "1995-01-01", "2024-01-01"


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def tasks_of(rows: DataFrame) -> int:
    """Tasks that a table's rows are dealt over."""
    return tasks_for(rows.sparkSession, rows.count(), LEAST_ROWS, MOST_ROWS)


class Views:
    """Lazily read views of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def tasks(self) -> int:
        """Tasks that position events, of which each item makes one, are dealt over."""
        return tasks_of(self.table("lineitem"))

    @cached_property
    def position_events(self) -> DataFrame:
        """Ledger rows: delta is null and side empty for rows that only record."""
        items, orders = self.table("lineitem"), self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        flag = F.col("l_returnflag")
        tie = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
        # numbered before the join: items are sorted once, and the join needs no other order; an order that is there n times
        # makes n places of each
        n = self.tasks
        numbered = items.repartition(n, "l_orderkey").withColumn("_place", (F.row_number().over(tie) - 1).cast("long"))
        same = Window.partitionBy("o_orderkey")
        orders = orders.repartition(n, "o_orderkey").withColumns({"_copy": F.row_number().over(same.orderBy("o_custkey", "o_orderpriority")) - 1, "_copies": F.count("*").over(same)})
        return numbered.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "pool").otherwise("debt").alias("engine"),
            F.datediff("l_shipdate", F.lit(EPOCH_DAY)).cast("long").alias("block"),
            F.col("l_orderkey").alias("tx"),
            F.col("l_linenumber").cast("long").alias("log_index"),
            (F.col("_place") * F.col("_copies") + F.col("_copy")).alias("seq"),
            F.when(flag == "R", "repay").when(flag == "A", "borrow").otherwise("record").alias("event_type"),
            F.col("o_custkey").alias("account"),
            F.col("l_partkey").alias("asset"),
            F.when(flag == "N", "").when(F.col("l_linestatus") == "F", "debt").otherwise("collateral").alias("side"),
            F.when(flag == "R", -F.col("l_quantity")).when(flag == "A", F.col("l_quantity")).cast("long").alias("delta"),
            cents("l_extendedprice").alias("amount"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        price, time = cents("value"), F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.col("user_id").alias("asset"),
            F.col("event_type").alias("source"),
            F.floor((F.unix_seconds(time) - F.unix_seconds(F.lit(EPOCH_MINUTE).cast("timestamp"))) / 60).cast("long").alias("block"),
            F.col("event_id").alias("log_index"),
            price.alias("price"),
            (price % 11 != 0).alias("valid"),
            F.when(price % 11 == 0, F.when(price % 2 == 0, "non_positive").otherwise("stale")).alias("reason"),
            F.unix_seconds(time).alias("as_of"),
        )

    @cached_property
    def rate_indexes(self) -> DataFrame:
        """Read off the items alone: a rate needs nothing of the order that an item belongs to."""
        items = self.table("lineitem").filter("l_returnflag <> 'N'")
        side = F.when(F.col("l_linestatus") == "F", "debt").otherwise("collateral").alias("side")
        rows = items.select(F.col("l_partkey").alias("asset"), side, F.datediff("l_shipdate", F.lit(EPOCH_DAY)).cast("long").alias("block"), F.col("l_quantity").cast("long").alias("moved"))
        days = rows.groupBy("asset", "side", "block").agg(F.sum("moved").alias("q"))
        grown = F.sum("q").over(Window.partitionBy("asset", "side").orderBy("block"))
        return days.select("asset", F.col("side").alias("kind"), "block", (F.lit(1_000_000) + grown).alias("value"))

    @cached_property
    def param_history(self) -> DataFrame:
        """Two rows per asset; null means that a row does not set the parameter."""
        part = self.table("part")
        size, brand = F.col("p_size").cast("long"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
        block, none = F.col("p_partkey") % 1000, F.lit(None).cast("long")
        row = lambda at, log, ltv, threshold, bonus: part.select(F.col("p_partkey").alias("asset"), at.alias("block"), F.lit(log).cast("long").alias("log_index"), ltv.alias("ltv"), threshold.alias("threshold"), bonus.alias("bonus"))
        first = row(block, 0, size + 20, size + 30, none)
        return first.union(row(block + 500, 1, none, F.when(size % 2 == 0, size + 35), 100 + brand))

    @cached_property
    def sweeps(self) -> DataFrame:
        last = self.table("orders").groupBy("o_custkey").agg(F.max(F.datediff("o_orderdate", F.lit(EPOCH_DAY))).cast("long").alias("last"))
        key = F.col("c_custkey")
        status = F.when(F.col("last").isNull(), "never").when(key % 7 == 0, "failed").otherwise("success")
        return self.table("customer").join(last, key == F.col("o_custkey"), "left").select(
            key.alias("account"),
            F.when(F.col("c_nationkey") % 2 == 0, "debt").otherwise("pool").alias("engine"),
            status.alias("status"),
            F.when(F.col("last").isNotNull(), F.col("last") + key % 3).alias("last_attempt"),
            F.when(F.col("last").isNotNull() & (key % 7 != 0), F.col("last")).alias("last_success"),
            (key % 5).alias("generation"),
            (1 + key % 4).alias("attempts"),
        )

    @cached_property
    def balances(self) -> DataFrame:
        """Stored balances: the sums of deltas, some of them off by one, some missing."""
        sums = self.position_events.filter("delta is not null and side <> ''").groupBy("engine", "account", "asset", "side").agg(F.sum("delta").alias("amount"), F.max("block").alias("updated_block"))
        off = F.when((F.col("account") + F.col("asset")) % 97 == 0, 1).otherwise(0)
        source = F.when(F.col("asset") % 3 == 0, "snapshot").otherwise("event")
        return sums.filter((F.col("account") * 31 + F.col("asset")) % 101 != 0).select("engine", "account", "asset", "side", source.alias("source"), (F.col("amount") + off).alias("amount"), "updated_block")

    @cached_property
    def legs(self) -> DataFrame:
        """Collateral of each account: amount, price in cents, and the weights of the asset in percent."""
        events = self.position_events.filter("side = 'collateral' and delta > 0").groupBy("account", "asset").agg(F.sum("delta").alias("amount"))
        part = self.table("part").select(F.col("p_partkey").alias("asset"), cents("p_retailprice").alias("price"), (50 + F.col("p_size") % 40).cast("long").alias("ltv"), (55 + F.col("p_size") % 40).cast("long").alias("threshold"), (105 + F.col("p_size") % 10).cast("long").alias("bonus"))
        return events.join(part, "asset").select("account", "asset", "amount", "price", "ltv", "threshold", "bonus")

    @cached_property
    def debts(self) -> DataFrame:
        """Debt of each account in cents, and the engine that it is judged by."""
        total = self.table("orders").groupBy(F.col("o_custkey").alias("account")).agg(F.sum(cents("o_totalprice")).alias("t"))
        return total.select("account", F.when(F.col("account") % 3 == 0, "pool").otherwise("debt").alias("engine"), F.expr("t div (4 + account % 40)").alias("debt"))


    @cached_property
    def accounts(self) -> DataFrame:
        """Engine and debt (as in debts) and sweep status (as in sweeps) of each account, in one pass over the orders."""
        orders = self.table("orders").groupBy(F.col("o_custkey").alias("account")).agg(F.sum(cents("o_totalprice")).alias("t"), F.max("o_orderdate").alias("last"))
        key = F.col("account")
        swept = self.table("customer").select(F.col("c_custkey").alias("account"), F.lit(True).alias("known"))
        status = F.when(F.col("known"), F.when(F.col("last").isNull(), "never").when(key % 7 == 0, "failed").otherwise("success"))
        rows = orders.join(swept, "account", "left")
        return rows.select("account", F.when(key % 3 == 0, "pool").otherwise("debt").alias("engine"), F.expr("t div (4 + account % 40)").alias("debt"), status.alias("status"))


SQL_VIEWS: dict[str, str] = {
    "position_events": """
  select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'pool' else 'debt' end as engine,
         date_diff('day', date '1995-01-01', cast(l_shipdate as date)) as block, l_orderkey as tx, cast(l_linenumber as bigint) as log_index,
         row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 as seq,
         case l_returnflag when 'R' then 'repay' when 'A' then 'borrow' else 'record' end as event_type, o_custkey as account, l_partkey as asset,
         case when l_returnflag = 'N' then '' when l_linestatus = 'F' then 'debt' else 'collateral' end as side,
         cast(case l_returnflag when 'R' then -l_quantity when 'A' then l_quantity end as bigint) as delta,
         cast(round(l_extendedprice * 100) as bigint) as amount
  from lineitem join orders on l_orderkey = o_orderkey""",
    "prices": """
  select user_id as asset, event_type as source,
         cast(floor((floor(epoch(ts)) - epoch(timestamp '2024-01-01')) / 60) as bigint) as block, event_id as log_index,
         cast(round(value * 100) as bigint) as price, cast(round(value * 100) as bigint) % 11 <> 0 as valid,
         case when cast(round(value * 100) as bigint) % 11 = 0 then case when cast(round(value * 100) as bigint) % 2 = 0 then 'non_positive' else 'stale' end end as reason,
         cast(floor(epoch(ts)) as bigint) as as_of
  from events""",
    "rate_indexes": """
  select asset, kind, block, cast(1000000 + sum(q) over (partition by asset, kind order by block) as bigint) as value
  from (select asset, side as kind, block, sum(abs(delta)) as q from position_events where side <> '' group by all)""",
    "param_history": """
  select p_partkey as asset, p_partkey % 1000 as block, 0::bigint as log_index, cast(p_size + 20 as bigint) as ltv, cast(p_size + 30 as bigint) as threshold, null::bigint as bonus from part
  union all
  select p_partkey, p_partkey % 1000 + 500, 1::bigint, null::bigint, case when p_size % 2 = 0 then cast(p_size + 35 as bigint) end,
         100 + cast(regexp_extract(p_brand, '(\\d+)', 1) as bigint) from part""",
    "sweeps": """
  select c_custkey as account, case when c_nationkey % 2 = 0 then 'debt' else 'pool' end as engine,
         case when last is null then 'never' when c_custkey % 7 = 0 then 'failed' else 'success' end as status,
         last + c_custkey % 3 as last_attempt, case when c_custkey % 7 <> 0 then last end as last_success,
         c_custkey % 5 as generation, 1 + c_custkey % 4 as attempts
  from customer left join (select o_custkey, max(date_diff('day', date '1995-01-01', cast(o_orderdate as date))) as last from orders group by 1) on c_custkey = o_custkey""",
    "balances": """
  select engine, account, asset, side, case when asset % 3 = 0 then 'snapshot' else 'event' end as source,
         cast(s + case when (account + asset) % 97 = 0 then 1 else 0 end as bigint) as amount, updated_block
  from (select engine, account, asset, side, sum(delta) as s, max(block) as updated_block from position_events
        where delta is not null and side <> '' group by all)
  where (account * 31 + asset) % 101 <> 0""",
    "legs": """
  select account, asset, cast(a as bigint) as amount, cast(round(p_retailprice * 100) as bigint) as price, cast(50 + p_size % 40 as bigint) as ltv,
         cast(55 + p_size % 40 as bigint) as threshold, cast(105 + p_size % 10 as bigint) as bonus
  from (select account, asset, sum(delta) as a from position_events where side = 'collateral' and delta > 0 group by all) join part on asset = p_partkey""",
    "debts": """
  select account, case when account % 3 = 0 then 'pool' else 'debt' end as engine, cast(t // (4 + account % 40) as bigint) as debt
  from (select o_custkey as account, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as t from orders group by 1)""",
}


def with_views(sql: str) -> str:
    """An oracle with the views that it names put before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    views = ",\n".join(f"{n} as ({SQL_VIEWS[n]})" for n in needed)
    rest = sql.strip()
    if rest[:15].lower() == "with recursive ":
        return f"with recursive {views}, {rest[15:]}"
    return f"with {views}{', ' + rest[5:] if rest[:5].lower() == 'with ' else chr(10) + rest}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Views as a query, with its oracle."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return register
