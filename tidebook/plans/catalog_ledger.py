"""Queries of ledgers, joins and aggregates, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import aggregates as A
from tidebook.operators import joins as J
from tidebook.operators import ledger as L
from tidebook.plans.bindings import Views, query

ENGINES = "values ('debt'), ('pool'), ('idle') as t(engine)"


def engines(v: Views):
    return v.spark.sql(f"select * from {ENGINES}")


# ---- C: folds


@query("c1_balance_fold", "select engine, account, asset, side, cast(sum(delta) as bigint) as amount, max(block) as updated_block from position_events where delta is not null and side <> '' group by all")
def _(v):
    return L.balance_fold(v.position_events)


RATED = """from position_events e join (select asset, block, max(value) as idx from rate_indexes group by all) r using (asset, block)"""


@query("c2_borrow_deltas", f"""
select tx, log_index, seq, account, asset, block, event_type, amount,
       cast(case when event_type = 'borrow' then -((-amount::hugeint * 1000000 - ((-amount::hugeint * 1000000 % idx) + idx) % idx) // idx) else -((amount::hugeint * 1000000) // idx) end as bigint) as units, false as missing_rate
{RATED} where event_type in ('borrow', 'repay')""")
def _(v):
    return L.borrow_deltas(v.position_events, v.rate_indexes)


@query("c3_overdrawn", """
select engine, account, asset, side, block, log_index, seq, tx, delta, cast(balance as bigint) as balance from (
  select *, sum(delta) over (partition by engine, account, asset, side order by block, log_index, seq, tx rows between unbounded preceding and current row) as balance
  from position_events where delta is not null and side <> '') where delta < 0 and balance < 0""")
def _(v):
    return L.overdrawn(v.position_events)


@query("c4_regime_deltas", f"""
select tx, log_index, seq, account, asset, block, event_type, cast(case when event_type = 'borrow' then units else -units end as bigint) as units, old_regime from (
  select *, case when old_regime then (s + idx // 2) // idx when event_type = 'borrow' then (s + idx - 1) // idx else s // idx end as units from (
    select e.*, idx, amount::hugeint * 1000000 as s, (block < 1200 or (block = 1200 and log_index < 3)) as old_regime {RATED} where event_type in ('borrow', 'repay')))""")
def _(v):
    return L.regime_deltas(v.position_events, v.rate_indexes, (1200, 3))


@query("c5_writeoff_before", """
select tx, log_index, seq, account, asset, case when w then 0 else delta end as delta, w as written_off from (
  select *, coalesce(bool_or(event_type = 'record') over (partition by tx, account order by log_index, seq rows between unbounded preceding and 1 preceding), false) as w
  from position_events) where event_type = 'repay'""")
def _(v):
    return L.writeoff_before(v.position_events)


@query("c8_transfer_fan_out", """
select tx, log_index, seq, asset, 0 as part, account as party, -amount as moved from position_events where event_type = 'record'
union all select tx, log_index, seq, asset, 1, asset + 100000, amount from position_events where event_type = 'record'""")
def _(v):
    return L.transfer_fan_out(v.position_events.filter("event_type = 'record'"), F.col("asset") + 100000)


@query("c9_preceding_index", """
select tx, asset, log_index, seq, account, "index" from (
  select *, last_value(case when event_type = 'record' then amount end ignore nulls) over (partition by tx, asset order by log_index, case when event_type = 'record' then 0 else 1 end, seq rows between unbounded preceding and 1 preceding) as "index"
  from (select * replace (asset % 10 as asset) from position_events)) where event_type <> 'record'""")
def _(v):
    e = v.position_events.withColumn("asset", F.col("asset") % 10)
    return L.preceding_index(e.filter("event_type <> 'record'"), e.filter("event_type = 'record'").withColumn("index", F.col("amount")))


@query("c10_liquidation_fan_out", """
with l as (select tx, account, sum(amount)::bigint as debt from position_events where delta < 0 group by all),
s as (select tx, account, asset, sum(-delta)::bigint as amount from position_events where delta < 0 group by all)
select tx, account, 0 as part, null::bigint as asset, -debt as moved from l
union all select tx, account, cast(row_number() over (partition by tx, account order by asset) as int), asset, -amount from s""")
def _(v):
    seized = v.position_events.filter("delta < 0").groupBy("tx", "account", "asset").agg(F.sum("amount").alias("debt"), F.sum(-F.col("delta")).alias("amount"))
    rows = seized.groupBy("tx", "account").agg(F.sum("debt").alias("debt"), F.array_sort(F.collect_list(F.struct("asset", "amount"))).alias("seized"))
    return L.liquidation_fan_out(rows)


@query("c10_residue_rows", """
select tx, account, asset, side, log_index, -1::bigint as delta from (
  select *, row_number() over w as place, sum(delta) over (w rows between unbounded preceding and current row) as lft
  from (select * replace (account % 50 as account, asset % 3 as asset, tx % 500 as tx) from position_events where delta is not null)
  window w as (partition by tx, account, asset, side order by log_index, seq, block, amount)) where place = 2 and lft = 1""")
def _(v):
    rows = v.position_events.withColumns({"account": F.col("account") % 50, "asset": F.col("asset") % 3, "tx": F.col("tx") % 500})
    return L.residue_rows(rows, ("block", "amount"))


@query("c11_record_rows", "select tx, log_index, seq, account, null::bigint as delta, '' as side, cast(amount as varchar) as amount_text from position_events where event_type = 'record'")
def _(v):
    return L.record_rows(v.position_events).withColumn("amount_text", F.col("payload")["amount"]).drop("payload")


@query("c12_genesis_rows", """
select account, row_number() over (partition by account order by asset) - 1 as seq, amount as delta from legs""")
def _(v):
    seeds = v.legs.groupBy("account").agg(F.array_sort(F.collect_list(F.struct("asset", "amount"))).alias("s")).select("account", F.transform("s", lambda x: x["amount"]).alias("amounts"))
    return L.genesis_rows(seeds)


DOCUMENT = "string_agg(asset || ':' || amount, ',' order by asset) as document, count(*) as entries"


@query("c13_touched_documents", f"""
select account, {DOCUMENT} from (select account, asset, cast(sum(amount) as bigint) as amount from balances where side = 'debt'
  and account in (select account from position_events where block between 1000 and 1010 and delta is not null) group by all) group by account""")
def _(v):
    return L.touched_documents(v.position_events, v.balances, 1000, 1010)


@query("a6_balance_documents", f"select account, {DOCUMENT} from (select account, asset, cast(sum(amount) as bigint) as amount from balances group by all) group by account")
def _(v):
    return L.balance_documents(v.balances)


@query("c14_rewound", """
with kept as (select * from position_events where block <= 1500)
select engine, account, asset, side, cast(sum(delta) as bigint) as amount, max(block) as updated_block from kept
where delta is not null and side <> '' and (engine, account) in (select (engine, account) from kept where side = 'debt' and delta is not null) group by all""")
def _(v):
    return L.rewound(v.position_events, 1500)


def control(v: Views):
    """Cursors of engines and epochs of chains, from the regions and nations."""
    n = v.table("nation")
    cursors = n.select(F.col("n_name").alias("engine"), F.col("n_regionkey").cast("long").alias("chain"), (F.col("n_nationkey") % 4).cast("long").alias("acked"), (F.col("n_nationkey") * 100).cast("long").alias("block"))
    epochs = n.select(F.col("n_regionkey").cast("long").alias("chain"), (F.col("n_nationkey") / 5).cast("long").alias("epoch"), (2000 - F.col("n_nationkey") * 7).cast("long").alias("rewound_to"))
    return cursors, epochs


CONTROL = """cursors as (select n_name as engine, n_regionkey::bigint as chain, (n_nationkey % 4)::bigint as acked, (n_nationkey * 100)::bigint as block from nation),
epochs as (select n_regionkey::bigint as chain, (n_nationkey // 5)::bigint as epoch, (2000 - n_nationkey * 7)::bigint as rewound_to from nation)"""


@query("c15_rewind_target", f"""with {CONTROL}
select engine, least(1990, coalesce(min(rewound_to), 1990))::bigint as target from cursors left join epochs on epochs.chain = cursors.chain and epochs.epoch > cursors.acked group by engine""")
def _(v):
    return L.rewind_target(*control(v), 1990)


# ---- D: joins

FOLD = "(select engine, account, asset, side, cast(sum(delta) as bigint) as derived from position_events where delta is not null and side <> '' group by all)"


@query("d1_mismatches", f"select engine, account, asset, side, derived, amount as stored from {FOLD} full join balances using (engine, account, asset, side) where derived is distinct from amount")
def _(v):
    return J.mismatches(L.balance_fold(v.position_events), v.balances, ["engine", "account", "asset", "side"])


@query("d2_orphans", "select tx, log_index, seq from position_events where tx not in (select o_orderkey from orders where o_orderstatus = 'F')")
def _(v):
    logs = v.table("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tx"))
    return J.orphans(v.position_events, logs, ["tx"], unique=True).select("tx", "log_index", "seq")


BOUNDS = "(select 'debt' as kind, 1400 as bound union all select 'collateral', 900)"


@query("d3_newest_rate", f"select asset, kind, max(block) as block, arg_max(value, block) as value from rate_indexes join {BOUNDS} using (kind) where block <= bound group by all")
def _(v):
    bounds = v.spark.sql("select * from values ('debt', 1400L), ('collateral', 900L) as t(kind, bound)")
    return J.newest_within(v.rate_indexes, bounds, ["asset", "kind"], ["kind"])


@query("d4_as_of_bonus", """
select tx, log_index, seq, asset, block, (select arg_max(bonus, p.block * 10 + p.log_index) from param_history p where p.asset = e.asset and p.bonus is not null and (p.block, p.log_index) <= (e.block, e.log_index)) as bonus
from position_events e where event_type = 'repay'""")
def _(v):
    events = v.position_events.filter("event_type = 'repay'").select("tx", "log_index", "seq", "asset", "block")
    return J.as_of(events, v.param_history, ["asset"], "bonus", ["block", "log_index"], v.tasks)


@query("d5_own_clock", """
select account, clock, cast(coalesce(sum(case when block <= clock then delta end), 0) as bigint) as total
from (select account, last_success as clock from sweeps where last_success is not null) left join position_events using (account) group by all""")
def _(v):
    clocks = v.sweeps.filter("last_success is not null").select("account", F.col("last_success").alias("clock"))
    return J.own_clock_sums(v.position_events, clocks)


@query("d6_uncovered", "select distinct asset, block from position_events e where event_type = 'record' and not exists (select 1 from rate_indexes r where r.asset = e.asset and r.block = e.block)")
def _(v):
    return J.orphans(v.position_events.filter("event_type = 'record'").select("asset", "block").distinct(), v.rate_indexes, ["asset", "block"])


@query("d7_registry_defaults", "select c_custkey as account, coalesce(status, 'unknown') as status, coalesce(attempts, 0) as attempts from customer left join (select * from sweeps where engine = 'pool') on account = c_custkey")
def _(v):
    return J.with_defaults(v.table("customer").select(F.col("c_custkey").alias("account")), v.sweeps.filter("engine = 'pool'").select("account", "status", "attempts"), ["account"], {"status": "unknown", "attempts": 0})


@query("d8_restrict", "select * from prices where asset in (select p_partkey from part where p_size > 25)")
def _(v):
    return J.restrict(v.prices, v.table("part").filter("p_size > 25").select(F.col("p_partkey").alias("asset")), ["asset"])


@query("d9_attached", """
select o_orderkey as tx, coalesce(string_agg(e.asset || ':' || e.amount, ',' order by e.asset, e.amount), '') as details
from (select o_orderkey from orders order by o_orderkey limit 500) left join position_events e on e.tx = o_orderkey group by all""")
def _(v):
    page = v.table("orders").select(F.col("o_orderkey").alias("tx")).orderBy("tx").limit(500)
    out = J.attached(page, v.position_events, ["tx"], ["asset", "amount"])
    return out.withColumn("details", F.array_join(F.transform("details", lambda d: F.concat_ws(":", d["asset"], d["amount"])), ","))


@query("d10_price_coverage", """
select asset, source, max(block) as block, arg_max(price, log_index) as price, arg_max(valid, log_index) as valid, count(*) filter (not valid) as quarantined, max(block) filter (not valid) as last_bad
from prices group by all""")
def _(v):
    return J.price_coverage(v.prices)


@query("d11_position_assembly", """
with rate as (select asset, arg_max(value, block) as idx from rate_indexes where kind = 'collateral' and block <= 2000 group by asset)
select account, engine, count(*) as legs, cast(sum(amount * price) as bigint) as value, cast(sum(amount * idx // 1000000) as bigint) as live, count(*) filter (idx is null) as without_rate, max(s.status) as status
from legs join debts using (account) left join rate using (asset) left join (select account, status from sweeps) s using (account) group by all""")
def _(v):
    rate = v.rate_indexes.filter("kind = 'collateral' and block <= 2000").groupBy("asset").agg(F.max_by("value", "block").alias("idx"))
    rows = v.legs.join(rate, "asset", "left").join(v.accounts.select("account", "engine", "status"), "account")
    return rows.groupBy("account", "engine").agg(
        F.count("*").alias("legs"), F.sum(F.col("amount") * F.col("price")).alias("value"), F.sum(F.expr("amount * idx div 1000000")).alias("live"),
        F.count_if(F.col("idx").isNull()).alias("without_rate"), F.max("status").alias("status"),
    )


@query("d12_snapshot_at_success", "select account, block, cast(sum(delta) as bigint) as amount from (select account, last_success as block from sweeps) join position_events using (account, block) where delta is not null group by all")
def _(v):
    return v.sweeps.select("account", F.col("last_success").alias("block")).join(v.position_events.filter("delta is not null"), ["account", "block"]).groupBy("account", "block").agg(F.sum("delta").alias("amount"))


PINS = """pins as (select block, 'h' || (block % 50) || case when log_index = 7 and account % 29 = 0 then 'x' else '' end as hash from position_events),
headers as (select distinct block, 'h' || (block % 50) || case when block % 41 = 0 then 'y' else '' end as header_hash from position_events where block % 13 <> 0)"""


def pins(v: Views):
    e = v.position_events
    p = e.select("block", F.concat(F.lit("h"), F.col("block") % 50, F.when((F.col("log_index") == 7) & (F.col("account") % 29 == 0), "x").otherwise("")).alias("hash"))
    h = e.filter("block % 13 <> 0").select("block", F.concat(F.lit("h"), F.col("block") % 50, F.when(F.col("block") % 41 == 0, "y").otherwise("")).alias("header_hash")).distinct()
    return p, h


@query("d13_headers_coherent", f"""with {PINS}
select block, pinned, header_hash from (select block, string_agg(distinct hash, ',' order by hash) as pinned, count(distinct hash) as n, list(hash) as hs from pins group by block) left join headers using (block)
where n > 1 or (header_hash is not null and not list_contains(hs, header_hash))""")
def _(v):
    return J.headers_coherent(*pins(v)).withColumn("pinned", F.array_join("pinned", ","))


@query("d14_anchor_vouch", "select asset, source, block, log_index from prices where block not in (select block from prices where source = 'view')")
def _(v):
    return J.orphans(v.prices, v.prices.filter("source = 'view'"), ["block"]).select("asset", "source", "block", "log_index")


@query("d18_set_comparison", """
select account, case when b is null then 'left' when a is null then 'right' else 'both' end as place from (select distinct account, 1 as a from legs) full join (select distinct account, 1 as b from debts where debt > 3000000) using (account)""")
def _(v):
    return J.set_comparison(v.legs, v.debts.filter("debt > 3000000"), ["account"])


@query("d19_price_with_anchor", "select p.asset, p.block, p.price, a.price as anchor_price from (select * from prices where source = 'click') p left join (select asset, block, max(price) as price from prices where source = 'view' group by all) a using (asset, block)")
def _(v):
    anchor = v.prices.filter("source = 'view'").groupBy("asset", "block").agg(F.max("price").alias("anchor_price"))
    return v.prices.filter("source = 'click'").select("asset", "block", "price").join(anchor, ["asset", "block"], "left")


@query("d20_newest_usable", "select block, price from prices where asset = 7 and source = 'click' and valid order by block desc, log_index desc limit 1")
def _(v):
    return J.newest_usable(v.prices, F.lit(7), F.lit("click"))


# ---- E: aggregates


@query("e1_as_of_sums", "select engine, account, asset, side, cast(sum(delta) as bigint) as amount from position_events where block <= 1200 and delta is not null and side <> '' group by all")
def _(v):
    return A.as_of_sums(v.position_events, 1200)


@query("e2_net_per_asset", "select engine, asset, side, cast(sum(delta) as bigint) as net from position_events where delta is not null group by all")
def _(v):
    return A.net_per_asset(v.position_events)


@query("e3_conflicting", f"with {PINS} select block, count(distinct hash) as n, string_agg(distinct hash, ',' order by hash) as \"values\" from pins group by block having count(distinct hash) > 1")
def _(v):
    return A.conflicting(pins(v)[0], ["block"], "hash")


@query("e4_ever_flags", "select account, bool_or(event_type = 'repay') as repaid, bool_or(side = 'debt') as indebted, bool_or(engine = 'pool') as pooled from position_events group by account")
def _(v):
    return A.ever_flags(v.position_events)


@query("e5_sweep_counts", "select engine, count(*) filter (status = 'never') as never, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'success') as success, count(*) as accounts from sweeps group by engine")
def _(v):
    return A.sweep_counts(v.sweeps)


ENGINE_SQL = "(select unnest(['debt', 'pool', 'idle']) as engine)"


@query("e6_sweep_watermark", f"""
select engine, coalesce(n_rows, 0) as n_rows, coalesce(failed, 0) as failed, cast(coalesce(success_sum, 0) as bigint) as success_sum, coalesce(newest, 0) as newest, coalesce(generation, 0) as generation
from {ENGINE_SQL} left join (select engine, count(*) as n_rows, count(*) filter (status = 'failed') as failed, sum(last_success) as success_sum, max(last_attempt) as newest, max(generation) as generation from sweeps group by engine) using (engine)""")
def _(v):
    return A.sweep_watermark(engines(v), v.sweeps)


@query("e7_census", """
select 'events' as table_name, event_type as kind, count(*) as n from position_events group by all union all select 'prices', source, count(*) from prices group by all union all select 'balances', source, count(*) from balances group by all""")
def _(v):
    return A.census({"events": (v.position_events, "event_type"), "prices": (v.prices, "source"), "balances": (v.balances, "source")})


@query("e9_header_cohorts", f"""with {PINS},
seen as (select block, count(distinct hash) as n, min(hash) as pin from pins group by block)
select case when n is null then 'no_pin' when n > 1 then 'multi_pin' when header_hash is null then 'pending' when header_hash = pin then 'matched' else 'mismatched' end as cohort, count(*) as blocks
from (select unnest(range(0, 2600)) as block) left join seen using (block) left join headers using (block) group by all""")
def _(v):
    return A.header_cohorts(*pins(v), v.spark.range(2600).withColumnRenamed("id", "block"))


@query("e10_price_buckets", """
select asset, source, block // 720 as bucket, valid, arg_min(price, log_index) as open, arg_max(price, log_index) as close, min(price) as low, max(price) as high, cast(sum(price) as bigint) as total, count(*) as n,
       coalesce(string_agg(distinct reason, ',' order by reason), '') as reasons from prices group by all""")
def _(v):
    return A.price_buckets(v.prices, 720)


@query("e11_first_block", "select account, min(block) as first_block from position_events where side = 'debt' group by account")
def _(v):
    return A.first_block(v.position_events, "debt")


@query("e12_generation_spans", "select engine, generation, min(last_attempt) as first_attempt, max(last_attempt) as last_attempt, count(last_attempt) as n from sweeps group by all")
def _(v):
    return A.generation_spans(v.sweeps)


@query("e13_distinct_anchors", "select asset, count(distinct block) as n from prices group by asset")
def _(v):
    return A.distinct_counts(v.prices, ["asset"], "block")


@query("e14_nested_rates", """
select asset, string_agg(kind || '=' || value || '@' || block, ',' order by kind) as rates from (select asset, kind, max(block) as block, arg_max(value, block) as value from rate_indexes group by all) group by asset""")
def _(v):
    return A.nested_rates(v.rate_indexes)


@query("e15_collateral_by_disclosure", """
select asset, case when price < 91000 then 'unpriced' when ltv < 60 then 'not_counted' else 'counted' end as disclosure, cast(sum(amount) as bigint) as amount, cast(sum(amount * price) as bigint) as value from legs group by all""")
def _(v):
    return A.collateral_by_disclosure(v.legs, F.when(F.col("price") < 91000, "unpriced").when(F.col("ltv") < 60, "not_counted").otherwise("counted"))


@query("e18_interval_count", "select account, count(*) as n from position_events where block > 500 and block <= 900 group by account")
def _(v):
    return A.interval_count(v.position_events, 500, 900)


@query("e19_quarantine_backlog", "select source, count(*) as n, min(as_of) as oldest, max(as_of) as newest, max(block) as highest from prices where not valid group by source")
def _(v):
    return A.quarantine_backlog(v.prices)


@query("e20_repair_exposure", """
select source, count(*) as n, count(*) filter (block not in (select block from prices where source = 'view')) as unanchored from prices where block > 20000 group by source""")
def _(v):
    return A.repair_exposure(v.prices, v.prices.filter("source = 'view'"), 20000)


LENGTHS = " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("tx", "log_index", "seq", "asset", "delta"))


@query("e21_digest", f"""
with h as (select account, sha256({LENGTHS}) as h from position_events), p as (select account, left(h, 3) as p, sha256(string_agg(h, chr(10) order by h)) as d, count(*) as n from h group by account, p)
select account, sha256(string_agg(d, chr(10) order by p)) as digest, sum(n)::bigint as n from p group by account""")
def _(v):
    return A.digest(v.position_events, ["tx", "log_index", "seq", "asset", "delta"], ["account"])


@query("e22_max_epoch", f"with {CONTROL} select chain, max(epoch) as epoch from epochs group by chain")
def _(v):
    return A.maxima(control(v)[1], ["chain"], "epoch")
