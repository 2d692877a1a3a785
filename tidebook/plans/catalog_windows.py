"""Queries of windows, pages, gates and exact scalars, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import exact as X
from tidebook.functions import wide as W
from tidebook.operators import gates as H
from tidebook.operators import paging as G
from tidebook.operators import sequences as S
from tidebook.plans.bindings import Views, query
from tidebook.plans.catalog_ledger import CONTROL, control

# ---- F


@query("f1_latest", "select * exclude (rn) from (select asset, source, block, log_index, price, row_number() over (partition by asset, source order by block desc, log_index desc) as rn from prices) where rn = 1")
def _(v):
    return S.latest(v.prices.select("asset", "source", "block", "log_index", "price"), ["asset", "source"], [F.desc("block"), F.desc("log_index")])


@query("f2_newest_and_valid", """
select asset, source, max(block) as newest_block, arg_max(price, log_index) as newest_price, max(block) filter (valid) as valid_block, arg_max(price, log_index) filter (valid) as valid_price from prices group by all""")
def _(v):
    return S.newest_and_newest_valid(v.prices)


@query("f3_regressions", "select * from (select asset, source, block, log_index, price, lag(price) over (partition by asset, source order by block, log_index) as previous from prices) where price < previous")
def _(v):
    return S.regressions(v.prices.select("asset", "source", "block", "log_index", "price"), ["asset", "source"], "price", ["block", "log_index"])


@query("f4_invalid_ranges", """
select asset, source, min(block) as first_block, max(block) as last_block, count(*) as n, string_agg(distinct reason, ',' order by reason) as reasons from (
  select *, sum(change) over (partition by asset, source order by block, log_index) as island from (
    select *, case when valid = lag(valid) over (partition by asset, source order by block, log_index) then 0 else 1 end as change from prices))
where not valid group by asset, source, island""")
def _(v):
    return S.invalid_ranges(v.prices)


@query("f5_strided", """
with recursive o as (select *, row_number() over (partition by asset, source order by block, log_index) as rn from prices),
r as (select asset, source, block, log_index, price, valid, rn, true as kept, block as last from o where rn = 1 union all
  select o.asset, o.source, o.block, o.log_index, o.price, o.valid, o.rn, o.valid <> r.valid or o.block >= r.last + 1440, case when o.valid <> r.valid or o.block >= r.last + 1440 then o.block else r.last end
  from r join o on o.asset = r.asset and o.source = r.source and o.rn = r.rn + 1)
select asset, source, block, log_index, price, valid from r where kept""")
def _(v):
    return S.strided(v.prices.select("asset", "source", "block", "log_index", "price", "valid"), ["asset", "source"], "block", 1440, "valid")


GAPS = "(select * from (select asset, source, block, log_index, greatest(0, as_of - lag(as_of) over (partition by asset, source order by block, log_index)) as gap, lag(as_of) over (partition by asset, source order by block, log_index) as was from prices) where was is not null)"


@query("f6_publication_gaps", f"select asset, source, block, log_index, gap from {GAPS}")
def _(v):
    return S.publication_gaps(v.prices)


@query("f7_nearest_rank", f"""
select source, gap as quantile, n from (select source, gap, row_number() over (partition by source order by gap) as rn, count(*) over (partition by source) as n from {GAPS}) where rn = least(n * 99 // 100, n - 1) + 1""")
def _(v):
    return S.nearest_rank(S.publication_gaps(v.prices), ["source"], "gap", 99)


@query("f8_judged_max", f"""
select asset, source, head, greatest(head, coalesce(longest, 0)) as judged from (select asset, source, greatest(0, 1706745600 - max(as_of)) as head from prices group by all)
left join (select asset, source, max(gap) as longest from {GAPS} group by all) using (asset, source)""")
def _(v):
    return S.judged_max(S.publication_gaps(v.prices), v.prices, 1706745600)


@query("f9_newest_groups", "select * exclude (r) from (select asset, block, log_index, price, dense_rank() over (partition by asset order by block desc) as r from prices) where r <= 3")
def _(v):
    return S.newest_groups(v.prices.select("asset", "block", "log_index", "price"), ["asset"], "block", 3)


GRID = "(select asset, source, step, max(price) as price, bool_or(price > 15000) as hit from (select asset, source, block // 4320 as step, price from prices) group by all)"


def grid(v: Views):
    return v.prices.withColumn("step", F.expr("block div 4320")).groupBy("asset", "source", "step").agg(F.max("price").alias("price"), F.bool_or(F.col("price") > 15000).alias("hit"))


LATCHED = f"""(select *, cumulative - coalesce(lag(cumulative) over (partition by asset, source order by step), 0) as newly from (
  select asset, source, step, price, hit, max(hit::int) over (partition by asset, source order by step) as cumulative from {GRID}))"""


@query("f11_latched", f"select * from {LATCHED}")
def _(v):
    return S.latched(grid(v), ["asset", "source"], "step", "hit")


@query("f12_falls", f"select * from (select asset, source, step, price, hit, lag(price) over (partition by asset, source order by step) as before from {GRID}) where price < before")
def _(v):
    return S.falls(grid(v), ["asset", "source"], "step", "price")


@query("f13_increments", f"""
select asset, source, from_step, step, price - was as increment, step > from_step as ordered, price >= was as rising from (
  select *, lag(step) over w as from_step, lag(price) over w as was from {GRID} window w as (partition by asset, source order by step)) where from_step is not null""")
def _(v):
    return S.increments(grid(v), ["asset", "source"], "step", "price")


@query("f14_cliff", f"select asset, source, min(step) filter (step > 0 and newly > 0) as cliff_step, max(newly) as peak, min(step) filter (newly > 0) as first_step from {LATCHED} group by all")
def _(v):
    return S.cliff(S.latched(grid(v), ["asset", "source"], "step", "hit"), ["asset", "source"], "step", "newly")


HOURS = "(select as_of // 3600 * 3600 as hour, cast(sum(price) as bigint) as total, count(*) as n from prices where source = 'click' group by all)"


@query("f15_filled_axis", f"""
select hour, case when n is null then 'absent' when n = 1 then 'withheld' else 'captured' end as state, case when n > 1 then total end as total
from (select unnest(range(lo, hi + 1, 3600)) as hour from (select min(hour) as lo, max(hour) as hi from {HOURS})) left join {HOURS} using (hour)""")
def _(v):
    hours = v.prices.filter("source = 'click'").withColumn("hour", F.expr("as_of div 3600 * 3600")).groupBy("hour").agg(F.sum("price").alias("total"), F.count("*").alias("n"))
    return S.filled_axis(hours, "hour", 3600, "total", F.col("n") == 1)


DAYS = "(select asset, block // 1440 as batch, cast(sum(price) as bigint) as value from prices group by all)"


def days(v: Views):
    return v.prices.withColumn("batch", F.expr("block div 1440")).groupBy("asset", "batch").agg(F.sum("price").alias("value"))


@query("f16_history_with_holes", f"""
select asset, batch, case when value is not null then 'row' when batch % 5 = 0 then 'withheld' else 'no_row' end as state, value
from (select distinct batch from {DAYS}) cross join (select distinct asset from {DAYS}) left join {DAYS} using (asset, batch)""")
def _(v):
    d = days(v)
    return S.history_with_holes(d.select("batch").distinct().withColumn("withheld", F.col("batch") % 5 == 0), d, "asset")


@query("f17_extremes", f"select asset, max(value) as top, min(batch) filter (value = m) as top_at, arg_max(value, batch) as newest from (select *, max(value) over (partition by asset) as m from {DAYS}) group by asset")
def _(v):
    return S.extremes(days(v), ["asset"], "batch", "value")


@query("f18_strided_points", f"""
with recursive o as (select *, row_number() over (partition by asset order by batch) as rn from {DAYS}),
r as (select asset, batch, value, rn, true as kept, batch as last from o where rn = 1 union all
  select o.asset, o.batch, o.value, o.rn, o.batch >= r.last + 3, case when o.batch >= r.last + 3 then o.batch else r.last end from r join o on o.asset = r.asset and o.rn = r.rn + 1)
select asset, batch, value from r where kept""")
def _(v):
    return S.strided(days(v), ["asset"], "batch", 3)


@query("f19_concentration", """
with ranked as (select *, row_number() over (partition by engine order by debt desc, account) as n, sum(debt) over (partition by engine) as total from debts)
select engine, tier, cast(sum(debt) as bigint) as owed, cast(sum(debt) * 1000 // max(total) as bigint) as tenths from ranked, (select unnest([1, 5, 10, 20])::bigint as tier) where n <= tier group by engine, tier""")
def _(v):
    return S.concentration(v.debts)


@query("f20_headroom_curve", """
select engine, band, n, cast(sum(n) over (partition by engine order by band) as bigint) as running from (select engine, account % 6 as band, count(*) as n from debts group by all)""")
def _(v):
    return S.headroom_curve(v.debts.groupBy("engine", (F.col("account") % 6).alias("band")).agg(F.count("*").alias("n")))


@query("f21_previous_by_batch", f"select *, lag(value) over (partition by asset order by batch) as previous from {DAYS}")
def _(v):
    return S.previous_by_batch(days(v), ["asset"], "batch", "value")


# ---- G

PAGE = "engine, account, asset, side, block, tx, log_index, seq"


@query("g1_feed_page", f"select {PAGE} from position_events where event_type = 'repay' order by block desc nulls last, tx desc, log_index desc, seq desc, account limit 100")
def _(v):
    return G.feed_page(v.position_events, 100, F.col("event_type") == "repay").select(*PAGE.split(", "))


@query("g2_after_cursor", f"select {PAGE} from position_events where (block, tx, log_index) < (700, 5000, 3)")
def _(v):
    return G.after_cursor(v.position_events, ["block", "tx", "log_index"], [700, 5000, 3]).select(*PAGE.split(", "))


BOOK = "(select d.account, d.engine, debt, collateral, case when collateral is null then 'refused' else 'computed' end as status, collateral is null as refused, case when collateral > 0 then (collateral - debt) * 1000 // collateral end as headroom from debts d left join (select account, cast(sum(amount * price) as bigint) as collateral from legs group by all) using (account))"


def book(v: Views):
    value = v.legs.groupBy("account").agg(F.sum(F.col("amount") * F.col("price")).alias("collateral"))
    rows = v.debts.join(value, "account", "left")
    refused = F.col("collateral").isNull()
    return rows.select("account", "engine", "debt", "collateral", F.when(refused, "refused").otherwise("computed").alias("status"), refused.alias("refused"), X.floor_div((F.col("collateral") - F.col("debt")) * 1000, F.col("collateral")).alias("headroom"))


FLOORED = BOOK.replace("(collateral - debt) * 1000 // collateral", "((collateral - debt) * 1000 - (((collateral - debt) * 1000) % collateral + collateral) % collateral) // collateral")


@query("g4_sorted_book", f"select account, row_number() over (order by refused, headroom nulls last, account) as place from {FLOORED}")
def _(v):
    rows = book(v)
    return G.placed(rows, [F.col("refused"), G.steps(rows, "headroom")], G.position_order("debt", "health", False)).select("account", "place")


@query("g5_at_least", f"select account, status from {BOOK} where not coalesce(status = 'computed' and greatest(debt, collateral) < 5000000, false)")
def _(v):
    return G.at_least(book(v), 5_000_000).select("account", "status")


@query("g6_top_by_size", "select account, cast(sum(delta) as bigint) as total from position_events where delta is not null group by account order by abs(sum(delta)) desc, account limit 25")
def _(v):
    return G.top_by_size(v.position_events, 25)


@query("g7_top_movers", """
with moved as (select engine, account, debt as was, debt * (100 - account % 7) // 100 as now, debt - debt * (100 - account % 7) // 100 as drop from debts where debt - debt * (100 - account % 7) // 100 > 0)
select engine, account, was, now, "drop", place, movers from (select *, row_number() over (partition by engine order by "drop" desc, account) as place, count(*) over (partition by engine) as movers from moved) where place <= 20""")
def _(v):
    before = v.debts.select("engine", "account", F.col("debt").alias("value"))
    after = v.debts.select("engine", "account", F.expr("debt * (100 - account % 7) div 100").alias("value"))
    return G.top_movers(before, after)


@query("g8_work_queue", """
select account, turn, owes from (select account, case when status = 'never' then 0 when generation < 3 then 1 when status = 'failed' then 2 end as turn, coalesce(debt > 0, false) as owes from sweeps left join (select account, debt from debts) using (account))
where turn is not null order by turn, owes desc, account limit 300""")
def _(v):
    return G.work_queue(v.sweeps, v.debts, 3, 300)


STRATA = "(select account, case when account % 10 < 5 then 'a' when account % 10 < 8 then 'b' else 'c' end as stratum, debt > 4000000 as live from debts)"


def strata(v: Views):
    k = F.col("account") % 10
    return v.debts.select("account", F.when(k < 5, "a").when(k < 8, "b").otherwise("c").alias("stratum"), (F.col("debt") > 4_000_000).alias("live"))


@query("g9_seeded_order", f"select account, stratum, live, row_number() over (partition by stratum order by live desc, md5('seed' || account)) as place from {STRATA}")
def _(v):
    return G.seeded_order(strata(v), "seed")


@query("g10_quota_sample", f"""
with o as (select *, row_number() over (partition by stratum order by live desc, md5('seed' || account)) as place from {STRATA}),
q as (select * from o where place <= case stratum when 'a' then 9 when 'b' then 8 else 3 end),
r as (select *, row_number() over (order by stratum, place) as n from o where account not in (select account from q)),
s as (select account, stratum, live, place, 'quota' as why from q union all select account, stratum, live, place, 'fill' from r where n <= 25 - (select count(*) from q))
select * from s union all select account, stratum, live, place, 'forced' from o where account in (3, 11, 77) and account not in (select account from s)""")
def _(v):
    return G.quota_sample(strata(v), "seed", {"a": 9, "b": 8, "c": 3}, 25, [3, 11, 77])


BATCHES = "(select batch, batch % 4 <> 1 as complete from (select distinct block // 100 as batch from position_events))"


def batches(v: Views):
    return v.position_events.select(F.expr("block div 100").alias("batch")).distinct().withColumn("complete", F.col("batch") % 4 != 1)


@query("g11_newest_batches", f"select * from {BATCHES} where complete order by batch desc limit 5")
def _(v):
    return G.newest_batches(batches(v), 5)


@query("g12_usable_anchors", "select distinct block from prices where source = 'view' and block < 30000 and block not in (select block from prices where not valid) order by block desc limit 40")
def _(v):
    return G.usable_anchors(v.prices.filter("source = 'view'").select("block").distinct(), v.prices.filter("not valid"), 30000, 40)


@query("g13_retained", """
with anchors as (select distinct source as engine, block from prices), r as (select *, row_number() over (partition by engine order by block desc) as n from anchors)
select engine, block from r where n <= 50 or block in (select block from prices where not valid)""")
def _(v):
    anchors = v.prices.select(F.col("source").alias("engine"), "block").distinct()
    return G.retained(anchors, v.prices.filter("not valid"), 50)


@query("g14_account_history", "select account, batch, n from (select *, dense_rank() over (partition by account order by batch desc) as r from (select account, block // 100 as batch, count(*) as n from position_events group by all)) where r <= 3")
def _(v):
    rows = v.position_events.withColumn("batch", F.expr("block div 100")).groupBy("account", "batch").agg(F.count("*").alias("n"))
    return G.account_history(rows, 3)


@query("g15_series_range", """
select asset, source, block, price from (select *, row_number() over (partition by asset, source order by block, log_index) as r
  from prices join (select asset, source, min(block) + 1000 as low, max(block) as high from prices group by all) using (asset, source) where block between low and high) where r <= 200""")
def _(v):
    """Every series from a thousand minutes after its first price on."""
    ranges = v.prices.groupBy("asset", "source").agg((F.min("block") + 1000).alias("low"), F.max("block").alias("high"))
    return G.series_range(v.prices, ranges, ["asset", "source"], ["block", "log_index"], 200).select("asset", "source", "block", "price")


@query("g16_replayed_sample", f"""
select stratum, coalesce(have, 0) as have, least(case stratum when 'a' then 9 when 'b' then 8 else 8 end, there)::bigint as due, coalesce(have, 0) < least(case stratum when 'a' then 9 when 'b' then 8 else 8 end, there) as tainted
from (select stratum, count(*) as there from {STRATA} group by all) left join (select stratum, count(*) as have from {STRATA} where account % 37 = 2 group by all) using (stratum)""")
def _(v):
    p = strata(v)
    return G.replayed_sample(p.filter("account % 37 = 2").select("account"), p, {"a": 9, "b": 8, "c": 8})


# ---- H


H1 = """
with p as (select block // 100 as batch, list_sort(list(distinct engine)) as es from position_events group by all)
select batch, batch % 6 <> 0 and len(es) = 2 as complete, case when len(es) = 2 then '' when es[1] = 'debt' then 'pool' else 'debt' end as missing from p"""


@query("h1_batch_complete", H1)
def _(v):
    rows = v.position_events.select(F.expr("block div 100").alias("batch"), "engine", F.col("amount").alias("debt"))
    declared = rows.groupBy("batch").agg((F.count("*") + F.when(F.col("batch") % 6 == 0, 1).otherwise(0)).alias("declared"), F.sum("debt").alias("declared_debt"))
    declared = declared.withColumn("required", F.array(F.lit("debt"), F.lit("pool")))
    return H.batch_complete(declared, rows, rows.select("batch", "engine").distinct())


@query("h2_timeline", """
select asset, block, log_index, 'param' as kind, ltv, threshold, bonus, null::bigint as amount from param_history union all
select asset, block, log_index, 'event', null, null, null, amount from position_events where event_type = 'repay'""")
def _(v):
    return H.timeline(v.param_history, v.position_events.filter("event_type = 'repay'"))


@query("h3_candidates", "select account from legs union select account from debts where debt > 1000000 union select tx from position_events where block < 100")
def _(v):
    return H.candidates(v.legs.select("account"), v.debts.filter("debt > 1000000").select("account"), v.position_events.filter("block < 100").select(F.col("tx").alias("account")))


@query("h5_source_conflicts", "select engine, account, side, string_agg(distinct source, ',' order by source) as sources from balances group by all having count(distinct source) > 1")
def _(v):
    return H.source_conflicts(v.balances)


@query("h5_without_conflicts", "select * from balances where (engine, account, side) not in (select (engine, account, side) from balances group by engine, account, side having count(distinct source) > 1)")
def _(v):
    return H.without_conflicts(v.balances)


@query("h6_epoch_gate", f"""with {CONTROL}, required as (select n_name as engine, (n_nationkey % 5)::bigint as chain from nation union all select 'none', 1)
select engine, case when c.chain is null then 'no_cursor' when c.chain <> required.chain then 'wrong_chain' when acked < coalesce(epoch, 0) then 'unacknowledged' else 'ok' end as reason
from required left join cursors c using (engine) left join (select chain, max(epoch) as epoch from epochs group by chain) e on e.chain = required.chain""")
def _(v):
    required = v.table("nation").select(F.col("n_name").alias("engine"), (F.col("n_nationkey") % 5).cast("long").alias("chain")).union(v.spark.sql("select 'none', 1L"))
    return H.epoch_gate(required, *control(v))


@query("h7_coverage_ok", "select account, coalesce(a > 0 and b > 0 and attempts * 100 <= a and generation >= b and engine is not distinct from 'pool', false) as ok from (select *, account % 500 as a, account % 3 as b from sweeps)")
def _(v):
    s = v.sweeps
    ok = H.coverage_ok(F.col("attempts") * 100, F.col("account") % 500, F.col("generation"), F.col("account") % 3, F.col("engine"), F.lit("pool"))
    return s.select("account", ok.alias("ok"))


@query("h8_merged_coverage", """
select n_name as engine, case when n_nationkey % 3 = n_regionkey % 3 and n_nationkey % 2 = 0 then least(n_nationkey * 10, 100 - n_nationkey) else n_nationkey * 10 end::bigint as covered_from, (n_nationkey % 3)::bigint as revision, 'b0' as binding from nation""")
def _(v):
    n = v.table("nation")
    claim = lambda at, rev, bind: n.select(F.col("n_name").alias("engine"), at.cast("long").alias("covered_from"), rev.cast("long").alias("revision"), bind.alias("binding"))
    key = F.col("n_nationkey")
    old = claim(100 - key, F.col("n_regionkey") % 3, F.concat(F.lit("b"), key % 2))
    return H.merged_coverage(old, claim(key * 10, key % 3, F.lit("b0")))


STAMPS = "stamps as (select n_nationkey::bigint as batch, n_name as engine, (n_nationkey % 3)::bigint as acked, (n_nationkey * 90 + 200)::bigint as block from nation)"


def stamps(v: Views):
    k = F.col("n_nationkey").cast("long")
    return v.table("nation").select(k.alias("batch"), F.col("n_name").alias("engine"), (k % 3).alias("acked"), (k * 90 + 200).alias("block"))


@query("h9_supersession_legs", f"""with {CONTROL}, {STAMPS}, j as (select s.batch, s.engine, s.acked, s.block, c.acked as na, c.block as nb from stamps s left join (select * from cursors where block < 2000) c using (engine))
select batch, engine, 'absent' as leg from j where na is null union all select batch, engine, 'epoch' from j where na <> acked union all select batch, engine, 'rewound' from j where nb < block""")
def _(v):
    return H.supersession_legs(stamps(v), control(v)[0].filter("block < 2000"))


@query("h10_vector_changes", f"""with {CONTROL}, {STAMPS}
select engine, case when s.engine is null then 'added' when c.engine is null then 'removed' when s.acked is distinct from c.acked then 'acked' else 'block' end as change
from (select * from stamps where batch > 2) s full join (select * from cursors where block < 2000) c using (engine) where s.acked is distinct from c.acked or s.block is distinct from c.block""")
def _(v):
    return H.vector_changes(stamps(v).filter("batch > 2"), control(v)[0].filter("block < 2000"), ["engine"], ["acked", "block"])


@query("h11_moved_rewinds", f"with {CONTROL}, {STAMPS} select engine, s.block as pin, c.block from stamps s join cursors c using (engine) where s.acked <> c.acked or s.block > c.block")
def _(v):
    return H.moved_rewinds(stamps(v).withColumnRenamed("block", "pin").drop("batch"), control(v)[0])


@query("h12_unseen", "select account from sweeps where account not in (select account from position_events where side = 'debt') and account not in (select account from legs)")
def _(v):
    return H.unseen(v.sweeps.select("account"), v.position_events.filter("side = 'debt'"), v.legs)


@query("h13_unpruned_epochs", f"with {CONTROL} select epochs.* from epochs left join (select chain, min(acked) as least from cursors group by chain) using (chain) where least is null or epoch > least")
def _(v):
    cursors, epochs = control(v)
    return H.unpruned_epochs(epochs, cursors)


@query("h15_scale_violations", "select account, engine, value_decimals from (select account, engine, case when account % 19 = 0 then 7 when engine = 'pool' then 8 else 6 end as value_decimals from debts) where value_decimals <> case engine when 'pool' then 8 else 6 end")
def _(v):
    d = v.debts.select("account", "engine", F.when(F.col("account") % 19 == 0, 7).when(F.col("engine") == "pool", 8).otherwise(6).alias("value_decimals"))
    return H.scale_violations(d, {"pool": 8, "debt": 6})


@query("h16_newest_label", f"select batch, complete, case when batch = top then 'newest' when batch < top then 'superseded' else 'pending' end as label from (select *, max(batch) filter (complete) over () as top from {BATCHES})")
def _(v):
    return H.newest_label(batches(v))


# ---- I: exact scalars, on amounts and rates of the ledger

NUMBERS = "(select tx, log_index, seq, amount::hugeint * 1000000007 as a, (asset * 1000003 + 12345678901)::hugeint as b, (account + 3)::hugeint * 1000000000000 as d from position_events)"


def numbers(v: Views):
    d = lambda c: c.cast("decimal(38,0)").cast("string")
    return v.position_events.select("tx", "log_index", "seq", d(F.col("amount").cast("decimal(20,0)") * F.lit(1000000007)).alias("a"), d(F.col("asset") * 1000003 + 12345678901).alias("b"), d((F.col("account") + 3) * 1000000000000).alias("d"))


@query("i1_mul_div", f"select tx, log_index, seq, cast(a * b // d as varchar) as down, cast((a * b + d - 1) // d as varchar) as up from {NUMBERS}")
def _(v):
    return numbers(v).select("tx", "log_index", "seq", X.mul_div_floor(F.col("a"), F.col("b"), F.col("d")).alias("down"), X.mul_div_ceil(F.col("a"), F.col("b"), F.col("d")).alias("up"))


@query("i2_ray_multiply", f"select tx, log_index, seq, cast(a * b // 1000000000000000000000000000 as varchar) as down, cast((a * b + 999999999999999999999999999) // 1000000000000000000000000000 as varchar) as up, cast((a * b + 500000000000000000000000000) // 1000000000000000000000000000 as varchar) as near from {NUMBERS}")
def _(v):
    a, b = F.col("a"), F.col("b")
    return numbers(v).select("tx", "log_index", "seq", X.ray_mul_floor(a, b).alias("down"), X.ray_mul_ceil(a, b).alias("up"), X.ray_mul_half_up(a, b).alias("near"))


@query("i3_ray_divide", "select tx, log_index, seq, cast(s // d as varchar) as down, cast((s + d - 1) // d as varchar) as up, cast((s + d // 2) // d as varchar) as near from (select tx, log_index, seq, amount::hugeint * 1000000000000000000000000000 as s, (asset + 7)::hugeint as d from position_events)")
def _(v):
    a, b = F.col("amount"), F.col("asset") + 7
    return v.position_events.select("tx", "log_index", "seq", X.ray_div_floor(a, b).alias("down"), X.ray_div_ceil(a, b).alias("up"), X.ray_div_half_up(a, b).alias("near"))


@query("i4_wad_and_percent", """
select tx, log_index, seq, cast(amount::hugeint * 1000000000000000000 // (asset + 7) as varchar) as wad_down, cast((amount::hugeint * 1000000000000000000 + (asset + 7) // 2) // (asset + 7) as varchar) as wad_near,
       cast(amount::hugeint * (asset + 1) // 10000 as varchar) as part_down, cast((amount::hugeint * (asset + 1) + 5000) // 10000 as varchar) as part_near from position_events""")
def _(v):
    a, b = F.col("amount"), F.col("asset") + 7
    return v.position_events.select("tx", "log_index", "seq", X.wad_div_floor(a, b).alias("wad_down"), X.wad_div_half_up(a, b).alias("wad_near"), X.percent_mul_floor(a, F.col("asset") + 1).alias("part_down"), X.percent_mul_half_up(a, F.col("asset") + 1).alias("part_near"))


@query("i6_health_wad", f"select account, cast(((collateral::hugeint * 80 * 1000000000000000000 + debt // 2) // debt) // 10000 as varchar) as health from {BOOK} where debt > 0 and collateral is not null")
def _(v):
    rows = book(v).filter("debt > 0 and collateral is not null")
    return rows.select("account", X.health_wad(F.col("collateral") * 80, F.col("debt")).alias("health"))


@query("i7_compare_ratios", f"select account, case when collateral::hugeint * 3 < debt::hugeint * 2 then -1 when collateral::hugeint * 3 > debt::hugeint * 2 then 1 else 0 end as order_ from {BOOK} where collateral is not null")
def _(v):
    return book(v).filter("collateral is not null").select("account", W.compare_ratios(F.col("collateral"), F.lit(2), F.col("debt"), F.lit(3)).alias("order_"))


@query("i8_snap_and_cap", "select log_index, case when p > 990000 and p < 1010000 then 1000000 else p end as snapped, least(p, 1200000) as capped, p > 1200000 as bound from (select log_index, price * 137 as p from prices)")
def _(v):
    p = v.prices.select("log_index", (F.col("price") * 137).alias("p"))
    value, bound = X.capped(F.col("p"), F.lit(1_200_000).cast("long"))
    return p.select("log_index", X.stable_snap(F.col("p")).alias("snapped"), value.alias("capped"), bound.alias("bound"))


@query("i10_bonus_fraction", "select engine, asset, case engine when 'pool' then bonus else bonus + 100 end as num, case engine when 'pool' then 10000 else 100 end::bigint as den from (select distinct engine, asset, bonus from legs join debts using (account))")
def _(v):
    rows = v.legs.join(v.debts, "account").select("engine", "asset", "bonus").distinct()
    num, den = X.bonus_fraction(F.col("engine"), F.col("bonus"))
    return rows.select("engine", "asset", num.alias("num"), den.alias("den"))


@query("i11_index_growth", "select asset, kind, block, cast(value + value::hugeint * 31709791983 * (block * 60) // 100000000000000000000 as varchar) as grown from rate_indexes")
def _(v):
    return v.rate_indexes.select("asset", "kind", "block", X.index_growth(F.col("value"), F.lit(31709791983), F.col("block") * 60).alias("grown"))


@query("i14_health_lane", f"""select account, case when collateral is null or debt is null then -1 when debt = 0 then 9 else (collateral * 100 >= debt * 90)::int + (collateral * 100 >= debt * 95)::int + (collateral * 100 >= debt * 100)::int
 + (collateral * 100 >= debt * 105)::int + (collateral * 100 >= debt * 110)::int + (collateral * 100 >= debt * 125)::int + (collateral * 100 >= debt * 150)::int + (collateral * 100 >= debt * 200)::int end as lane from {BOOK}""")
def _(v):
    return book(v).select("account", X.health_lane(F.col("collateral"), F.col("debt")).alias("lane"))


BAND = "case when headroom < 0 then 0 when headroom < 20 then 1 when headroom < 50 then 2 when headroom < 100 then 3 when headroom < 250 then 4 when headroom < 500 then 5 when headroom is not null then 6 end"


@query("i15_headroom", f"select account, headroom, {BAND} as band from {FLOORED}")
def _(v):
    return book(v).select("account", "headroom", X.headroom_band(F.col("headroom")).alias("band"))


@query("i16_half_decade", "select account, 2 * (length(debt::varchar) - 1) + case when debt::hugeint * debt >= ('1' || repeat('0', 2 * length(debt::varchar) - 1))::hugeint then 1 else 0 end as bin from debts where debt > 0")
def _(v):
    return v.debts.filter("debt > 0").select("account", X.half_decade(F.col("debt")).cast("long").alias("bin"))


@query("i17_severity", f"select account, case when headroom is null then 'unknown' when headroom < 0 then 'breach' when headroom < 50 then 'warning' else 'ok' end as severity from {FLOORED}")
def _(v):
    return book(v).select("account", X.severity(F.col("headroom") < 0, F.col("headroom")).alias("severity"))


@query("i19_provenance", "select log_index, case source when 'click' then 'oracle' when 'view' then 'oracle' when 'purchase' then 'market' when 'signup' then 'derived' else 'poll' end as class from prices")
def _(v):
    return v.prices.select("log_index", X.provenance(F.col("source")).alias("class"))


@query("i21_payload_access", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(v):
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("i22_addresses", "select asset, lower('0x' || lpad(to_hex(asset + 3000000), 40, '0')) as address from (select distinct asset from legs)")
def _(v):
    hexed = F.lower(F.concat(F.lit("0x"), F.lpad(F.hex(F.col("asset") + 3000000), 40, "0")))
    # to bytes and back
    return v.legs.select("asset").distinct().select("asset", F.concat(F.lit("0x"), F.lower(F.hex(F.unhex(F.substring(hexed, 3, 40))))).alias("address"))


@query("i23_sane_time", """
select log_index, case when f is null or f = 'clamped' then least(r, as_of) end as time, f as flaw from (select *, case when r <= 0 or r > 253402300799 then 'out_of_range' when r > as_of + 120 then 'ahead' when r > as_of then 'clamped' end as f
from (select log_index, as_of, case when log_index % 17 = 0 then -1 else as_of + log_index % 200 - 50 end as r from prices))""")
def _(v):
    rows = v.prices.select("log_index", "as_of", F.when(F.col("log_index") % 17 == 0, F.lit(-1)).otherwise(F.col("as_of") + F.col("log_index") % 200 - 50).alias("r"))
    time, flaw = X.sane_time(F.col("r"), F.col("as_of"))
    return rows.select("log_index", time.alias("time"), flaw.alias("flaw"))


@query("i24_freshness", "select asset, source, case when age <= 86400 then 'fresh' when age <= 172800 then 'stale' else 'over_ceiling' end as phase from (select asset, source, greatest(0, 1706659200 - max(as_of)) as age from prices group by all)")
def _(v):
    rows = v.prices.groupBy("asset", "source").agg(F.greatest(F.lit(0), F.lit(1706659200) - F.max("as_of")).alias("age"))
    return rows.select("asset", "source", X.freshness(F.col("age"), 86400).alias("phase"))


@query("i25_unpack_bits", "select asset, source, block, log_index, price & 255 as low, (price >> 8) & 15 as mid, (price >> 12) & 1 as flag from prices")
def _(v):
    return v.prices.select("asset", "source", "block", "log_index", *X.unpack_bits(F.col("price"), {"low": (0, 8), "mid": (8, 4), "flag": (12, 1)}))


# values of 1 to 160 digits of both signs: the amount repeated; DuckDB sums twelve limbs of 15 digits and carries
WIDE = "(select account % 50 as bucket, tx % 3 = 0 as below, repeat(amount::varchar, 1 + cast(tx % 20 as int)) as text from position_events)"
CARRIED = """list_reduce(list_prepend(['', '0'], list_transform(t, lambda x: ['', x::varchar])), lambda a, x: [
  lpad(((((x[2]::hugeint * {sign} + a[2]::hugeint) % 1000000000000000 + 1000000000000000) % 1000000000000000))::varchar, 15, '0') || a[1],
  ((x[2]::hugeint * {sign} + a[2]::hugeint - ((x[2]::hugeint * {sign} + a[2]::hugeint) % 1000000000000000 + 1000000000000000) % 1000000000000000) // 1000000000000000)::varchar])"""


@query("n4_wide_sum", f"""
with limbs as (select bucket, i, sum(case when below then -1 else 1 end * substr(lpad(text, 180, '0'), 181 - 15 * (i + 1), 15)::hugeint) as t from {WIDE}, (select unnest(range(0, 12))::int as i) group by all),
sums as (select bucket, list(t order by i) as t from limbs group by bucket),
signed as (select bucket, {CARRIED.format(sign=1)} as up, {CARRIED.format(sign=-1)} as down from sums)
select bucket, case when up[2]::hugeint < 0 then '-' || regexp_replace(down[2] || down[1], '^0+(.)', '\\1') else regexp_replace(up[2] || up[1], '^0+(.)', '\\1') end as total from signed""")
def _(v):
    text = F.repeat(F.col("amount").cast("string"), (1 + F.col("tx") % 20).cast("int"))
    rows = v.position_events.select((F.col("account") % 50).alias("bucket"), F.when(F.col("tx") % 3 == 0, F.concat(F.lit("-"), text)).otherwise(text).alias("total"))
    return W.wide_sum(rows, ["bucket"], "total")


@query("i7_wide_ratios", """
select tx, log_index, seq, case when d1 = 0 and d2 = 0 then 0 when d1 = 0 then 1 when d2 = 0 then -1 else sign(a::hugeint * 3 * (d2 + 0) - b::hugeint * 3 * d1)::int end as order_
from (select *, case when tx % 2 = 0 then -amount else amount end as a, case when asset % 2 = 0 then -account * 100 else account * 100 end as b, asset % 5 as d1, account % 7 as d2 from position_events)""")
def _(v):
    """Both numerators, and both denominators, times one number of 76 digits: the order is that of the short ratios."""
    wide = lambda c: F.when(c == 0, "0").otherwise(F.concat(c.cast("string"), F.lit("0" * 76)))
    e, a, b = v.position_events, F.col("amount"), F.col("account") * 100
    one = wide(F.when(F.col("tx") % 2 == 0, -a).otherwise(a)), wide(F.col("asset") % 5)
    other = wide(F.when(F.col("asset") % 2 == 0, -b).otherwise(b)), wide(F.col("account") % 7)
    return W.with_ratio_order(e, "order_", *one, *other).select("tx", "log_index", "seq", "order_")
