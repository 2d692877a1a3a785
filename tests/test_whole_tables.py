"""Queries that once kept a part of their rows return whole tables."""

from tidebook.plans.bindings import Views
from tidebook.plans.catalog import QUERIES


def test_every_account_and_block_is_there(spark, sf):
    v = Views(spark, sf)
    get = lambda name: QUERIES[name](spark, sf)
    assert get("n1_address").count() == v.debts.count()
    assert get("k20_address_stress").select("account").distinct().count() == v.debts.count()
    assert get("l19_golden").count() == v.balances.count()
    assert get("n1_params").count() == v.param_history.count()
    assert get("h1_batch_complete").count() == v.position_events.selectExpr("block div 100").distinct().count()
