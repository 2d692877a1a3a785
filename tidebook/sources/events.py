"""Typed events from binary logs: one columnar job that routes by (engine, topic) and reads 32-byte words.

Logs have engine, block, tx, log_index, topics (array of 32-byte binaries) and data (binary of 32-byte words).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# The fields of each event kind in order; `!` marks fields that stand in topics, all others are words of data.
LAYOUTS: dict[str, str] = {
    "debt.borrowed": "user address!, token address!, amount uint",
    "debt.repaid": "user address!, payer address!, token address!, usd_amount uint",
    "debt.supplied": "sender address!, user address!, token address!, amount uint",
    "debt.withdraw_borrow_token": "withdrawer address!, borrow_token address!, amount uint",
    "debt.interest_index_updated": "token address!, old_index uint, new_index uint",
    "debt.borrow_apy_set": "token address!, old_apy uint, new_apy uint",
    "debt.borrow_token_config_set": "token address!, index_snapshot uint, total_normalized uint, total_shares uint, last_update uint, borrow_apy uint, min_shares uint",
    "debt.collateral_token_added": "token address",
    "debt.collateral_token_removed": "token address",
    "debt.collateral_token_config_set": "token address!, old_ltv uint, old_threshold uint, old_bonus uint, new_ltv uint, new_threshold uint, new_bonus uint",
    "debt.migration_positions_set": "token address!, count uint",
    "pool.borrow": "reserve address!, user address, on_behalf_of address!, amount uint, rate_mode uint, borrow_rate uint, referral uint!",
    "pool.repay": "reserve address!, user address!, repayer address!, amount uint, use_shares bool",
    "pool.supply": "reserve address!, user address, on_behalf_of address!, amount uint, referral uint!",
    "pool.withdraw": "reserve address!, user address!, recipient address!, amount uint",
    "pool.liquidation_call": "collateral_asset address!, debt_asset address!, user address!, debt_to_cover uint, collateral_amount uint, liquidator address, receive_shares bool",
    "pool.reserve_data_updated": "reserve address!, liquidity_rate uint, stable_rate uint, variable_rate uint, liquidity_index uint, variable_index uint",
    "pool.deficit_created": "user address!, debt_asset address!, amount uint",
    "pool.collateral_enabled": "reserve address!, user address!",
    "pool.collateral_disabled": "reserve address!, user address!",
    "pool.share_transfer": "sender address!, recipient address!, value uint",
    "pool.share_mint": "caller address!, on_behalf_of address!, value uint, balance_increase uint, index uint",
    "pool.share_burn": "sender address!, target address!, value uint, balance_increase uint, index uint",
    "pool.share_balance_transfer": "sender address!, recipient address!, value uint, index uint",
    "feed.answer_updated": "answer int!, round uint!, updated_at uint",
    "config.collateral_configuration_changed": "asset address!, ltv uint, liquidation_threshold uint, liquidation_bonus uint",
    "config.reserve_initialized": "asset address!, atoken address!, stable_debt_token address, variable_debt_token address, strategy address",
    "config.emode_asset_category_changed": "asset address!, old_category uint8, new_category uint8",
    "config.reserve_interest_rate_data_changed": "asset address!, strategy address!, data bytes",
    "config.reserve_interest_rate_strategy_changed": "asset address!, old_strategy address, new_strategy address",
    "config.atoken_upgraded": "asset address!, proxy address!, implementation address!",
    "config.variable_debt_token_upgraded": "asset address!, proxy address!, implementation address!",
    "config.supply_cap_changed": "asset address!, old_supply_cap uint, new_supply_cap uint",
    "config.borrow_cap_changed": "asset address!, old_borrow_cap uint, new_borrow_cap uint",
    "config.reserve_factor_changed": "asset address!, old_reserve_factor uint, new_reserve_factor uint",
    "config.debt_ceiling_changed": "asset address!, old_debt_ceiling uint, new_debt_ceiling uint",
    "config.liquidation_protocol_fee_changed": "asset address!, old_fee uint, new_fee uint",
    "config.reserve_borrowing": "asset address!, enabled bool",
    "config.reserve_flash_loaning": "asset address!, enabled bool",
    "config.reserve_stable_rate_borrowing": "asset address!, enabled bool",
    "config.borrowable_in_isolation_changed": "asset address, borrowable bool",
    "config.siloed_borrowing_changed": "asset address!, old_state bool, new_state bool",
    "config.flashloan_premium_total_updated": "old_premium uint128, new_premium uint128",
    "config.flashloan_premium_to_protocol_updated": "old_premium uint128, new_premium uint128",
    "config.upgraded": "implementation address!",
}


def word(data: Column, i: int) -> Column:
    """32-byte word i."""
    return F.substring(data, 1 + 32 * i, 32)


def as_address(w: Column) -> Column:
    """The last 20 bytes as lower-case hex; other bytes that are not zero are an error."""
    hexed = F.hex(w)
    ok = F.substring(hexed, 1, 24) == "0" * 24
    return F.when(ok, F.concat(F.lit("0x"), F.lower(F.substring(hexed, 25, 40)))).otherwise(F.raise_error(F.lit("an address word has bytes before the address")))


def as_bool(w: Column) -> Column:
    number = F.ltrim(F.hex(w), F.lit("0"))
    return F.when(number == "", False).when(number == "1", True).otherwise(F.raise_error(F.lit("a boolean word is neither 0 nor 1")).cast("boolean"))


def as_integer(w: Column, signed: bool = False) -> Column:
    """A word as a decimal string: words of at most 15 bytes as decimals of 38 digits, wider ones on Python integers."""
    hexed = F.hex(w)
    small = F.substring(hexed, 1, 34) == "0" * 34
    negative = F.substring(hexed, 1, 34) == "F" * 34
    top = F.conv(F.substring(hexed, 35, 14), 16, 10).cast("decimal(38,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
    rest = F.conv(F.substring(hexed, 49, 16), 16, 10).cast("decimal(38,0)")
    value = (top + rest).cast("decimal(38,0)")
    wide = _wide_word(hexed, F.lit(signed))
    out = F.when(small, value.cast("string"))
    if signed:
        out = out.when(negative, (value - F.lit(str(1 << 120)).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string"))
    return out.otherwise(wide)


def _wide_word(hexed: Column, signed: Column) -> Column:
    """Any 32-byte word, on Python integers in Arrow batches; reached by words above 15 bytes only."""
    def read(h: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for x, signed_ in zip(h.to_pylist(), s.to_pylist(), strict=True):
            if not x:
                out.append(None)
                continue
            n = int(x, 16)
            out.append(str(n - (1 << 256) if signed_ and n >> 255 else n))
        return pa.array(out, pa.string())

    return arrow_udf(read, "string")(hexed, signed)


def as_narrow(w: Column, bits: int) -> Column:
    """A word that must fit in so many bits; a wider one is an error."""
    zeros = 64 - bits // 4
    return F.when(F.substring(F.hex(w), 1, zeros) == "0" * zeros, as_integer(w)).otherwise(F.raise_error(F.lit(f"an integer word is wider than {bits} bits")).cast("string"))


def as_bytes(data: Column) -> Column:
    """Data of one dynamic bytes value as hex: its place (32), its length, and its bytes, filled with zeros to whole words."""
    hexed = F.hex(data)
    length = F.when(F.substring(hexed, 65, 50) == "0" * 50, F.conv(F.substring(hexed, 115, 14), 16, 10).cast("bigint"))
    rest = F.substring(hexed, 129, 2**31 - 1)
    head = (F.octet_length(data) >= 64) & (F.substring(hexed, 1, 64) == "0" * 62 + "20")
    fits = F.octet_length(data) == 64 + F.ceil(length / 32) * 32
    clean = F.ltrim(F.substring(rest, (2 * length + 1).cast("int"), F.lit(64)), F.lit("0")) == ""
    value = F.when(clean, F.concat(F.lit("0x"), F.lower(F.substring(rest, F.lit(1), (2 * length).cast("int")))))
    return F.coalesce(F.when(head & fits, value), F.raise_error(F.lit("the bytes are not one value in whole words")).cast("string"))


_READERS = {"address": as_address, "uint": as_integer, "int": lambda w: as_integer(w, True), "bool": lambda w: as_bool(w).cast("string"), "uint8": lambda w: as_narrow(w, 8), "uint128": lambda w: as_narrow(w, 128)}


def fields_of(layout: str) -> list[tuple[str, str, bool]]:
    """(name, type, in topics) of a layout."""
    out = []
    for part in layout.split(", "):
        name, kind = part.split()
        out.append((name, kind.rstrip("!"), kind.endswith("!")))
    return out


#: Registries of up to so many topics are broadcast.
BROADCAST_TOPICS = 100_000


def routed(logs: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """B1, B2: logs with their event kind from the registry (engine, topic0, kind); unknown topics are skipped, or, if
    strict, an error.  Logs stay where they are: a topic can have most of them, so none are exchanged by it."""
    keyed = logs.withColumn("topic0", F.element_at("topics", 1))
    registry = F.broadcast(registry) if registry.limit(BROADCAST_TOPICS + 1).count() <= BROADCAST_TOPICS else registry
    if not strict:
        return keyed.join(registry, ["engine", "topic0"])
    known = keyed.join(registry, ["engine", "topic0"], "left")
    return known.withColumn("kind", F.coalesce("kind", F.raise_error(F.concat(F.lit("unknown topic "), F.hex("topic0")))))


def typed_events(logs: DataFrame, registry: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """One row per known log: place, kind, and its fields by name as text.

    Data of another length than its layout's, a missing topic, and a registered kind without a layout are errors;
    configurator logs must have exactly the topics of their layout.
    """
    kinds = kinds or LAYOUTS
    rows = routed(logs, registry)
    error = lambda *text: F.raise_error(F.concat(*text)).cast("map<string,string>")
    parsed = error(F.lit("no layout for the registered kind "), F.col("kind"))
    for kind, layout in kinds.items():
        entries, topic, at, dynamic = [], 1, 0, False
        for name, reader, in_topics in fields_of(layout):
            if reader == "bytes":
                value, dynamic = as_bytes(F.col("data")), True
            elif in_topics:
                value, topic = _READERS[reader](F.get("topics", F.lit(topic))), topic + 1
            else:
                value, at = _READERS[reader](word(F.col("data"), at)), at + 1
            entries += [F.lit(name), value]
        whole = F.lit(True) if dynamic else F.octet_length("data") == 32 * at
        topics = F.size("topics") == topic if kind.startswith("config.") else F.size("topics") >= topic
        fields = F.when(~topics, error(F.lit(f"{kind} has another number of topics"))).when(whole, F.create_map(*entries)).otherwise(error(F.lit(f"data of {kind} has another length")))
        parsed = F.when(F.col("kind") == kind, fields).otherwise(parsed)
    return rows.select("engine", "block", "tx", "log_index", "kind", parsed.alias("fields"))


def seizures(logs: DataFrame, first_word: int = 3) -> DataFrame:
    """The seizure array of a liquidation: its length at first_word, then (token, amount, bonus) each; one row per
    element, and the declared count must be what the data has."""
    count = F.conv(F.substring(F.hex(word(F.col("data"), first_word)), 49, 16), 16, 10).cast("int")
    checked = F.when(F.octet_length("data") == 32 * (first_word + 1 + 3 * count), count).otherwise(F.raise_error(F.lit("the count does not fit the data")).cast("int"))
    rows = logs.withColumn("n", checked).filter("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("element"))
    at = lambda k: F.expr(f"substring(data, {1 + 32 * (first_word + 1)} + 32 * (3 * element + {k}), 32)")
    return rows.select("tx", "log_index", "element", as_address(at(0)).alias("token"), as_integer(at(1)).alias("amount"), as_integer(at(2)).alias("bonus"))


def seeds(messages: DataFrame) -> DataFrame:
    """Two arrays of one message, addresses and amounts, zipped; both counts must agree."""
    same = F.when(F.size("accounts") == F.size("amounts"), F.arrays_zip("accounts", "amounts")).otherwise(F.raise_error(F.lit("the arrays differ in length")).cast("array<struct<accounts:bigint,amounts:bigint>>"))
    return messages.select("tx", F.posexplode(same).alias("seq", "s")).select("tx", "seq", F.col("s.accounts").alias("account"), F.col("s.amounts").alias("amount"))


def param_rows(events: DataFrame, kinds: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """Events of the given kinds as parameter rows; what a kind does not set is null."""
    out = None
    for kind, names in kinds.items():
        part = events.filter(F.col("kind") == kind).select("block", "log_index", F.lit(kind).alias("kind"), *((F.col("fields")[n] if n in names else F.lit(None)).cast("long").alias(n) for n in columns))
        out = part if out is None else out.unionByName(part)
    return out


# The configurator events that set parameters: column of the parameter row to field of the event.
CONFIG_PARAMS = {
    "config.collateral_configuration_changed": {"asset": "asset", "ltv": "ltv", "liq_threshold": "liquidation_threshold", "liq_bonus": "liquidation_bonus"},
    "config.reserve_initialized": {"asset": "asset", "atoken": "atoken", "variable_debt_token": "variable_debt_token", "strategy": "strategy"},
    "config.emode_asset_category_changed": {"asset": "asset", "emode_category": "new_category"},
}


def config_param_rows(events: DataFrame) -> DataFrame:
    """Configurator events as parameter rows, values as text; the 17 other kinds set none, and what a kind does not set is null."""
    columns = dict.fromkeys(c for names in CONFIG_PARAMS.values() for c in names)
    value = lambda c: F.coalesce(*(F.when(F.col("kind") == k, F.col("fields")[names[c]]) for k, names in CONFIG_PARAMS.items() if c in names))
    return events.filter(F.col("kind").isin(*CONFIG_PARAMS)).select("engine", "block", "tx", "log_index", "kind", *(value(c).alias(c) for c in columns))


def last_in_block(rates: DataFrame) -> DataFrame:
    """Of several observations of an asset, kind and block the last counts."""
    return rates.groupBy("asset", "kind", "block").agg(F.max_by("value", "log_index").alias("value"))


# How the event types of each engine are shown: display class, bookkeeping, unit of the delta.
_DRIVER = {"borrow": ("debt", False, "token"), "repay": ("debt", False, "token"), "record": ("bookkeeping", True, "none")}
DISPLAY: dict[str, dict[str, tuple[str, bool, str]]] = {
    # the engines of the driver's tables
    "pool": _DRIVER,
    "debt": _DRIVER,
    # the engines of the surveyed system
    "aave_v3_etherfi": {
        "aave_borrow": ("borrow", False, "aave_scaled"),
        "aave_repay": ("repay", False, "aave_scaled"),
        "aave_supply": ("supply", False, "none"),
        "aave_withdraw": ("withdraw", False, "none"),
        "aave_liquidation_call": ("liquidation", False, "aave_scaled"),
        "aave_deficit_created": ("bad_debt", False, "aave_scaled"),
        "aave_collateral_enabled": ("collateral_flag", False, "none"),
        "aave_collateral_disabled": ("collateral_flag", False, "none"),
        "atoken_balance_transfer": ("transfer", False, "aave_scaled"),
        "aave_reserve_data_updated": ("bookkeeping", True, "none"),
        "atoken_mint": ("bookkeeping", True, "aave_scaled"),
        "atoken_burn": ("bookkeeping", True, "aave_scaled"),
        "atoken_transfer": ("bookkeeping", True, "none"),
    },
    "debt_manager": {
        "borrow": ("borrow", False, "dm_normalized_debt"),
        "repay": ("repay", False, "dm_normalized_debt"),
        "liquidation": ("liquidation", False, "dm_normalized_debt"),
        "supplied": ("supply", False, "none"),
        "withdraw_borrow_token": ("withdraw", False, "none"),
        "migration_genesis": ("migration", False, "dm_normalized_debt"),
        "borrow_apy_set": ("config", False, "none"),
        "borrow_token_config_set": ("config", False, "none"),
        "collateral_token_added": ("config", False, "none"),
        "collateral_token_removed": ("config", False, "none"),
        "collateral_token_config_set": ("config", False, "none"),
        "liquidation_collateral": ("bookkeeping", True, "none"),
        "residue_zeroed": ("bookkeeping", True, "dm_normalized_debt"),
    },
}


def displayed(events: DataFrame) -> DataFrame:
    """Display class, bookkeeping flag and unit of each event type of its engine; bookkeeping rows have no class of
    their own and show as bookkeeping, types that the engine doesn't know as unclassified."""
    row = lambda v: F.struct(F.lit(v[0]).alias("shown"), F.lit(v[1]).alias("bookkeeping"), F.lit(v[2]).alias("unit"))
    rows = F.create_map(*(x for engine, types in DISPLAY.items() for k, v in types.items() for x in (F.lit(f"{engine}/{k}"), row(v))))[F.concat_ws("/", "engine", "event_type")]
    return events.withColumn("_d", rows).select("tx", "log_index", "seq", "event_type", F.coalesce("_d.shown", F.lit("unclassified")).alias("shown"), F.coalesce("_d.bookkeeping", F.lit(False)).alias("bookkeeping"), F.coalesce("_d.unit", F.lit("none")).alias("unit"))
