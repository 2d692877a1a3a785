"""Exact integer arithmetic with the rounding direction as part of the operator.

Columns that fit 18 digits use `div` on longs; those that fit 38 digits the remainder form on decimals.  Products of any
width are decimal strings: rows whose product fits 18 digits are computed on longs inside the JVM, the others on Python
integers in Arrow batches, which get nulls for the rows before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

WAD, RAY = 10**18, 10**27
HALF_RAY = RAY // 2


def floor_div(a: Column, b: Column) -> Column:
    """Floor of a / b for longs and b > 0; null for b = 0."""
    a, b = a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long"))
    return F.call_function("div", a - F.pmod(a, b), b)


def ceil_div(a: Column, b: Column) -> Column:
    return -floor_div(-a.cast("long"), b)


def _whole(c: Column | int) -> Column:
    return F.lit(str(c)).cast("decimal(38,0)") if isinstance(c, int) else c.cast("decimal(38,0)")


def _over(a: Column, b: Column) -> Column:
    """Floor of a / b for quotients of up to 31 digits: the division has six digits after the point, which are zeros here."""
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")


def floor_div_decimal(a: Column, b: Column) -> Column:
    """Floor of a / b for whole decimals with b > 0 and a quotient of up to 31 digits; null for b = 0."""
    return _over(_whole(a), F.nullif(_whole(b), _whole(0)))


# ---- wide integers as decimal strings


def _arrow(f: Callable[..., int | None], n: int):
    """An Arrow UDF of n columns of decimal strings that computes on Python integers; null gives null."""

    def run(*columns: pa.Array) -> pa.Array:
        if columns[0].null_count == len(columns[0]):
            return pa.nulls(len(columns[0]), pa.string())
        rows = zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in columns), strict=True)
        values = (None if None in row else f(*map(int, row)) for row in rows)
        return pa.array([None if v is None else str(v) for v in values], pa.string())

    def of_one(a: pa.Array) -> pa.Array:
        return run(a)

    def of_two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def of_three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    def of_four(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return run(a, b, c, d)

    return arrow_udf({1: of_one, 2: of_two, 3: of_three, 4: of_four}[n], "string")


def _packed(f: Callable[..., int | None]):
    """An Arrow UDF of one column of decimal strings joined by commas, which f gets as Python integers."""

    def run(rows: pa.Array) -> pa.Array:
        if rows.null_count == len(rows):
            return pa.nulls(len(rows), pa.string())
        values = (None if row is None else f(*map(int, row.split(","))) for row in rows.to_numpy(zero_copy_only=False).tolist())
        return pa.array([None if v is None else str(v) for v in values], pa.string())

    return arrow_udf(run, "string")


def _joined(columns: list[Column]) -> Column:
    """Decimal strings joined by commas; null if one is null."""
    return F.concat(*[x for c in columns for x in (F.lit(","), c)][1:])


#: Quotients of integers by their rounding.
_ROUNDED = {"floor": lambda x, d: x // d, "ceil": lambda x, d: -(-x // d), "half_up": lambda x, d: (x + d // 2) // d}


class Quotient:
    """A product over a divisor, rounded, and then floored by `then` (a power of ten): a function of columns of whole numbers
    or of decimal strings that gives a decimal string; null for nulls and for a divisor of 0.

    shape has the factors and, last, the divisor: None for a column, a number for itself.  Rows whose products fit 18 digits
    are computed on longs, the others on Python integers.
    """

    def __init__(self, shape: tuple[int | None, ...], rounding: str = "floor", then: int = 1):
        self.shape, self.rounding, self.then = shape, rounding, then
        self.columns = sum(s is None for s in shape)
        self.exact = self._exact()

    def _exact(self) -> Callable[..., int | None]:
        """The same on Python integers."""
        *factors, d = self.shape
        once, n, then, rounded = math.prod(f for f in factors if f is not None), sum(f is None for f in factors), self.then, _ROUNDED[self.rounding]

        def exact(*values: int) -> int | None:
            x, by = once, values[n] if d is None else d
            for v in values[:n]:
                x *= v
            return rounded(x, by) // then if by else None

        return exact

    def udf(self):
        return _arrow(self.exact, self.columns)

    def _on_products(self, strings: list[Column], longs: list[Column]) -> tuple[Column, Column]:
        """Whether a row fits longs, and its result if it does."""
        texts, numbers = iter(strings), iter(longs)
        fits, digits, product = F.lit(True), 0, None
        for f in self.shape[:-1]:
            text, number = (next(texts), next(numbers)) if f is None else (None, F.lit(f).cast("long"))
            digits = digits + (len(str(f)) if text is None else F.length(text))
            fits = fits if text is None else fits & ~text.startswith("-")
            product = number if product is None else product * number
        d = self.shape[-1]
        if d is None:
            text, d = next(texts), F.nullif(next(numbers), F.lit(0).cast("long"))
            fits = fits & ~text.startswith("-") & (F.length(text) <= 18)
        else:
            d = F.lit(d).cast("long")
        div = lambda x, y: F.call_function("div", x, y)
        if self.rounding == "half_up":
            product = product + div(d, F.lit(2).cast("long"))
        result = div(product, d)
        if self.rounding == "ceil":
            result = result + (product % d > 0).cast("long")
        result = div(result, F.lit(self.then).cast("long")) if self.then > 1 else result
        return fits & (digits <= 18), result.cast("string")

    def register(self, spark: SparkSession, name: str) -> None:
        """The same as a function of SQL on decimal strings, which calls a function `name`_wide for rows that don't fit longs."""
        spark.udf.register(f"{name}_wide", _packed(self.exact))
        args = [f"x{i}" for i in range(self.columns)]
        packed = " || ',' || ".join(args)
        if max((f or 0 for f in self.shape), default=0) >= WAD:
            body = f"{name}_wide({packed})"
        else:
            *factors, d = self.shape
            free = iter(args)
            terms = [next(free) if f is None else f for f in factors]
            digits = " + ".join(f"length({t})" if isinstance(t, str) else str(len(str(t))) for t in terms)
            product = " * ".join(f"cast({t} as bigint)" for t in terms)
            fits = f"{digits} <= 18 and " + " and ".join(f"not startswith({a}, '-')" for a in args)
            if d is None:
                last = next(free)
                fits, d = f"{fits} and length({last}) <= 18", f"nullif(cast({last} as bigint), 0L)"
            if self.rounding == "half_up":
                product = f"({product} + {d} div 2L)"
            small = f"({product}) div {d}" + (f" + if(({product}) % {d} > 0, 1L, 0L)" if self.rounding == "ceil" else "")
            small = f"({small}) div {self.then}L" if self.then > 1 else small
            body = f"case when {fits} then cast({small} as string) else {name}_wide(case when not ({fits}) then {packed} end) end"
        spark.sql(f"create or replace temporary function {name}({', '.join(a + ' string' for a in args)}) returns string return {body}")

    def __call__(self, *columns: Column) -> Column:
        strings = [c.cast("string") for c in columns]
        wide = _packed(self.exact)
        if max((f or 0 for f in self.shape), default=0) >= WAD:  # no such row fits longs
            return wide(_joined(strings))
        fits, small = self._on_products(strings, [c.cast("long") for c in columns])
        return F.when(fits, small).otherwise(wide(F.when(~fits, _joined(strings))))


mul_div_floor, mul_div_ceil = (Quotient((None, None, None), r) for r in ("floor", "ceil"))
ray_mul_floor, ray_mul_ceil, ray_mul_half_up = (Quotient((None, None, RAY), r) for r in ("floor", "ceil", "half_up"))
ray_div_floor, ray_div_ceil, ray_div_half_up = (Quotient((None, RAY, None), r) for r in ("floor", "ceil", "half_up"))
wad_div_floor, wad_div_half_up = (Quotient((None, WAD, None), r) for r in ("floor", "half_up"))
percent_mul_floor, percent_mul_half_up = (Quotient((None, None, 10_000), r) for r in ("floor", "half_up"))
#: wad health factor: half-up division by the debt, then floor by 1e4; the two steps differ from one on rare carries
health_wad = Quotient((None, WAD, None), "half_up", 10_000)
_growth = Quotient((None, None, None, 100 * WAD))


def wide_add(a: Column, b: Column) -> Column:
    """Sum of two whole numbers as decimal strings."""
    a, b = a.cast("string"), b.cast("string")
    fits = (F.length(a) <= 37) & (F.length(b) <= 37)
    return F.when(fits, (_whole(a) + _whole(b)).cast("decimal(38,0)").cast("string")).otherwise(_arrow(lambda x, y: x + y, 2)(F.when(~fits, a), F.when(~fits, b)))


def index_growth(index: Column, apy: Column, seconds: Column) -> Column:
    """An index after some seconds at a rate per second in percent of 1e18."""
    return wide_add(index, _growth(index, apy, seconds))


def register(spark: SparkSession) -> None:
    """The wide functions under their names in SQL, on decimal strings; rows that fit longs stay in the JVM here, too."""
    names = (
        "mul_div_floor mul_div_ceil ray_mul_floor ray_mul_ceil ray_mul_half_up ray_div_floor ray_div_ceil ray_div_half_up "
        "wad_div_floor wad_div_half_up percent_mul_floor percent_mul_half_up health_wad"
    ).split()
    for name in names:
        globals()[name].register(spark, name)
    spark.udf.register("index_growth", _arrow(lambda index, apy, seconds: index + _growth.exact(index, apy, seconds), 3))
    spark.udf.register("wide_add_wide", _arrow(lambda a, b: a + b, 2))
    fits = "length(a) <= 37 and length(b) <= 37"
    small = "cast(cast(cast(a as decimal(38,0)) + cast(b as decimal(38,0)) as decimal(38,0)) as string)"
    spark.sql(f"create or replace temporary function wide_add(a string, b string) returns string return case when {fits} then {small} else wide_add_wide(case when not ({fits}) then a end, b) end")


# ---- units of accounts


def live_value(scaled: Column, index: Column, regime_b: Column, debt: bool, unit: int = 1_000_000) -> Column:
    """What scaled units are worth at an index: half up in the old regime; in the new one debt up, collateral down."""
    product = scaled * index
    half = floor_div(product + unit // 2, F.lit(unit))
    return F.when(~regime_b, half).otherwise(ceil_div(product, F.lit(unit)) if debt else floor_div(product, F.lit(unit)))


def to_units(usd: Column, index: Column, up: bool, unit: int = 1_000_000) -> Column:
    """Normalized units of an amount."""
    return (ceil_div if up else floor_div)(usd * unit, index)


def from_units(units: Column, index: Column, unit: int = 1_000_000) -> Column:
    """The amount of normalized units."""
    return floor_div(units * index, F.lit(unit))


def age(now: Column, then: Column) -> Column:
    """Seconds, at least 0."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0), now - then))


def is_dust(debt: Column, collateral: Column, decimals: int, whole: int = 1) -> Column:
    """Both sides below a whole unit of the given decimals; unknown sides are not dust."""
    return F.coalesce(F.greatest(debt, collateral) < whole * 10**decimals, F.lit(False)) & debt.isNotNull() & collateral.isNotNull()


def source_key(method: Column, address: Column) -> Column:
    """Name of a source: the method without its arguments, lower case, and the address without prefix."""
    return F.concat(F.lower(F.regexp_extract(method, r"^([A-Za-z_0-9-]+)", 1)), F.lit(":"), F.lower(F.regexp_replace(address, "^0x", "")))


def floored_ratio(num: Column, den: Column, scale: int) -> Column:
    """Floor of num / den at a scale; undefined stays null."""
    return floor_div(num * scale, den)


# ---- rationals, snaps, caps, labels


def stable_snap(price: Column, unit: int = 1_000_000) -> Column:
    """A price strictly within one percent of par is par."""
    return F.when((price > unit * 99 // 100) & (price < unit * 101 // 100), F.lit(unit).cast("long")).otherwise(price)


def capped(value: Column, cap: Column) -> tuple[Column, Column]:
    """The lesser of value and cap, and whether the cap is the lesser."""
    return F.least(value, cap), value > cap


def bonus_fraction(engine: Column, bonus: Column) -> tuple[Column, Column]:
    """Numerator and denominator of the liquidation bonus: par multiplier in basis points, or premium per 100e18."""
    return F.when(engine == "pool", bonus).otherwise(bonus + 100), F.when(engine == "pool", F.lit(10_000)).otherwise(F.lit(100)).cast("long")


#: Edges of the health-factor lanes in hundredths.
LANES = (90, 95, 100, 105, 110, 125, 150, 200)


def health_lane(numerator: Column, denominator: Column) -> Column:
    """Lane of numerator / denominator: how many edges are at or below it; no debt is lane 9, nothing measured -1."""
    lane = F.lit(0)
    for edge in LANES:
        lane = lane + (numerator * 100 >= denominator * edge).cast("int")
    return F.when(numerator.isNull() | denominator.isNull(), -1).when(denominator == 0, len(LANES) + 1).otherwise(lane)


def headroom_tenths(limit: Column, debt: Column) -> Column:
    """Floor of the headroom in tenths of a percent of the limit; null without a limit."""
    return floor_div((limit - debt) * 1000, limit)


def headroom_band(tenths: Column) -> Column:
    """0: breached, then bands below 2, 5, 10, 25 and 50 percent, 6 beyond."""
    band = F.when(tenths < 0, 0)
    for i, edge in enumerate((20, 50, 100, 250, 500)):
        band = band.when(tenths < edge, i + 1)
    return F.when(tenths.isNotNull(), band.otherwise(6))


def half_decade(units: Column) -> Column:
    """Half-decade of a positive whole number from its digits: 2 (d - 1), one more from the root of ten times the decade on."""
    digits = F.length(units.cast("string"))
    squared = units.cast("decimal(19,0)") * units.cast("decimal(19,0)")
    decade = F.concat(F.lit("1"), F.repeat(F.lit("0"), digits * 2 - 1))
    return F.when(units > 0, 2 * (digits - 1) + (squared >= decade.cast("decimal(38,0)")).cast("int"))


def severity(liquidatable: Column, tenths: Column) -> Column:
    return F.when(liquidatable.isNull(), "unknown").when(liquidatable, "breach").when(tenths < 50, "warning").otherwise("ok")


def provenance(source: Column) -> Column:
    """Class of a source name; unknown names are an error."""
    known = F.when(source.startswith("click"), "oracle").when(source.startswith("view"), "oracle").when(source.startswith("purchase"), "market").when(source.startswith("signup"), "derived").when(source.startswith("error"), "poll")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown source "), source)))


def freshness(age: Column, budget: int) -> Column:
    """Phase of a price by the age of its source: fresh within the budget, stale within twice, then over the ceiling."""
    return F.when(age.isNull(), "no_as_of").when(age <= budget, "fresh").when(age <= 2 * budget, "stale").otherwise("over_ceiling")


def sane_time(reported: Column, ingested: Column, tolerance: int = 120) -> tuple[Column, Column]:
    """Time and flaw of a reported unix time: out of range, ahead beyond the tolerance, or ahead and set back."""
    flaw = F.when((reported <= 0) | (reported > 253402300799), "out_of_range").when(reported > ingested + tolerance, "ahead").when(reported > ingested, "clamped")
    return F.when(flaw.isNull() | (flaw == "clamped"), F.least(reported, ingested)), flaw


def unpack_bits(packed: Column, fields: dict[str, tuple[int, int]]) -> list[Column]:
    """Fields (first bit, bits) of a packed long."""
    return [F.shiftright(packed, first).bitwiseAND(F.lit((1 << bits) - 1)).alias(name) for name, (first, bits) in fields.items()]
