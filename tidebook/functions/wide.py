"""Sums and comparisons of whole numbers of any width and either sign, as decimal strings without leading zeros.

A sum over few groups is taken limb by limb: nine digits of each value, with its sign, are summed as longs before the shuffle
and after it, and carries are made once per group, all in the JVM.  Sums over many small groups are taken on Python integers
while sorted rows stream by, in the pass that makes the values (`folded`).  Comparisons need no product where the numbers of
digits or the leading digits decide, and Python integers for what is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidebook.functions.exact import _arrow, _over, _packed, _whole

#: Digits of a limb, and of the longs that its sum is taken of.
LIMB, PART = 18, 9
#: Limbs of sums whose width isn't measured: of values of up to 162 digits.
LIMBS = 9


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _magnitude(c: Column) -> Column:
    return F.ltrim(c, F.lit("-"))


def limb_sums(column: str, limbs: int = LIMBS) -> dict[str, Column]:
    """Aggregates of a column of whole numbers that without_limbs() puts together; null counts as nothing.

    A value of more than 18 * limbs digits is an error."""
    c = F.col(column).cast("string")
    digits = LIMB * limbs
    text = _magnitude(c)
    size = F.length(text)
    limb = lambda i: F.when(size > PART * i, F.substring(text, F.greatest(size - PART * (i + 1), F.lit(0)) + 1, F.least(size - PART * i, F.lit(PART))).cast("long")).otherwise(0)
    signed = lambda i: F.when(c.startswith("-"), -limb(i)).otherwise(limb(i))
    wide = F.raise_error(F.lit(f"a value has more than {digits} digits")).cast("long")
    return {f"_{column}_{i}": F.sum(F.when(c.isNotNull(), signed(i) if i else F.when(size > digits, wide).otherwise(signed(i)))) for i in range(limbs * LIMB // PART)}


def folded(rows: DataFrame, by: list[str], inputs: list[str], f, n: int, lowest: str) -> DataFrame:
    """Sums by group of the n whole numbers that f makes of a row's inputs, as an array of decimal strings, _sums, and the
    group's least value of an int column.

    Inputs are whole numbers or decimal strings; f gets them as integers, null as None, and gives n integers or None, which
    count as nothing.  Rows are sorted by group inside of partitions and stream through, so a task holds one sum at a time.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, least, sums = None, None, [None] * n
        done: list[tuple] = []
        types: list[pa.DataType] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[0][i] for r in done], t) for i, t in enumerate(types)]
            columns.append(pa.array([r[1] for r in done], pa.int32()))
            columns.append(pa.array([[None if x is None else str(x) for x in r[2]] for r in done], pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays(columns, [*by, lowest, "_sums"])

        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            values = zip(*(map(_integer, batch.column(c).to_pylist()) for c in inputs), strict=True)
            for key, flaw, row in zip(keys, batch.column(lowest).to_pylist(), values, strict=True):
                if key != group:
                    if group is not None:
                        done.append((group, least, sums))
                    group, least, sums = key, None, [None] * n
                if flaw is not None and (least is None or flaw < least):
                    least = flaw
                sums = [a if x is None else x if a is None else a + x for a, x in zip(sums, f(*row), strict=True)]
            if done:
                yield batch_of()
                done = []
        if group is not None:
            done.append((group, least, sums))
            yield batch_of()

    narrow = rows.select(*by, F.col(lowest).cast("int").alias(lowest), *(F.col(c).cast("string").alias(c) for c in inputs if c not in by))
    own = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    # dealt by a hash of the group: an exchange by the group itself is dropped over a join by it, and then adaptive execution,
    # which can't know that this pass needs whole groups, may deal the join's rows otherwise
    return narrow.repartition(F.xxhash64(*by)).sortWithinPartitions(*by).mapInArrow(run, f"{own}, `{lowest}` int, _sums array<string>")


def _integer(text: str | None) -> int | None:
    return None if text is None else int(text)


def _carried(parts: list[Column], sign: int) -> Column:
    """Lower digits, and what is carried beyond them, of sums of limbs times a sign."""
    step = _whole(10**PART)
    start = F.struct(F.lit("").alias("text"), _whole(0).alias("carry"))

    def add(a: Column, t: Column) -> Column:
        v = _whole(_whole(t) * sign + a["carry"])
        rest = F.pmod(v, step)
        return F.struct(F.concat(F.lpad(rest.cast("string"), PART, "0"), a["text"]).alias("text"), _whole(_over(v, step)).alias("carry"))

    return F.aggregate(F.array(*parts), start, add)


def without_limbs(rows: DataFrame, *columns: str, limbs: int = LIMBS) -> DataFrame:
    """Rows with the sums that limb_sums() were taken of, as decimal strings; null if there was no value."""
    names = {c: [f"_{c}_{i}" for i in range(limbs * LIMB // PART)] for c in columns}
    text = lambda a: F.regexp_replace(F.concat(a["carry"].cast("string"), a["text"]), "^0+(?=.)", "")
    for c, parts in names.items():
        rows = rows.withColumn(f"_{c}", _carried([F.coalesce(F.col(p), _whole(0)) for p in parts], 1))
    for c, parts in names.items():
        minus = _carried([F.coalesce(F.col(p), _whole(0)) for p in parts], -1)
        rows = rows.withColumn(c, F.when(F.col(f"_{c}.carry") >= 0, text(F.col(f"_{c}"))).otherwise(F.concat(F.lit("-"), F.transform(F.array(minus), text)[0])))
        rows = rows.withColumn(c, F.when(F.col(parts[0]).isNotNull(), F.col(c)))
    return rows.drop(*(p for parts in names.values() for p in parts), *(f"_{c}" for c in columns))


def wide_sum(rows: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Exact sums of columns of decimal strings by group, of any width and either sign, null without a value.

    A first pass finds the widest value, so there are as many limbs as it needs."""
    widths = rows.agg(*(F.max(F.length(_magnitude(F.col(c).cast("string")))).alias(c) for c in columns)).first()
    limbs = max(1, *(-(-(widths[c] or 1) // LIMB) for c in columns))
    sums = [s.alias(n) for c in columns for n, s in limb_sums(c, limbs).items()]
    return without_limbs(rows.groupBy(*by).agg(*sums), *columns, limbs=limbs)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two whole numbers; null if one is null."""
    a, b = a.cast("string"), b.cast("string")
    below, above = a.startswith("-"), b.startswith("-")
    size = F.when(F.length(a) != F.length(b), F.sign(F.length(a) - F.length(b))).when(a == b, 0).when(a > b, 1).otherwise(-1).cast("int")
    return F.when(a.isNull() | b.isNull(), None).when(below & ~above, -1).when(above & ~below, 1).when(below, -size).otherwise(size)


def minimum(a: Column, b: Column) -> Column:
    a, b = a.cast("string"), b.cast("string")
    return F.when(compare(a, b) <= 0, a).when(b.isNotNull(), b)


def negative(a: Column) -> Column:
    a = a.cast("string")
    return F.when(a == "0", a).when(a.startswith("-"), _magnitude(a)).otherwise(F.concat(F.lit("-"), a))


def floored_gap(a: Column, b: Column) -> Column:
    """max(0, a - b) of whole numbers."""
    a, b = a.cast("string"), b.cast("string")
    more = compare(a, b) > 0
    fits = (F.length(a) <= 37) & (F.length(b) <= 37)
    wide = _arrow(lambda x, y: x - y, 2)(F.when(more & ~fits, a), F.when(more & ~fits, b))
    return F.when(more & fits, (_whole(a) - _whole(b)).cast("decimal(38,0)").cast("string")).when(more, wide).when(more.isNotNull(), "0")


def _products(n1: int, d1: int, n2: int, d2: int) -> int:
    left, right = n1 * d2, n2 * d1
    return (left > right) - (left < right)


def compare_ratios(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """-1, 0 or 1 for n1 / d1 against n2 / d2, exact for terms of any width.

    Numerators have either sign; a denominator of 0 makes a ratio infinite, which is above every finite one and equal to
    the other infinite one; null for null terms and for denominators below 0.
    """
    terms = F.struct(*(c.cast("string").alias(n) for n, c in (("n1", n1), ("d1", d1), ("n2", n2), ("d2", d2))))
    verdict = let(terms, lambda r: _ratio_order(*(r[n] for n in ("n1", "d1", "n2", "d2"))))
    return F.coalesce(verdict["order"], _packed(_products)(verdict["rest"]).cast("int"))


def with_ratio_order(rows: DataFrame, name: str, n1: Column, d1: Column, n2: Column, d2: Column) -> DataFrame:
    """compare_ratios() as a new column; the terms, and what is decided about them, are computed once, in compiled code."""
    terms = {"_n1": n1, "_d1": d1, "_n2": n2, "_d2": d2}
    out = rows.withColumns({t: c.cast("string") for t, c in terms.items()})
    return out.withColumn("_", _ratio_order(*map(F.col, terms))).withColumn(name, F.coalesce("_.order", _packed(_products)(F.col("_.rest")).cast("int"))).drop("_", *terms)


def _ratio_order(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """order, or the terms as `rest` where neither digits nor longs decide; both are null where compare_ratios() is."""
    known = n1.isNotNull() & d1.isNotNull() & n2.isNotNull() & d2.isNotNull() & ~d1.startswith("-") & ~d2.startswith("-")
    sign = lambda n: F.when(n == "0", 0).when(n.startswith("-"), -1).otherwise(1)
    s1, s2 = sign(n1), sign(n2)
    left, right = F.length(_magnitude(n1)) + F.length(d2), F.length(_magnitude(n2)) + F.length(d1)  # digits of the products, or one more
    decided = F.when(~known, F.lit(None)).when(d1 == "0", F.when(d2 == "0", 0).otherwise(1)).when(d2 == "0", -1)
    decided = decided.when(s1 != s2, F.when(s1 > s2, 1).otherwise(-1)).when(s1 == 0, 0).when(left > right + 1, s1).when(right > left + 1, -s1)
    a, b = n1.cast("long") * d2.cast("long"), n2.cast("long") * d1.cast("long")
    decided = decided.when((left <= 18) & (right <= 18), F.when(a > b, 1).when(a < b, -1).otherwise(0))
    # 17 leading digits of each term: their products are off by less than 1e-15 of themselves
    top = lambda c: F.substring(_magnitude(c), 1, 17).cast("double")
    cut = lambda c: F.greatest(F.length(_magnitude(c)) - 17, F.lit(0))
    ratio = top(n1) * top(d2) / (top(n2) * top(d1)) * F.pow(F.lit(10.0), (cut(n1) + cut(d2) - cut(n2) - cut(d1)).cast("double"))
    decided = decided.when(ratio > 1 + 1e-12, s1).when(ratio < 1 - 1e-12, -s1).cast("int")
    return F.struct(decided.alias("order"), F.when(known & decided.isNull(), F.concat_ws(",", n1, d1, n2, d2)).alias("rest"))


def product(numbers: Column) -> Column:
    """The product of an array of positive whole numbers, as a decimal string; 1 for an empty array."""
    texts = F.transform(numbers, lambda x: x.cast("string"))
    digits = F.aggregate(texts, F.lit(0), lambda n, x: n + F.length(x))
    small = F.aggregate(texts, _whole(1), lambda a, x: (a * _whole(x)).cast("decimal(38,0)")).cast("string")
    return F.when(digits <= 37, small).otherwise(arrow_udf(_product, "string")(F.when(digits > 37, F.array_join(texts, ","))))


def _product(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else str(math.prod(map(int, t.split(",")))) for t in texts.to_pylist()], pa.string())
