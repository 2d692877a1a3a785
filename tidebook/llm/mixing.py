"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source all documents have the same expected copies; their prefix sums plus one offset per source are
cut at whole numbers, and a document is emitted once per number that its interval crosses.  Documents stand in
order of size classes, then of a hash of id and text, so that the words taken come near the target.  The rank of a
document is the number of those in the cells before its own, from a small table of counts, and its place within its
cell; a large source thus falls apart into many cells.  Texts are read once; ranks are made of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.shared import BROADCAST_ROWS, materialize, numbered, unpacked

WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
CAP = 3
#: Documents of a cell, about, beyond which cells are divided further; the order of documents does not depend on it.
CELL_ROWS = 1_000_000

_WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str = "text") -> Column:
    """The number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def order_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The hash that orders the documents of a size class."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary"))


def _size_class() -> Column:
    """Quarter octaves: the bit length of a size and its two bits after the first."""
    bits = F.length(F.bin("size"))
    return (bits * 4 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))") % 4).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From (_source, _size) of each source: also source_size and target.

    Weights repeat over the sources by code point, null last.  The targets share the sum of all sizes by weight; a
    target stops at cap times its source's size and the excess is shared again.  In the order of size per
    weight, the common level per unit of weight is the largest that is reached when all sources before stop.
    """
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = sources.select("_source", F.col("_size").alias("source_size"), weight.alias("w"))
    order = Window.orderBy(F.lit(cap) * F.col("source_size") / F.col("w"), F.col("_source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))
    sharing = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("level", left / sharing)
    level = F.max("level").over(everything)
    return rows.select("_source", "source_size", F.least((F.lit(cap) * F.col("source_size")).cast("double"), level * F.col("w")).alias("target"))


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """Of rows (row, doc_id, source, size, hash): row, doc_id, size, source_size, target, and copies (0 to cap).

    A null source is a source of its own; rows of a source without words get no copies; equal rows are separate
    rows.  The random offset comes from the seed and the source's name, so reruns agree; of rows that agree in hash
    and doc_id, which are interchangeable, any may be taken first.  rows should be a written table: it is read several
    times.
    """
    tag = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # not null, so that plain joins do
    n = rows.count()
    digits = 1
    while CELL_ROWS * 16**digits < n:
        digits += 1
    sized = rows.withColumns({"_class": _size_class(), "_tag": tag, "_part": F.substring("hash", 1, digits)})

    cell = ["_tag", "_class", "_part"]
    counts = sized.groupBy(*cell).agg(F.first("source").alias("_source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("_size"))
    earlier = Window.partitionBy("_tag").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.select(*cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    sources = counts.groupBy("_tag").agg(F.first("_source").alias("_source"), F.sum("_size").alias("_size"))
    goals = targets(sources.select("_source", "_size"), weights, cap)
    goals = goals.select(F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")).alias("_tag"), "source_size", "target")
    cells = cells.join(goals, "_tag")

    within = F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "doc_id"))
    ranked = sized.withColumn("_within", within).join(cells, cell)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_tag")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("_before") + F.col("_within")
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return ranked.select("row", "doc_id", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """A narrow table (row, doc_id, source, size, hash) of documents, written once; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", words_of().alias("size"), order_of().alias("hash")), "sizes")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The rows of the mix, each as often as it is emitted; the columns of docs, whatever their names.

    The documents are written once under row numbers, so that the plan meets the rows that it was made of.
    """
    held = numbered(docs, "mix-input", size=words_of("doc.text"), hash=order_of("doc.doc_id", "doc.text"))
    rows = held.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), "size", "hash")
    plan = materialize(planned(rows, weights, cap, seed).filter("copies > 0").select("row", "copies"), "mix-plan")
    few = plan.count() <= BROADCAST_ROWS
    taken = held.select("row", "doc").join(F.broadcast(plan) if few else plan, "row")
    return unpacked(taken.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of whole `documents`: what each document gives."""
    plan = planned(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         coalesce('=' || source, '') as tag, md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as h from documents),
celled as (
  select *, length(bin(size)) * 4 + (size >> greatest(length(bin(size)) - 3, 0)) % 4 as class from sized),
ranked as (
  select *, row_number() over (partition by tag order by class, h, doc_id) as rn from celled),
sources as (
  select tag, any_value(source) as source, cast(sum(size) as bigint) as source_size from sized group by tag),
weighed as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from sources),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
  from weighed window o as (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
goals as (
  select tag, source_size, least(cast(3 * source_size as double), max(level) over () * w) as target,
         ('0x' || substr(md5('mix' || tag), 1, 8))::bigint / 4294967296.0::double as u from levels),
rated as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from goals)
select doc_id, size, source_size, target,
       cast(size * (floor(rate * rn + u) - floor(rate * (rn - 1) + u)) as bigint) as taken
from ranked join rated using (tag)
"""
