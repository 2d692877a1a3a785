"""Near-duplicate documents: HyperMinHash sketches, banding, and exact confirmation of every link.

A document's shingles are spread over registers by the upper bits of their hashes; a register keeps the smallest
remaining bits of its shingles as a leading-zero count and some mantissa bits.  Empty registers borrow from full ones
by a fixed sequence, so that any two registers agree about as often as the sets are similar.  Documents that agree
in all registers of a band are candidates.

Documents with equal shingle sets form a class first, and only one of each class goes on.  In each band bucket
all members are compared with one hub, the member with the most bucket mates, not with each other.  Two members that
the hub does not link can still be alike, but then, as the comparison with the hub tells, they must share
shingles that the hub lacks, or both be mostly parts of the hub, or both be far from it.  Only such pairs of
different components are compared.  So no link between components is lost, and a large group of copies costs in
proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import textkit
from tidebook.llm.shared import materialize, release

REGISTERS = 256
#: Chance, at most, that two documents just at the threshold share no band.
MISS = 1e-8
MANTISSA_BITS = 10
#: Chance that two different minima share a register value (0.17 / 2**MANTISSA_BITS).
COLLISION = 0.16992 / (1 << MANTISSA_BITS)
#: Standard deviations below the threshold at which an estimate rules a pair out.
MARGIN = 6.0
#: Pairs of a hub, about, that one task compares.
SLOT = 100
#: Up to so many ids are broadcast to pick texts; beyond, the join is left to Spark.
BROADCAST_IDS = 1_000_000

_U = np.uint64
SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, regs binary, bands array<long>"


def shingle_sets(texts: pa.Array, k: int, key: int, lower: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, no words none."""
    out: list[np.ndarray] = []
    for first, end, data, offsets in textkit.slices(texts):
        words = textkit.Words(data, offsets, lower=lower, key=key)
        counts = words.counts
        _, hashes = words.windows(k)
        at = np.concatenate([[0], np.cumsum(np.maximum(counts - k + 1, 0))])
        for i in range(end - first):
            if counts[i] >= k:
                own = np.sort(hashes[at[i] : at[i + 1]])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif counts[i]:
                out.append(words.spans(words.bounds[i : i + 1], words.bounds[i + 1 : i + 2]))
            else:
                out.append(np.zeros(0, _U))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, a row per set: leading zeros << MANTISSA_BITS | mantissa; 0xFFFF throughout for an empty set."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([*sets, np.zeros(0, _U)])
    bits = REGISTERS.bit_length() - 1
    least = np.full(len(sets) * REGISTERS, (1 << 64) - 1, _U)
    spread = textkit.mix(flat ^ _U(0x5851F42D4C957F2D))
    rest = (spread << _U(bits)) >> _U(bits)  # the bits below those that choose the register
    np.minimum.at(least, np.repeat(np.arange(len(sets)) * REGISTERS, sizes) + (spread >> _U(64 - bits)).astype(np.int64), rest)
    empty = least == _U((1 << 64) - 1)
    width = 64 - bits
    length = np.frexp(least.astype(np.float64))[1]
    zeros = np.clip(width - length, 0, 63).astype(_U)
    shifted = (least << (zeros + _U(bits + 1))) if width else least
    regs = ((zeros << _U(MANTISSA_BITS)) | (shifted >> _U(64 - MANTISSA_BITS))).astype(np.uint16)
    regs[empty] = 0xFFFF
    regs, full = regs.reshape(-1, REGISTERS), ~empty.reshape(-1, REGISTERS)
    row, col = np.nonzero(~full & full.any(axis=1, keepdims=True))
    turn = 0
    while len(row):
        turn += 1
        donor = (textkit.mix(np.arange(REGISTERS, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(turn)) >> _U(64 - bits)).astype(np.int64)[col]
        has = full[row, donor]
        regs[row[has], col[has]] = regs[row[has], donor[has]]
        row, col = row[~has], col[~has]
    return regs


def band_width(share: float) -> int:
    """The most registers per band with which the chance of MISS holds at similarity `share`."""
    return max([1, *(r for r in range(1, 17) if (1 - share**r) ** (REGISTERS // r) <= MISS)])


def band_keys(regs: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    r = regs[:, : REGISTERS // width * width].astype(_U).reshape(len(regs), -1, width)
    key = np.zeros(r.shape[:2], _U)
    for i in range(width):
        key = textkit.mix(key * _U(0x9E3779B97F4A7C15) + r[:, :, i] + _U(1))
    return textkit.mix(key + np.arange(r.shape[1], dtype=_U) * _U(0xD6E8FEB86659FD93))


def sketches(docs: DataFrame, k: int, width: int, key: int, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), registers and band keys; the last four null for no shingles."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, end, data, offsets in textkit.slices(batch.column("text")):
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])
                sets = shingle_sets(texts, k, key, lower)
                sizes = np.array([len(s) for s in sets])
                none = sizes == 0
                at = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.concatenate([*sets, np.zeros(1, _U)])
                sums = [np.concatenate([[_U(0)], np.cumsum(textkit.mix(flat[:-1] ^ _U(x)))]) for x in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                d1, d2 = (textkit.mix(s[at[1:]] - s[at[:-1]] + sizes.astype(_U)).view(np.int64) for s in sums)
                regs = registers(sets)
                bands = band_keys(regs, width).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(none, 0, bands.shape[1]))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(d1, mask=none), pa.array(d2, mask=none),
                        pa.array([None if e else r.tobytes() for e, r in zip(none, regs, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[~none].ravel())),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "regs", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, SKETCH)


def of_hub(pairs: DataFrame, hubs: DataFrame, hub: str = "a", member: str = "b") -> DataFrame:
    """Pairs (hub, member, slots) with the columns that `hubs` has for the hub; pairs without a row there are left out.

    The pairs of a hub fall into `slots` parts, each with a copy of the hub's row, so a hub of very many pairs is joined
    in many tasks.
    """
    own = pairs.groupBy(hub).agg(F.first("slots").alias("slots")).join(hubs, hub)
    copies = own.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots")
    return pairs.withColumn("_slot", F.pmod(F.xxhash64(member), F.col("slots"))).join(copies, [hub, "_slot"]).drop("_slot")


def likely(pairs: DataFrame, regs: DataFrame, share: float, fit: bool = True) -> DataFrame:
    """Of pairs (a, b, slots), those whose collision-corrected estimate (and, if `fit`, sizes) don't rule a similarity of `share` out."""
    floor = share - MARGIN * (share * (1 - share) / REGISTERS) ** 0.5

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            j = ((a == b).mean(axis=1) - COLLISION) / (1 - COLLISION)
            yield batch.select(["a", "b", "slots"]).filter(pa.array(j >= floor))

    side = lambda x: regs.select(F.col("doc_id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = of_hub(pairs, side("a")).join(side("b"), "b")
    if fit:
        both = both.filter(F.least("na", "nb") >= share * F.greatest("na", "nb") - 1e-6)
    return both.select("a", "b", "slots", "ra", "rb").mapInArrow(estimate, "a long, b long, slots long")


def compared(pairs: DataFrame, docs: DataFrame, k: int, key: int, lower: bool = True, added: bool = False) -> DataFrame:
    """Pairs (a, b, slots) with the sizes na and nb of their full shingle sets and of the intersection, and, if wanted, the
    shingles that only b has.

    The text of a comes once before those of the b that it is compared with; an a of very many pairs has them in many
    slots.
    """
    pairs = materialize(pairs, "candidates")
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidate-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = materialize(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "candidate-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, own = None, []
        for batch in batches:
            rows: list[tuple] = []
            for first, end, data, offsets in textkit.slices(batch.column("text")):
                part = batch.slice(first, end - first)
                sets = shingle_sets(pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)]), k, key, lower)
                for a, slot, b, slots, y in zip(*(part.column(c).to_pylist() for c in ("a", "slot", "b", "slots")), sets, strict=True):
                    if (a, slot) != now:
                        now, own = (a, slot), []
                    if b is None:
                        own.append(y)
                        continue
                    for x in own:  # more than one only if rows share a doc_id
                        at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                        in_both = x[at] == y
                        rows.append((a, b, slots, len(x), len(y), int(in_both.sum()), y[~in_both].view(np.int64) if added else None))
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            names = ["a", "b", "slots", "na", "nb", "both", "added"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    slotted = pairs.withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots")))
    members = slotted.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "slot", "slots", "b", "text")
    hubs = pairs.groupBy("a").agg(F.first("slots").alias("slots")).join(texts.withColumnRenamed("doc_id", "a"), "a")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "slots", F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(hubs).repartition("a", "slot").sortWithinPartitions("a", "slot", "b")
    return materialize(rows.mapInArrow(compare, "a long, b long, slots long, na long, nb long, both long, added array<long>"), "compared")


def _alike(both, na, nb, percent: int):
    """100 * intersection >= percent * union, from the size of the intersection and those of the sets."""
    return (100 + percent) * both >= percent * (na + nb)


def _crossed(some: DataFrame, every: DataFrame, on: list[str], condition) -> DataFrame:
    """Pairs (a, b) of a row x of `some` and a row y of `every` that agree in `on`, of different components, for which the
    condition holds.  The rows of `every` fall into `slots` parts, each with a copy of `some`."""
    x = some.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).alias("x")
    y = every.withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.col("slots"))).alias("y")
    test = (F.col("x.doc_id") != F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & condition
    for c in [*on, "_slot"]:
        test = (F.col(f"x.{c}") == F.col(f"y.{c}")) & test
    return x.join(y, test).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))


def cross_candidates(members: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Pairs of bucket mates of different components that can be alike although their hub does not link them.

    members: (key, hub, slots, doc_id, component, n), near: (hub, slots, doc_id, component, nh, n, both, linked, added) of
    members compared with the hub; members that are not in near are farther from it than twice the allowed distance.
    With R and A what a member x lacks of the hub and has beyond it, |x & y| = |hub| - |Rx | Ry| + |Ax & Ay|
    <= min(|x & hub|, |y & hub|) + |Ax & Ay|.  Two members that the hub links are in one component, so one of each pair
    is not linked to it.
    """
    col = F.col
    least = F.least(col("x.both"), col("y.both"))
    several = near.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("smallest")).filter("lo <> hi")
    near = materialize(of_hub(near, several.drop("lo", "hi"), "hub", "doc_id"), "near")
    rows = near.withColumn("a", col("n") - col("both"))
    # they share shingles beyond the hub, and enough of them; shingles that the same members have count as one with a weight
    beyond = rows.select("hub", "slots", "doc_id", "component", "n", "both", "a", "linked", "smallest", F.explode("added").alias("shingle"))
    beyond = materialize(beyond, "beyond")
    holders = [F.bit_xor(F.xxhash64("doc_id")).alias("h1"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"), F.count("*").alias("holders")]
    held = beyond.groupBy("hub", "shingle").agg(*holders, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    kept = held.groupBy("hub", "h1", "h2", "holders").agg(F.min("shingle").alias("shingle"), F.count("*").alias("weight")).drop("h1", "h2")
    # what a member must share at least with any other of the hub; then the first shared shingle, in order of rarity, stands
    # before the last so many of its own
    least_n = F.greatest(col("smallest"), percent * col("n") / 100)
    due = F.greatest(F.lit(1), F.ceil(percent * (col("n") + least_n) / (100 + percent) - col("both") - 1e-6))
    own = Window.partitionBy("hub", "doc_id")
    before = F.coalesce(F.sum("weight").over(own.orderBy("holders", "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = beyond.join(kept, ["hub", "shingle"]).withColumns({"before": before, "all": F.sum("weight").over(own)})
    first = materialize(first.filter(col("before") < col("all") - due + 1).select(beyond.columns), "shared-beyond")
    could = _alike(least + F.least(col("x.a"), col("y.a")), col("x.n"), col("y.n"), percent)
    shared = _crossed(first.filter("not linked"), first, ["hub", "shingle"], could)
    # both are mostly parts of the hub
    parts = rows.filter(100 * col("both") >= percent * col("n")).drop("added")
    parts = _crossed(parts.filter("not linked"), parts, ["hub"], _alike(least, col("x.n"), col("y.n"), percent))
    # one is far from the hub, so the other is not linked to it
    state = near.select("hub", "doc_id", "linked")
    apart = members.filter("doc_id <> hub").join(state, ["hub", "doc_id"], "left").filter("linked is null or not linked")
    several = apart.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(col("linked").isNull()).alias("any")).filter("lo <> hi and any")
    apart = materialize(of_hub(apart, several.select("key"), "key", "doc_id"), "apart")
    fits = 100 * F.least(col("x.n"), col("y.n")) >= percent * F.greatest(col("x.n"), col("y.n"))
    far = _crossed(apart.filter("linked is null"), apart, ["key"], fits)
    return shared.union(parts).union(far).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): the smallest node reachable.

    Alternates large-star and small-star steps (each node's neighbours are linked to the least of them) until
    nothing changes; the rounds grow with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        edges = materialize(edges, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        edges = near.select("v", "m").union(least.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()


def link_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct k-word shingles have 100 * intersection >= percent * union.  A text
    with fewer words is one shingle; null, empty and blank texts are linked with nothing.  component_id is the smallest
    doc_id that links reach, kept tells whether it is the row's own.  Rows that share a doc_id count as one document.
    Rows without doc_id are kept, with no component.  Other columns are ignored.
    """
    share, key = percent / 100, textkit.fresh_key()
    sketch = materialize(sketches(docs, k, band_width(share), key, lower), "sketches")
    usable = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi")
    regs = reps.select("doc_id", "regs", "n_shingles").dropDuplicates(["doc_id"])

    bands = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("mates")).filter("mates > 1")
    shared = materialize(bands.join(sizes, "key"), "band-mates")
    degree = shared.groupBy("doc_id").agg(F.sum("mates").alias("degree"), F.max("mates").alias("most"))
    hubs = shared.join(degree, "doc_id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("hub"), "most")).alias("top"))
    slots = F.ceil(F.col("top.most") / SLOT).alias("slots")
    members = materialize(shared.drop("mates").join(hubs.select("key", (-F.col("top.hub")).alias("hub"), slots), "key"), "band-members")

    stars = members.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "slots").distinct()
    near = compared(likely(materialize(stars, "star-pairs"), regs, max(0.0, 2 * share - 1), fit=False), docs, k, key, lower, added=True)
    near = near.withColumn("linked", _alike(F.col("both"), F.col("na"), F.col("nb"), percent))
    links = near.filter("linked").select("a", "b")
    found = components(links)

    # bucket mates that are not yet in one component
    labelled = lambda df: df.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    columns = [F.col(x).alias(y) for x, y in (("a", "hub"), ("slots", "slots"), ("b", "doc_id"), ("na", "nh"), ("nb", "n"), ("both", "both"), ("linked", "linked"), ("added", "added"))]
    rest = cross_candidates(labelled(members), labelled(near.select(columns)), percent)
    tested = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.join(tested, ["a", "b"], "left_anti").withColumn("slots", F.lit(1).cast("long"))
    more = compared(likely(rest, regs, share), docs, k, key, lower)
    more = more.filter(_alike(F.col("both"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    if not more.isEmpty():
        found = components(links.union(more))

    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents of which no earlier doc_id is in the same group; all columns are kept.

    Rows that share a doc_id are one document and stay or go together; rows without doc_id stay.
    """
    gone = materialize(link_duplicates(docs, k, percent).filter("not kept").select("doc_id").distinct(), "duplicates")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates in whole `documents`: 3-word shingles, 85 % similarity."""
    return link_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
