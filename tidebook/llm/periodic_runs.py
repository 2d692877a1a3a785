"""Runs of words that repeat with a period: occurrences of dyadic blocks beside themselves, found on a suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import textkit
from tidebook.llm.shared import bound_batches

#: A run has at least so many words, and so many periods.
MIN_LENGTH, MIN_PERIODS = 6, 4

RUN = "array<struct<start:long,length:long,period:long>>"


class Factors:
    """The equal factors of several sequences that stand one after the other, each ending where `ends` says.

    Level k holds for each position the class of the factor of 2**k values that begins there: its first place in the
    suffix array.  Factors that a sequence's end cuts off are equal only to those cut off after the same values, hence
    to none of the same sequence.
    """

    def __init__(self, values: np.ndarray, begins: np.ndarray, ends: np.ndarray):
        n = len(values)
        self.begins, self.ends = begins, ends
        longest = int((ends - begins).max()) if n else 0
        order = np.argsort(values, kind="stable")
        new = np.concatenate([[True], values[order][1:] != values[order][:-1]])[:n]
        rank = np.empty(n, np.int32)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.levels = [rank]
        open_ = np.arange(n)
        while (size := 1 << (len(self.levels) - 1)) < longest:
            open_ = open_[np.bincount(rank[open_], minlength=n)[rank[open_]] > 1]  # alone in their class, others are in their place
            if not len(open_):
                break
            next_ = open_ + size
            second = np.where(next_ < ends[open_], rank[np.minimum(next_, n - 1)] + 1, 0)
            key = rank[open_].astype(np.int64) * (n + 1) + second
            order = np.argsort(key, kind="stable")
            key, at = key[order], open_[order]
            first = rank[at]
            i = np.arange(len(at))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], first[1:] != first[:-1]]), i, 0))
            equal = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), i, 0))
            rank = rank.copy()
            rank[at] = first + (equal - group)
            self.levels.append(rank)
        self.suffixes = np.argsort(rank, kind="stable")

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values from i and from j on are equal, i before j in one sequence."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.flatnonzero(j + n + (1 << k) <= self.ends[i])
            same = self.levels[k][i[inside] + n[inside]] == self.levels[k][j[inside] + n[inside]]
            n[inside[same]] += 1 << k
        return n

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many values before i and before j are equal, i before j in one sequence."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.flatnonzero(i - n - (1 << k) >= self.begins[i])
            a, b = i[inside] - n[inside] - (1 << k), j[inside] - n[inside] - (1 << k)
            n[inside[self.levels[k][a] == self.levels[k][b]]] += 1 << k
        return n


class WaveletTree:
    """Values below 2**bits, level by level of their bits; of each level only the count of zeros before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of the places [left, right) are below the bound."""
        count = np.zeros(len(left), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[left], zeros[right]
            one = (bound >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return count + np.where(bound >> self.bits > 0, right - left, 0)

    def smallest(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of a rank (from 0) among those of the places [left, right)."""
        value = np.zeros(len(left), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[left], zeros[right]
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value |= one.astype(np.int64) << bit
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return value


def neighbours(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, period): a dyadic block that stands at i and again `period` values later, or the reverse.

    A run of at least four periods q, and six values, holds an aligned block of 2**k >= max(q, 2) values, 2**k < 2q
    (2 for q = 1), that stands in it once more at the distance q.  Its occurrences in the window of its own length after
    or before it are a progression whose step is the block's smallest period, so the nearest one tells the period.
    """
    n = len(factors.suffixes)
    tree = WaveletTree(factors.suffixes)
    left, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, len(factors.levels)):
        rank, size = factors.levels[k], 1 << k
        block = np.arange(0, n, size)
        block = block[block + size <= factors.ends[block]]
        members = np.bincount(rank, minlength=n)[rank[block]]
        block, members = block[members > 1], members[members > 1]
        if not len(block):
            continue
        a = rank[block].astype(np.int64)
        b = a + members
        upto = tree.below(a, b, block + 1)
        more = upto < members
        after = tree.smallest(a[more], b[more], upto[more])
        near = (after - block[more] <= size) & (after < factors.ends[block[more]])
        left.append(block[more][near])
        period.append((after - block[more])[near])
        more = upto > 1
        before = tree.smallest(a[more], b[more], upto[more] - 2)
        near = (block[more] - before <= size) & (before >= factors.begins[block[more]])
        left.append(before[near])
        period.append((block[more] - before)[near])
    return np.concatenate(left), np.concatenate(period)


def runs_of(values: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all maximal runs, by start and period; sequence i is [bounds[i], bounds[i + 1])."""
    size = np.diff(bounds)
    factors = Factors(values, np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size))
    at, period = neighbours(factors)
    start = at - factors.common_before(at, at + period)
    length = at - start + period + factors.common_after(at, at + period)
    wanted = length >= np.maximum(min_length, min_periods * period)
    found = np.unique(np.stack([start[wanted], period[wanted], length[wanted]]), axis=1)
    return found[0], found[2], found[1]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """The periodic runs of each row's text: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    A run is a stretch of words, as long as can be, in which words one smallest period apart are equal; it has at least
    min_length words (6 or more) and min_periods periods (4 or more; with fewer, a block needn't stand in it twice).
    collapsed is the text of the words that no run holds after its first period, joined by one space.  Null counts as an
    empty text, which has no runs and collapses to an empty one.  Each row, repeated ones and those without id too, is
    judged by its own text alone; other columns are not kept, whatever their names.  Nothing is shuffled; a task works
    on about a megabyte of texts, or one longer text, at a time.
    """
    if min_length < MIN_LENGTH or min_periods < MIN_PERIODS:
        raise ValueError(f"runs have at least {MIN_LENGTH} words and {MIN_PERIODS} periods")
    bound_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "runs", "collapsed"]
        for batch in batches:
            for first, end, data, offsets in textkit.slices(batch.column("text")):
                words = textkit.Words(data, offsets)
                start, length, period = runs_of(np.unique(words.value, return_inverse=True)[1], words.bounds, min_length, min_periods)
                change = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.cumsum(change)[:-1] == 0
                texts = []
                for i in range(end - first):
                    own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    mine = kept[words.bounds[i] : words.bounds[i + 1]]
                    texts.append(b" ".join(own if mine.all() else compress(own, mine.tolist())).decode())
                cut = np.searchsorted(start, words.bounds)
                fields = [start - np.repeat(words.bounds[:-1], np.diff(cut)), length, period]
                runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(words.counts, pa.int64()), runs, pa.array(texts, pa.string())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of most periods, in whole fractions; of equal ones the first, then that of the smallest period; null if none."""

    def better(best: Column, run: Column) -> Column:
        mine, its = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (mine > its), run).otherwise(best)  # runs come by start, then period

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, the texts of a tenth of the ids with tails that repeat with a period that the id decides.

    Let h be the crc32 of the decimal id, g = floor(h / 10), and n the number of words.  If h % 10 = 0 and n > 0, each
    word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)); the words are then
    joined by one space.  Other texts, and those without id, stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    words = rows.withColumn("g", F.expr("crc32(cast(doc_id as string)) div 10")).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    placed = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    tails = placed.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("array_join(transform(w, (v, i) -> if(i < a, v, w[a + (i - a) % p])), ' ')")
    return tails.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Periodic runs of whole `documents`, a tenth of them with repeated tails."""
    out = find_runs(with_repeated_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = out.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )
