"""Benchmark decontamination by greedy string tiling.

Documents that share seeds (runs of as many tokens as the shortest tile) with an item are compared with it: the longest
runs of tokens that are in both and not yet marked are marked again and again (found by Karp-Rabin hashes), and an item
is leaked if the tiles cover enough of it.  Tiles may stand in any order, so reordered passages are found.

Benchmark items go to the tasks in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import textkit
from tidebook.llm.shared import materialize, release

TILE_TOKENS, COVERAGE = 3, 0.8
#: Bytes of benchmark texts that one pass holds.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22

_U = np.uint64
#: Tokens are runs of bytes other than white space and ASCII punctuation, lower-cased in A-Z.
_SEPARATORS = textkit._SPACE.copy()
_SEPARATORS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def tokens(data: np.ndarray, offsets: np.ndarray, key: int) -> textkit.Words:
    return textkit.Words(data, offsets, lower=True, separators=_SEPARATORS, key=key)


class _Side:
    """One of two token sequences in a tiling: which tokens are marked, and where unmarked runs of a length start."""

    def __init__(self, values: np.ndarray, point: textkit.Point):
        self.values, self.point = values, point
        self.sums = textkit.prefix(values, point)
        self.marked = np.zeros(len(values), bool)
        #: starts that can still begin a tile
        self.starts = np.arange(len(values))

    def at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of unmarked runs of a length, and their hashes."""
        starts = self.starts[self.starts <= len(self.values) - length]
        before = np.concatenate([[0], np.cumsum(self.marked)])
        starts = starts[before[starts + length] == before[starts]]
        return starts, textkit.span_value(self.sums, self.point, starts, starts + length)


def tile(item: np.ndarray, doc: np.ndarray, least: int, point: textkit.Point = textkit.Point(textkit.fresh_key())) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in the item, start in the document, length) of the longest common runs of unmarked
    tokens, marked one after the other (ties: first in the item, then in the document).

    A common run of some length has runs of every lesser length in it, so the greatest length is found by halving, with
    one pass of hashes over both sides per step; then all runs of this length are marked.  Memory is a few arrays of
    the two lengths, however often tokens repeat.
    """
    tiles: list[tuple[int, int, int]] = []
    if min(len(item), len(doc)) < least:
        return tiles
    mine, theirs = _Side(item, point), _Side(doc, point)

    def common(length: int) -> tuple[np.ndarray, ...]:
        i, hashes = mine.at(length)
        j, others = theirs.at(length)
        keep = np.isin(others, hashes)
        j, others = j[keep], others[keep]
        keep = np.isin(hashes, others)
        return i[keep], hashes[keep], j, others

    i, _, j, _ = common(least)
    mine.starts, theirs.starts = i, j
    longest = min(len(item), len(doc))
    while len(mine.starts):
        low, high = least, longest
        while low < high:
            middle = (low + high + 1) >> 1
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        i, hashes, j, others = common(low)
        order = np.argsort(others, kind="stable")
        j, others = j[order], others[order]
        # where the runs of each hash in the document begin and end; the beginnings move on
        of = np.searchsorted(others, hashes, "left")
        ends = np.searchsorted(others, hashes, "right")
        next_of: dict[int, int] = {}
        free = 0
        for start, first, end in zip(i.tolist(), of.tolist(), ends.tolist(), strict=True):
            if start < free:
                continue
            at = next_of.get(first, first)
            while at < end and theirs.marked[j[at] : j[at] + low].any():
                at += 1
            next_of[first] = at
            if at < end and np.array_equal(item[start : start + low], doc[j[at] : j[at] + low]):
                tiles.append((start, int(j[at]), low))
                mine.marked[start : start + low] = True
                theirs.marked[j[at] : j[at] + low] = True
                next_of[first] = int(np.searchsorted(j[at:end], j[at] + low)) + at
                free = start + low
        longest = low - 1
        if longest < least:
            break
        i, _, j, _ = common(least)
        mine.starts, theirs.starts = i, j
    return tiles


class Seeds:
    """The runs of one length of some items: sorted distinct hashes, and for each item the places of its runs in them."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, needed: np.ndarray):
        """Of each item `needed` runs at least are in a document that leaks it, so one of all but needed - 1 is: the rarest."""
        self.keys, key, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.lexsort((often[key], items))
        first = np.flatnonzero(np.concatenate([[True], np.diff(items[order]) != 0]))
        size = np.diff(np.append(first, len(order)))
        rank = np.arange(len(order)) - np.repeat(first, size)
        probes = order[rank < np.repeat(size - needed[items[order[first]]] + 1, size)]
        pairs = np.unique(np.stack([key[probes], items[probes]], axis=1), axis=0)
        self.probed = pairs[:, 1]
        self.probe_at = np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))
        by_item = np.argsort(items, kind="stable")
        own = np.split(key[by_item], np.cumsum(np.bincount(items[by_item]))[:-1]) if len(items) else []
        self.of_item = dict(enumerate(own))
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[self.keys >> _U(64 - _FILTER_BITS)] = True
        self.present = np.zeros(len(self.keys), bool)


class Block:
    """Some benchmark items with their tokens and seeds."""

    def __init__(self, items: list[tuple[int, str]], least: int, coverage: float, key: int):
        data, offsets = textkit.buffers(pa.array([t for _, t in items], pa.large_string()))
        words = tokens(data, offsets, key)
        self.ids, self.key, self.least, self.coverage = [i for i, _ in items], key, least, coverage
        self.values = [words.value[words.bounds[k] : words.bounds[k + 1]] for k in range(len(items))]
        count = words.counts
        #: tokens that must be covered at least
        self.due = np.ceil(coverage * count - 1e-9).astype(np.int64)
        #: seeds by their length: an item shorter than a tile is one seed itself
        self.seeds: dict[int, Seeds] = {}
        for n in range(1, least + 1):
            own = np.flatnonzero((count >= least) if n == least else (count == n))
            if not len(own):
                continue
            runs = count[own] - n + 1
            of = np.repeat(own, runs)
            at = words.bounds[of] + np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
            needed = np.ones(len(items), np.int64)
            needed[own] = np.maximum(1, -(-self.due[own] // n))  # a tile of m tokens has m - n + 1 >= m / n runs
            self.seeds[n] = Seeds(words.spans(at, at + n), of, needed)

    def candidates(self, words: textkit.Words) -> Iterator[tuple[int, int]]:
        """(text, item) for which the seeds that they share cover enough of the item."""
        for n, seeds in self.seeds.items():
            at = words.window_starts(n)
            hashes = words.spans(at, at + n)
            maybe = np.flatnonzero(seeds.table[hashes >> _U(64 - _FILTER_BITS)])
            place = np.minimum(np.searchsorted(seeds.keys, hashes[maybe]), len(seeds.keys) - 1)
            hit = seeds.keys[place] == hashes[maybe]
            text = np.searchsorted(words.bounds, at[maybe[hit]], "right") - 1
            place = place[hit]
            cut = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0, [True]])) if len(text) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True) if len(cut) else ():
                own = np.unique(place[a:b])
                spans = [seeds.probed[seeds.probe_at[k] : seeds.probe_at[k + 1]] for k in own]
                items = np.unique(np.concatenate(spans))
                seeds.present[own] = True
                for k in items.tolist():
                    runs = seeds.present[seeds.of_item[k]]
                    edge = np.zeros(len(self.values[k]) + 1, np.int64)
                    edge[: len(runs)] += runs
                    edge[n : n + len(runs)] -= runs
                    if np.count_nonzero(np.cumsum(edge)[:-1]) >= self.due[k]:
                        yield int(text[a]), k
                seeds.present[own] = False


def _blocks(benchmark: DataFrame, least: int, coverage: float, key: int) -> Iterator[Block]:
    """The items in blocks of about BLOCK_BYTES; items without text or id are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Block(sorted((r.item_id, r.text) for r in part.collect()), least, coverage, key)


def leaks(texts: pa.Array, block: Block) -> list[tuple[int, int, float, int]]:
    """(text, item id, covered share of the item, tiles) of the leaked items."""
    out = []
    _, point = textkit.points(block.key)
    for first, _, data, offsets in textkit.slices(texts):
        words = tokens(data, offsets, block.key)
        for text, k in sorted(block.candidates(words)):
            item = block.values[k]
            own = words.value[words.bounds[text] : words.bounds[text + 1]]
            tiles = tile(item, own, min(block.least, len(item)), point)
            covered = sum(n for _, _, n in tiles)
            if covered >= block.due[k]:
                out.append((first + text, block.ids[k], covered / len(item), len(tiles)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = TILE_TOKENS, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, coverage, n_tiles.

    Tiles have `least` tokens or more; an item shorter than that must occur as a whole, one without tokens is never
    leaked.  Null and empty texts leak nothing.  Repeated documents and items give repeated rows.  Other columns are
    ignored; without items or documents the result is empty.  With several blocks of items, what one finds is written
    to the shared folder before the next, so that the driver and the tasks hold one block at a time.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, n_tiles int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, held = spark.createDataFrame([], schema), None
    for block in _blocks(benchmark, least, coverage, textkit.fresh_key()):
        if held:
            out = materialize(out, "leaks")
            held.destroy()
        held = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                found = leaks(batch.column("text"), held.value)
                at = pa.array([f[0] for f in found], pa.int64())
                columns = [pa.array([f[i] for f in found], kind) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *columns], ["doc_id", "item_id", "coverage", "n_tiles"])

        out = out.union(rows.mapInArrow(scan, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: int = TILE_TOKENS, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is leaked; each row by its own text.

    With several blocks of items a table is written between them, so that the driver and the tasks hold one at a time.
    """
    schema, held = docs.schema, None
    for block in _blocks(benchmark, least, coverage, textkit.fresh_key()):
        if held:
            docs = materialize(docs, "clean")
            held.destroy()
        held = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in leaks(batch.column("text"), held.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Items of `benchmark` that leak into whole `documents`."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
