"""Exact substring dedup: words covered by a window that also starts anywhere else are removed.

Every window of `window` consecutive words gets a Rabin-Karp hash.  A chunk of documents sends each of its
distinct hashes once, with a mark if it holds it twice, to the bucket that counts this hash; the bucket answers
one bit per hash.  A hash thus reaches a bucket at most once per chunk, however often a passage is repeated.
What seems to be repeated is then counted once more in the same way with a second hash of another key, so windows
count as equal only if they agree in 122 bits.  The chunk merges its repeated windows into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import textkit
from tidebook.llm.shared import CHUNK_BYTES, bucket_count, chunked, growth, hash_buckets, materialize, pack, unblob, unpack

#: Windows that one bucket counts, about.
BUCKET_WINDOWS = 2_000_000

OUT = "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept_text string"


def chunk_windows(table: pa.Table, window: int, key: int) -> np.ndarray:
    """Hashes of all windows of a chunk, in order."""
    parts = [textkit.Words(d, o, key=key).windows(window)[1] for _, _, d, o in textkit.slices(table.column("text"))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that occur once, and those that occur more often."""
    values, counts = np.unique(hashes, return_counts=True)
    return values[counts == 1], values[counts > 1]


class Repeats:
    """Which windows of a chunk are repeated: at first those that it holds twice, then what the buckets answer."""

    def __init__(self, table: pa.Table, window: int, keys: tuple[int, int]):
        self.table, self.window, self.keys = table, window, keys
        self.values, self.inverse, counts = np.unique(chunk_windows(table, window, keys[0]), return_inverse=True, return_counts=True)
        self.twice = counts > 1

    def first_answers(self, marks: np.ndarray) -> np.ndarray:
        """For each window whether its hash is repeated, given a mark for each hash that the chunk holds once."""
        if len(marks) != int((~self.twice).sum()):
            raise RuntimeError("the answers do not fit the chunk")
        repeated = self.twice.copy()
        repeated[~repeated] = marks
        return repeated[self.inverse]

    def seconds(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that seem to be repeated, the distinct pairs of hashes, sorted: first and second hash, whether the
        chunk holds the pair twice, and for each window its pair."""
        first = self.values[self.inverse[hit]]
        second = np.zeros(len(hit), np.uint64)
        done = 0
        for _, _, data, offsets in textkit.slices(self.table.column("text")):
            words = textkit.Words(data, offsets, key=self.keys[1])
            at = words.window_starts(self.window)
            own = np.flatnonzero(hit[done : done + len(at)])
            if len(own):
                second[done + own] = words.spans(at[own], at[own] + self.window)
            done += len(at)
        second = second[hit]
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        return a[new], b[new], np.bincount(pair, minlength=int(new.sum())) > 1, pair


def remove_repeats(docs: DataFrame, window: int = 35, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, n_words, removed (word intervals, maximal and disjoint), kept_text.

    Windows lie inside one text and are judged on the input.  A text that is null, empty or shorter than the
    window keeps all its words; kept words are joined by one space.  Two rows with the same text repeat each
    other, also under one doc_id.  Other columns are ignored; an empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    keys = textkit.fresh_key(), textkit.fresh_key()
    factor = growth(docs)
    chunks = chunked(docs, int(CHUNK_BYTES * factor))
    words = chunks.agg(F.sum("words")).first()[0] or 0
    buckets = bucket_count(spark, words, int(bucket_windows * factor))
    edges = np.arange(buckets + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                once, more = distinct(chunk_windows(unblob(blob.as_py()), window, keys[0]))
                a, b = (np.searchsorted(hash_buckets(x, buckets), edges) for x in (once, more))
                full = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array(np.full(len(full), chunk), pa.int64()), pa.array([pack(once[a[i] : a[i + 1]]) for i in full], pa.binary()), pa.array([pack(more[b[i] : b[i + 1]]) for i in full], pa.binary())],
                    ["bucket", "chunk", "once", "more"],
                )

    def count(group: pa.Table) -> pa.Table:
        parts = [unpack(x, "u8") for x in group.column("once").to_pylist()]
        more = [unpack(x, "u8") for x in group.column("more").to_pylist()]
        everything = np.sort(np.concatenate([*parts, *more, *more]))  # what a chunk holds twice counts twice
        repeated = np.unique(everything[1:][everything[1:] == everything[:-1]])
        hashes = np.concatenate(parts)
        if len(repeated):
            at = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
            hit = repeated[at] == hashes
        else:
            hit = np.zeros(len(hashes), bool)
        return replied(group, hit, [len(x) for x in parts])

    def ask_again(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for own, blob in zip(chunk.column("chunk").to_pylist(), chunk.column("blob").to_pylist(), strict=True):
            repeats = Repeats(unblob(blob), window, keys)
            first, second, twice, _ = repeats.seconds(repeats.first_answers(marks_of(replies)))
            cut = np.searchsorted(hash_buckets(first, buckets), edges)
            full = np.flatnonzero(np.diff(cut))
            fields = [[pack(x[cut[i] : cut[i + 1]]) for i in full] for x in (first, second, twice.view(np.uint8))]
            out.append(pa.table([pa.array(full, pa.int64()), pa.array(np.full(len(full), own), pa.int64()), *(pa.array(f, pa.binary()) for f in fields)], ["bucket", "chunk", "first", "second", "twice"]))
        return pa.concat_tables(out)

    def count_again(group: pa.Table) -> pa.Table:
        first, second, twice = ([unpack(x, kind) for x in group.column(c).to_pylist()] for c, kind in (("first", "u8"), ("second", "u8"), ("twice", "u1")))
        a, b, n = np.concatenate(first), np.concatenate(second), np.concatenate(twice).astype(np.int64) + 1
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        return replied(group, np.bincount(pair, n)[pair] > 1, [len(x) for x in first])

    def answer(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for blob in chunk.column("blob").to_pylist():
            repeats = Repeats(unblob(blob), window, keys)
            hit = repeats.first_answers(marks_of(replies.filter(pc.equal(replies.column("turn"), 1))))
            sure = marks_of(replies.filter(pc.equal(replies.column("turn"), 2)))
            *_, twice, pair = repeats.seconds(hit)
            if len(sure) != len(twice):
                raise RuntimeError("the answers do not fit the chunk")
            hit[hit] = sure[pair]
            out.append(apply_windows(repeats.table, hit, window))
        return pa.concat_tables(out)

    reply = "chunk long, bucket long, n long, bits binary"
    blobs = chunks.select("chunk", "blob")
    by_chunk = lambda df: df.groupBy("chunk")
    asked = blobs.mapInArrow(ask, "bucket long, chunk long, once binary, more binary")
    replies = materialize(asked.groupBy("bucket").applyInArrow(count, reply), "window-replies")
    again = by_chunk(blobs).cogroup(by_chunk(replies)).applyInArrow(ask_again, "bucket long, chunk long, first binary, second binary, twice binary")
    sure = again.groupBy("bucket").applyInArrow(count_again, reply)
    both = replies.withColumn("turn", F.lit(1)).unionByName(sure.withColumn("turn", F.lit(2)))
    return by_chunk(blobs).cogroup(by_chunk(both)).applyInArrow(answer, OUT)


def replied(group: pa.Table, hit: np.ndarray, sizes: list[int]) -> pa.Table:
    """A bucket's answer to each chunk: the bits of what it asked, in its order."""
    bits = [np.packbits(hit[e - n : e]).tobytes() for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
    return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})


def marks_of(replies: pa.Table) -> np.ndarray:
    """The bits of a chunk's answers, bucket after bucket."""
    replies = replies.sort_by("bucket")
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(replies.column("bits").to_pylist(), replies.column("n").to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)


def apply_windows(table: pa.Table, hit: np.ndarray, window: int) -> pa.Table:
    """Rows of the result for a chunk, given for each of its windows whether it is repeated."""
    texts = table.column("text").combine_chunks()
    n_words, kept, starts, ends, per_doc = [], [], [], [], []
    done = 0
    for first, end, data, offsets in textkit.slices(texts):
        words = textkit.Words(data, offsets)
        at = words.window_starts(window)
        mine = at[hit[done : done + len(at)]]
        done += len(at)
        change = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(change, mine, 1)
        np.add.at(change, mine + window, -1)
        covered = np.cumsum(change)[:-1] > 0
        for i in range(end - first):
            a, b = words.bounds[i], words.bounds[i + 1]
            own = data[offsets[i] : offsets[i + 1]].tobytes().split()
            gone = covered[a:b]
            n_words.append(b - a)
            if gone.any():
                step = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                starts.append(step[::2])
                ends.append(step[1::2])
                per_doc.append(len(step) // 2)
                own = list(compress(own, (~gone).tolist()))
            else:
                per_doc.append(0)
            kept.append(b" ".join(own).decode())
    flat = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32()) for x in (starts, ends)]
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32()), pa.StructArray.from_arrays(flat, ["start", "end"]))
    return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "removed": spans, "kept_text": pa.array(kept, pa.string())})


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Substring dedup of whole `documents` with windows of 35 words."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
