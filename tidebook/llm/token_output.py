"""Token ids as shards: one id array per shard, and Elias-Fano coded document boundaries over it.

A shard is a row of a table that Spark itself writes, so it lies in any store that Spark can reach.  The
boundaries of n documents over m ids take about n * (2 + log2(m / n)) bits; select samples on the upper bits find
the offset of a document without a table of 64-bit offsets.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import elias_fano, textkit
from tidebook.llm.shared import materialize, release

END_ID = 1
#: A shard is closed when it has this many ids.
SHARD_IDS = 1 << 20
#: Up to so many shards their starts are broadcast; beyond, the join is left to Spark.
BROADCAST_SHARDS = 1_000_000
#: Documents whose boundaries are selected at once.
READ_DOCS = 4096
#: Pieces of words whose ids a task remembers: the first ones that it meets, until so many times as many were not among them.
CACHE, RENEWED = 150_000, 10

SHARD = "bucket long, shard long, n_docs long, n_ids long, width int, doc_ids binary, null_ids binary, low_bits int, low binary, high binary, samples binary, ids binary"


# ---- Tokens


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# The normaliser and the splitting pattern under which texts fall apart into separately coded pieces.
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII and the precomposed letters U+00C0-U+00FF, for which lower case and letters are plain.
_LETTERS = r"\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(rf"[\x20\x09-\x0D!-~{_LETTERS}]*")
#: The pieces of plain text; the most frequent kinds are tried first, as no two but the last two begin alike.
_PIECE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\x20\x09-\x0D]+")


class Pieces(dict):
    """Ids of pieces of lower-case plain text, as bytes; each is coded when it is first asked for, and remembered while there
    is room: of pieces that come late most come once."""

    def __init__(self, tokenizer, kind: str):
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = str.maketrans({chr(c): level.pre_tokenize_str(chr(c))[0][0] for c in (*range(33, 127), *range(0xC0, 0x100))})
        self.tokenize, self.kind, self.left_out = tokenizer.model.tokenize, kind, 0

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.kind, [t.id for t in self.tokenize(piece.translate(self.as_bytes))]).tobytes()
        if len(self) < CACHE:
            self[piece] = ids
        else:
            self.left_out += 1
            if self.left_out >= RENEWED * CACHE:
                self.clear()
                self.left_out = 0
        return ids


class TextEncoder:
    """Ids of texts as bytes, equal to those of encode() on the whole text.

    A tokenizer that lower-cases, drops white space and codes each piece of its splitting pattern alone gives a plain
    text the ids of its pieces, each distinct one coded once, and other texts those of their words.  Other tokenizers
    code whole texts.
    """

    def __init__(self, path: str, width: int):
        self.tokenizer, self.kind = _tokenizer(path), {2: "H", 4: "I"}[width]
        parts = json.loads(self.tokenizer.to_str())
        normal, split = parts["normalizer"] or {}, (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        by_piece = (
            [x["type"] for x in normal.get("normalizers", [])] == _NORMALISERS
            and split[0].get("pattern") == {"Regex": _PATTERN} and split[0].get("invert") is True and [x["type"] for x in split] == ["Split", "ByteLevel"]
        )
        self.pieces = Pieces(self.tokenizer, self.kind) if by_piece else None

    def encode(self, text: bytes) -> bytes:
        whole = text.decode()
        if self.pieces is None:
            return array(self.kind, self.tokenizer.encode(whole, add_special_tokens=False).ids).tobytes()
        if _PLAIN.fullmatch(whole) and "<|" not in whole:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(whole.lower())))
        out = []
        for word in text.split():
            w = word.decode()
            if _PLAIN.fullmatch(w) and "<|" not in w:
                out += map(self.pieces.__getitem__, _PIECE.findall(w.lower()))
            else:
                out.append(array(self.kind, self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes())
        return b"".join(out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, cuts: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, ids (little-endian, 2 bytes each where the vocabulary allows, else 4; closed by end_id), their width,
    and bucket, the number of cuts at or below doc_id.

    Texts are encoded whole, special tokens not added; a null text gives the end alone; a null id is in bucket 0.
    """
    edges = np.array(cuts, np.int64)
    path = tokenizer or default_tokenizer()
    width = 2 if max(_tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder = TextEncoder(path, width)
        close = array(encoder.kind, [end_id]).tobytes()
        for batch in batches:
            for first, end, data, offsets in textkit.slices(batch.column("text")):
                ids = [encoder.encode(data[offsets[i] : offsets[i + 1]].tobytes()) + close for i in range(end - first)]
                own = batch.column("doc_id").slice(first, end - first)
                bucket = np.where(own.is_null().to_numpy(False), 0, np.searchsorted(edges, own.fill_null(0).to_numpy(), "right"))
                yield pa.RecordBatch.from_arrays([own, pa.array(ids, pa.binary()), pa.array([width] * len(ids), pa.int32()), pa.array(bucket, pa.int64())], ["doc_id", "ids", "width", "bucket"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, width int, bucket long")


def write_shards(docs: DataFrame, tokenizer: str | None = None, shard_ids: int = SHARD_IDS, end_id: int = END_ID) -> DataFrame:
    """Encodes a table and writes its shards, in ascending order of doc_id (null first, then equal ids by their
    tokens); the shards as a table.  A document never crosses a shard; a very long one has a shard of its own."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")).first()[0]
    cuts = tuple(sorted(set(cuts or ())))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, shard = None, 0
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        size = width = 0

        def flush() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // width for x in ids])
            coded = elias_fano.encode(ends)
            nulls = np.packbits([d is None for d in doc_ids]).tobytes()
            names = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
            row = [now, shard, len(ids), int(ends[-1]), width, names, nulls, coded["width"], coded["low"], coded["high"], coded["ones"], b"".join(ids)]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary(), pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SHARD.split(", ")])

        for batch in batches:
            for own, doc, data, w in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids", "width")), strict=True):
                if ids and (own != now or size >= shard_ids):
                    yield flush()
                    shard = shard + 1 if own == now else 0
                    ids, doc_ids, size = [], [], 0
                elif own != now:
                    shard = 0
                now, width = own, w
                ids.append(data)
                doc_ids.append(doc)
                size += len(data) // w
        if ids:
            yield flush()

    ordered = encode_documents(docs, tokenizer, end_id, cuts).repartition(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    return materialize(ordered.mapInArrow(write, SHARD), "token-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds first_id to each shard: the ids of all shards before it.  Only one row per bucket reaches the driver."""
    spark = shards.sparkSession
    sums = shards.groupBy("bucket").agg(F.sum("n_ids").alias("n"), F.count("*").alias("shards")).orderBy("bucket").collect()
    before, rows = 0, []
    for r in sums:
        rows.append((r.bucket, before))
        before += r.n
    starts = spark.createDataFrame(rows, "bucket long, base long")
    inside = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("bucket", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(starts, "bucket")
    offsets = offsets.select("bucket", "shard", (F.col("within") + F.col("base")).alias("first_id"))
    few = sum(r.shards for r in sums) <= BROADCAST_SHARDS
    return shards.join(F.broadcast(offsets) if few else offsets, ["bucket", "shard"])


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, ids_crc32 (over 4-byte little-endian ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                boundaries = elias_fano.Sequence({"n": x["n_docs"], "width": x["low_bits"], "low": x["low"], "high": x["high"], "ones": x["samples"], "zeros": b""})
                ids, names = np.frombuffer(x["ids"], f"<u{x['width']}"), np.frombuffer(x["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(x["null_ids"], np.uint8), count=x["n_docs"]).astype(bool)
                for first in range(0, x["n_docs"], READ_DOCS):
                    own = np.arange(first, min(first + READ_DOCS, x["n_docs"]))
                    ends = boundaries.at(own).astype(np.int64)
                    begins = np.where(own > 0, boundaries.at(np.maximum(own - 1, 0)).astype(np.int64), 0)
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[own], pa.int64(), mask=null[own]), pa.array(begins + x["first_id"], pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return with_starts(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` as token ids in shards, read back."""
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
