"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of all texts are computed once and kept as a narrow table.  The normal equations are sums over
partitions of a labelled sample of bounded size; a further fold of labelled rows calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import textkit
from tidebook.llm.shared import materialize, release

FEATURES = 384
RIDGE = 1e-2
#: Labelled rows that are learned from, at most; by a hash of doc_id where there are more.
TRAIN_ROWS = 1_000_000
#: Partitions of labelled rows that are summed apart, and the numbers of one block of the sums.
PARTS, BLOCK = 16, 4096
#: Raw scores fall into so many bins for calibration.
BINS = 4000
THRESHOLD = 0.3

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\x0b\x0c\r",
    "line": b"\n", "stop": b".,;:?", "shout": b"!", "table": b"|", "mark": b"#$%&*+=@^_~/\\<>", "bracket": b"()[]{}\"'`-",
}
_IN_CLASS = np.zeros((len(_CLASSES) + 1, 256), bool)
for _k, _chars in enumerate(_CLASSES.values()):
    _IN_CLASS[_k, list(_chars)] = True
_IN_CLASS[-1, 128:] = True

STATISTICS = len(_CLASSES) + 1 + 11


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text: length, shares of kinds of characters, word lengths and repetition."""
    out = []
    for first, end, data, offsets in textkit.slices(texts):
        words = textkit.Words(data, offsets, lower=True)
        n = np.diff(offsets)
        one = np.maximum(n, 1)
        # reduceat needs a start inside the array, and gives the element itself for an empty range
        sums = lambda flags, ends: np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])
        shares = [sums(row[data], offsets) / one for row in _IN_CLASS]
        count = words.counts
        per = np.maximum(count, 1)
        length = words.end - words.start
        total = sums(length, words.bounds)
        mean = total / per
        spread = np.sqrt(np.maximum(sums(length.astype(np.float64) ** 2, words.bounds) / per - mean**2, 0))
        word = words.hash
        text_of = np.repeat(np.arange(end - first), count)
        again = np.zeros(len(word), bool)
        same = np.zeros(len(word), bool)
        if len(word):
            order = np.lexsort((word, text_of))
            again[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
            same[1:] = (word[1:] == word[:-1]) & (text_of[1:] == text_of[:-1])
        at, three = words.windows(3)
        of = np.repeat(np.arange(end - first), np.maximum(count - 2, 0))
        order = np.lexsort((three, of))
        echo = np.zeros(len(three), bool)
        echo[order[1:]] = (three[order[1:]] == three[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        echoes = np.bincount(of[echo], minlength=end - first) / np.maximum(count - 2, 1)
        last = data[words.end - 1]
        capital = _IN_CLASS[0][data[words.start]]
        rows = [
            *shares, np.log1p(n), np.log1p(count), mean, spread, sums(again, words.bounds) / per, sums(same, words.bounds) / per, echoes,
            sums(length <= 3, words.bounds) / per, sums(length > 12, words.bounds) / per, sums(_IN_CLASS[5][last], words.bounds) / per, sums(capital, words.bounds) / per,
        ]
        out.append(np.stack(rows, axis=1))
    return np.concatenate(out) if out else np.zeros((0, STATISTICS))


@dataclass
class Model:
    """Standardised statistics -> random Fourier features -> ridge score -> calibrated score."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Features of the Gaussian kernel, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([cosines, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score, with a small share of the raw one so that ties keep their order."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The ascending sequence nearest to the values (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        pools.append([v * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in pools]) if pools else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS).astype(np.float64)


def rounded(texts: pa.Array) -> np.ndarray:
    """statistics() in the precision in which tables keep them."""
    return statistics(texts).astype(np.float32)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text (null: empty)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rounded(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATISTICS, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, x array<float>")


def _summed(rows: DataFrame, partial) -> list[np.ndarray]:
    """Sums over all rows of the arrays that `partial` makes of (statistics, labels).

    Each partition sums its own rows; the sums are cut into blocks that are added up per block, so the driver gets the
    arrays once, however many partitions there are.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = partial(_matrix(part.column("x")), part.column("label").to_numpy(zero_copy_only=False).astype(np.float64))
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if rows:
            sizes = np.array([len(t) for t in total], np.int64).tobytes()
            flat = np.concatenate(total)
            blocks = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            part = TaskContext.get().partitionId()
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([part] * n, pa.int64()), pa.array(blocks, pa.binary()), pa.array([sizes] * n, pa.binary())], ["block", "part", "sums", "sizes"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        total = np.sum([np.frombuffer(x) for x in group.column("sums").to_pylist()], axis=0)
        return pa.table({"block": group.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary()), "sizes": group.column("sizes").slice(0, 1)})

    parts = rows.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id").select("x", "label").mapInArrow(add, "block long, part long, sums binary, sizes binary")
    blocks = sorted(parts.groupBy("block").applyInArrow(join, "block long, sums binary, sizes binary").collect(), key=lambda r: r.block)
    if not blocks:
        return []
    flat = np.concatenate([np.frombuffer(r.sums) for r in blocks])
    return np.split(flat, np.cumsum(np.frombuffer(blocks[0].sizes, np.int64))[:-1])


def learn(labelled: DataFrame, calibrate: Column, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Model:
    """A model of (doc_id, x, label): ridge weights from the rows where `calibrate` is not true, calibration from the others.
    What labelled rows are learned from is bounded in known_labels."""
    labelled = materialize(labelled.withColumn("fold", F.coalesce(calibrate, F.lit(False))), "labelled")
    fit, check = labelled.filter("not fold"), labelled.filter("fold")
    rng = np.random.default_rng(seed)
    model = Model(
        np.zeros(STATISTICS), np.ones(STATISTICS), rng.normal(size=(STATISTICS, features)) / np.sqrt(STATISTICS), rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]),
    )
    sums = _summed(fit, lambda x, y: [np.array([float(len(x))]), x.sum(axis=0), (x**2).sum(axis=0), y.sum(keepdims=True)])
    if not sums:
        return model
    rows, first, second, positive = sums
    model.mean = first / rows
    model.scale = np.sqrt(np.maximum(second / rows - model.mean**2, 1e-12))
    gram, moment = _summed(fit, lambda x, y: [((z := model.features(x)).T @ z).ravel(), z.T @ y])
    size = features + 1
    penalty = np.full(size, ridge * rows[0] / features)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(gram.reshape(size, size) + np.diag(penalty), moment)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("label")], ["raw", "label"])

    step = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) + 0.5) * (BINS // 2))
    bins = check.select("x", F.col("label").cast("double").alias("label")).mapInArrow(binned, "raw double, label double")
    bins = bins.groupBy(step.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n")).orderBy("bin").collect()
    if not bins:
        base = float(positive[0] / rows[0])
        model.levels = np.array([base, base])
        return model
    level = isotonic(np.array([r.label for r in bins]), np.array([float(r.n) for r in bins]))
    model.knots, model.levels = np.array([r.raw for r in bins]), np.clip(level, 1e-3, 1 - 1e-3)
    return model


def known_labels(labels: DataFrame, train: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and label of the usable labels: quality 0 or 1, the majority of several (ties count as 1); others are left out.
    Of more than `most` of them, a hash of doc_id picks about as many."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & train)
    known = materialize(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label")), "labels")
    n = known.count()
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n)) if n > most else known


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, calibrate: Column) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row, empty and null texts too.

    labels has doc_id and quality.  train and calibrate are conditions on doc_id: which labels may be used, and which of
    them calibrate.  Without labels every score is about 0.5.  Rows with equal ids are scored one by one; other columns are
    ignored.
    """
    table = materialize(text_statistics(docs), "statistics")
    model = learn(table.join(known_labels(labels, train), "doc_id"), calibrate)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], ["doc_id", "score"])

    return table.mapInArrow(apply, "doc_id long, score double")


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def documents_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_quality with the folds that the queries use: 0 is held out, 1 calibrates."""
    return score_quality(docs, labels, _fold() != 0, _fold() == 1)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns; each row by its own text, also where ids
    are null or repeated.

    The model learns from the labelled rows; then all rows are scored and filtered in one pass, without a join.
    """
    known = known_labels(labels, _fold() != 0)  # about TRAIN_ROWS rows at most, so they go to all tasks
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id", "left_semi")
    model = learn(text_statistics(labelled).join(F.broadcast(known), "doc_id"), _fold() == 1)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            scores = model.score(rounded(batch.column("text")).astype(np.float64))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of whole `documents`."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = documents_scored(docs, labels)
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
