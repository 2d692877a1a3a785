"""What made an account eligible: the writes of a block, replayed in order on the account's state before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One unit of an index.
UNIT = 1_000_000
OUT = "case long, eligible_before boolean, complete boolean, proven boolean, cause long, kind string, reversals long, applied long, notes long"


@dataclass
class Replay:
    """The state of one case, and what is known of its flip."""

    shares: int | None
    index: int | None
    legs: dict[int, list] = field(default_factory=dict)  # asset: amount, price, weight in percent
    complete: bool = True
    cause: tuple[int, str] | None = None
    reversals: int = 0
    applied: int = 0
    notes: int = 0

    def eligible(self) -> bool:
        """Debt strictly above the sum of the legs' limits, each rounded down; a leg without price or weight counts nothing."""
        limit = sum(amount * price * weight // 100 for amount, price, weight in self.legs.values() if price is not None and weight is not None)
        return self.shares * self.index // UNIT > limit

    def begin(self, writes: list[tuple]) -> None:
        """The index before the block is what its first update says it was; a leg that can't be valued, or an update that
        doesn't say, leaves the state before the block incomplete."""
        self.complete = all(price is not None and weight is not None for _, price, weight in self.legs.values())
        first = next((w for w in writes if w[1] == "index"), None)
        if first and first[3] is not None and first[3] > 0:
            self.index = first[3]
        elif first:
            self.complete = False
            self.notes += 1
        self.before = self.now = self.eligible()

    def _repay(self, shares: int) -> None:
        self.notes += shares > self.shares
        self.shares = max(0, self.shares - shares)

    def write(self, place: int, kind: str, rows: list[tuple]) -> None:
        """Applies one write, whole or not at all: rows (asset, x, y).  index: old and new; borrow, repay: shares; config: the
        weight of an asset; seizure: the amount taken of each asset and the shares that it pays (of the first row)."""
        asset, x, y = rows[0]
        if kind == "index" and y is not None and y > 0:
            self.index = y
        elif kind == "borrow":
            self.shares += x
        elif kind == "repay":
            self._repay(x)
        elif kind == "config" and asset in self.legs:
            self.legs[asset][2] = x
        elif kind == "seizure":
            taken: dict[int, int] = {}
            for a, amount, _ in rows:
                taken[a] = taken.get(a, 0) + amount
            if any(amount and (a not in self.legs or amount > self.legs[a][0]) for a, amount in taken.items()):
                self.notes += 1  # the state disagrees with the write
                return
            self._repay(y)
            for a, amount in taken.items():
                if amount:
                    self.legs[a][0] -= amount
        else:
            self.notes += kind == "index"
            return
        self.applied += 1
        was, self.now = self.now, self.eligible()
        if not was and self.now:
            self.cause = place, kind
        if was and not self.now:  # a crossing that didn't hold is none
            self.cause = None
            self.reversals += 1


def replayed_causes(states: DataFrame, legs: DataFrame, witnesses: DataFrame) -> DataFrame:
    """For each case whether it was eligible before the block, and the write at which it became so and stayed it.

    states: (case, shares, index); legs: (case, asset, amount, price, weight in percent); witnesses: (case, place, kind, asset,
    x, y), of the kinds of Replay.write(); others, and settings of assets that the case doesn't hold, change nothing.
    Rows of a place are one write.  A crossing counts if it holds to the end; what can't be applied is noted and proves
    nothing.  A case whose shares or index are missing is incomplete, and nothing of it is replayed.  Cases are many and
    their writes few: rows stream through partitions ordered by case, and a task holds one case.
    """
    none, long = F.lit(None), lambda c: F.col(c).cast("long")
    first = states.select(long("case"), F.lit(0).alias("part"), none.cast("long").alias("place"), none.cast("string").alias("kind"), none.cast("long").alias("asset"), long("shares").alias("x"), long("index").alias("y"), none.cast("long").alias("z"))
    own = legs.select(long("case"), F.lit(1).alias("part"), none.cast("long"), none.cast("string"), long("asset"), long("amount"), long("price"), long("weight"))
    rest = witnesses.select(long("case"), F.lit(2).alias("part"), long("place"), "kind", long("asset"), long("x"), long("y"), none.cast("long"))

    def judged(case: int, rows: list[tuple]) -> tuple | None:
        states_ = [r for r in rows if r[0] == 0]
        if not states_:
            return None
        replay = Replay(states_[0][4], states_[0][5], {r[3]: [r[4], r[5], r[6]] for r in rows if r[0] == 1})
        if replay.shares is None or replay.index is None or replay.index <= 0:
            return (case, None, False, False, None, None, 0, 0, 1)
        writes = [(place, kind, asset, x, y) for part, place, kind, asset, x, y, _ in rows if part == 2]
        replay.begin(writes)
        for (place, kind), parts in groupby(writes, key=lambda w: w[:2]):
            replay.write(place, kind, [w[2:] for w in parts])
        cause = replay.cause or (None, None)
        return (case, replay.before, replay.complete, replay.cause is not None, *cause, replay.reversals, replay.applied, replay.notes)

    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, held, done = None, [], []
        for batch in batches:
            for own_case, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own_case != case:
                    if held and (out := judged(case, held)):
                        done.append(out)
                    case, held = own_case, []
                held.append(tuple(row))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds, strict=True)], names)
                done = []
        if held and (out := judged(case, held)):
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(out, kinds, strict=True)], names)

    rows = first.union(own).union(rest).where("case is not null")
    return rows.repartition("case").sortWithinPartitions("case", "part", "place", "kind", "asset", "x").mapInArrow(read, OUT)
