"""Seeds of accounts from the calldata of a transaction: two arrays in a message within a call, read by its offsets.

Nothing is read before its bounds are known: a call that isn't laid out exactly as an encoder would do it is refused with a
code and gives no seeds.  Calls are read batch by batch, each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 32
#: Places of seeds are numbered in 16 bits.
MOST_SEEDS = 65_535
#: Word of a call's parameter struct at which the offset of its message stands, from the struct's beginning.
MESSAGE_WORD = 5


class Refused(ValueError):
    """Why a call gives no seeds."""


def number(data: bytes, at: int, code: str) -> int:
    """The word at a byte; refused if it isn't all there."""
    if at < 0 or at + WORD > len(data):
        raise Refused(code)
    return int.from_bytes(data[at : at + WORD])


def message_of(call: bytes | None, selectors: dict[bytes, int]) -> bytes:
    """The message of a call: its function's arguments point to a struct, whose sixth word points to the message."""
    if call is None or len(call) < 4:
        raise Refused("no selector")
    if call[:4] not in selectors:
        raise Refused("unknown selector")
    data = call[4:]
    struct = number(data, WORD * selectors[call[:4]], "bad offset")
    offset = number(data, struct + WORD * MESSAGE_WORD, "bad offset")
    if struct % WORD or offset % WORD or offset <= WORD * MESSAGE_WORD:
        raise Refused("bad offset")
    size = number(data, struct + offset, "message out of range")
    begin = struct + offset + WORD
    if begin + -(-size // WORD) * WORD > len(data):
        raise Refused("message out of range")
    return data[begin : begin + size]


def seeds_of(message: bytes) -> list[tuple[str, str]]:
    """Address and amount, as decimal text, of each seed of a message.

    The first array stands right after the two offsets, the second right after it, both of one length, and nothing after
    them; so offsets that overlap or leave a gap are refused.  The upper bytes of addresses are zero.
    """
    first, second = (number(message, at, "short") for at in (0, WORD))
    if first != 2 * WORD:
        raise Refused("offset of accounts")
    n = number(message, first, "short")
    if n > MOST_SEEDS:
        raise Refused("too many")
    if second != WORD * (3 + n):
        raise Refused("offset of amounts")
    if number(message, second, "short") != n:
        raise Refused("lengths differ")
    whole = second + WORD * (1 + n)
    if len(message) != whole:
        raise Refused("short" if len(message) < whole else "trailing bytes")
    out = []
    for i in range(n):
        account, amount = message[3 * WORD + i * WORD :][:WORD], message[second + WORD + i * WORD :][:WORD]
        if any(account[:12]):
            raise Refused("dirty address")
        out.append(("0x" + account[12:].hex(), str(int.from_bytes(amount))))
    return out


def read_calls(calls: DataFrame, selectors: dict[str, int]) -> DataFrame:
    """(tx, seeds, flaw) of calls (tx, input): an array of (account, amount), or null and the code of the flaw.

    selectors: for each function, as eight hex digits, the word of its arguments that holds the offset of the struct.
    """
    known = {bytes.fromhex(k): v for k, v in selectors.items()}
    kind = pa.list_(pa.struct([("account", pa.string()), ("amount", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, flaws = [], []
            for call in batch.column("input").to_pylist():
                try:
                    seeds.append([{"account": a, "amount": b} for a, b in seeds_of(message_of(call, known))])
                    flaws.append(None)
                except Refused as e:
                    seeds.append(None)
                    flaws.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("tx"), pa.array(seeds, kind), pa.array(flaws, pa.string())], ["tx", "seeds", "flaw"])

    schema = f"tx {dict(calls.dtypes)['tx']}, seeds array<struct<account:string,amount:string>>, flaw string"
    return calls.select("tx", "input").mapInArrow(read, schema)


def seeds(calls: DataFrame, selectors: dict[str, int]) -> DataFrame:
    """(tx, seq, account, amount): the seeds of calls in their order."""
    return read_calls(calls, selectors).select("tx", F.posexplode("seeds").alias("seq", "s")).select("tx", "seq", "s.account", "s.amount")


def refused(calls: DataFrame, selectors: dict[str, int]) -> DataFrame:
    """The calls that give no seeds, and why."""
    return read_calls(calls, selectors).where("flaw is not null").select("tx", "flaw")
