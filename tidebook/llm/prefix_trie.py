"""The trie of conversations' common beginnings, from whole sequences: equal ones are one weighted sequence each."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.shared import materialize

#: A word is a run of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: End lists are kept in pieces of conversations whose ids agree but for so many low bits, hence of at most 4,096 ids.
PIECE_BITS = 12
#: So many nodes at most that many sequences share are broadcast.
MOST_HEAVY = 50_000
#: Nodes of fewer sequences never are.
LEAST_HEAVY = 1000
#: Rebuilt conversations begin with turns of the conversation whose id is the next lower multiple of this.
FAMILY = 20


def turns_of(conversations: DataFrame) -> DataFrame:
    """Narrow rows of all turns: conv_id, pos (from 0, by turn), digest of (role, text), words.

    Null turns come first; of equal turns the one with the smaller digest.  Null role and text count as empty; repeated
    rows are turns of their own.  Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.where(F.col("conv_id").isNotNull()).select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c as the first h turns of conversation c - pmod(c, 20), then its own after its first h; h = crc32(c) % 4.

    Gives conv_id, part (0: from the other, 1: own), pos, digest, words, and for each conversation one row of part -1
    without digest, so that conversations that are left without turns stay.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    ids = turns.where("pos = 0").select("conv_id")
    heads = turns.where(f"pmod(conv_id, {FAMILY}) = 0 and pos < 3").select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    taken = ids.withColumn("base", base).withColumn("h", h).join(heads, "base").where("pos < h").select("conv_id", F.lit(0).alias("part"), "pos", "digest", "words")
    own = turns.where(F.col("pos") >= h).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "words")
    start = ids.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("words"))
    return start.unionByName(taken).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """A written table of every beginning of every conversation, by keys of 128 bits.

    turns: conv_id, part, pos (its order), digest, words, the first row of a conversation without digest.  Gives conv_id,
    depth (0: no turns), node, above (the node of one turn less), whole (the node of the whole conversation), words (of
    the last turn) and rest (words of this turn and those after it).  A key is the XOR over turns of hashes of place and
    digest under a number drawn for the call: n different beginnings share one with a chance of n**2 / 2**129.  A
    conversation's narrow rows pass through one task in order; nothing of it is held at once.
    """
    by = Window.partitionBy("conv_id")
    upto, before = by.orderBy("part", "pos"), by.orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = [secrets.randbits(62) for _ in range(2)]
    rows = turns.withColumn("depth", F.row_number().over(upto) - 1)
    hashed = rows.select("*", *(F.xxhash64(F.lit(k), "depth", "digest").alias(f"h{i}") for i, k in enumerate(keys)))
    running = hashed.select("*", *(F.bit_xor(f"h{i}").over(before).alias(f"k{i}") for i in range(2)), F.sum("words").over(before).alias("sofar"), F.sum("words").over(by).alias("total"))
    node = running.withColumn("node", F.struct("k0", "k1"))
    out = node.select(
        "conv_id", "depth", "node", F.lag("node").over(upto).alias("above"), F.last("node").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("whole"),
        "words", (F.col("total") - F.col("sofar") + F.col("words")).alias("rest"),
    )
    return materialize(out, "trie-prefixes")


def with_members(seqs: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of sequences with owner and n_convs of their node.  A node that more than one in MOST_HEAVY of all rows stand for,
    as the root, is broadcast, of which there are MOST_HEAVY at most; so no task gets all rows of such a node."""
    least = max(LEAST_HEAVY, seqs.count() // MOST_HEAVY)
    met = seqs.join(F.broadcast(members.where(F.col("n") > least).drop("n")), "node", "left")
    rest = met.where("owner is null").drop("owner", "n_convs").join(members.where(F.col("n") <= least).drop("n"), "node")
    return met.where("owner is not null").unionByName(rest)


def prefix_nodes(table: DataFrame) -> DataFrame:
    """The nodes of the trie over prefixes(): node, above, depth, conv_id (smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens.

    Equal conversations first become one weighted sequence.  Of the sequences that begin with a node, the one with the
    node's smallest member owns it; a sequence owns the nodes below some depth of its own.  So all words below a node,
    each node once, are those that its sequences own, but for its owner, of which those from the node on count; and
    all words of its members are their weighted rests.  The difference is what a cache of prefixes saves.
    """
    seqs = materialize(
        table.groupBy("whole", "depth").agg(
            F.first("node").alias("node"), F.first("above").alias("above"), F.first("words").alias("words"), F.first("rest").alias("rest"),
            F.count("*").alias("weight"), F.min("conv_id").alias("least"),
        ), "trie-sequences",
    )
    ends = F.col("node") == F.col("whole")
    inner = seqs.where(~ends).select("node").distinct()
    leaves = seqs.where(ends).join(inner, "node", "left_anti").select("whole", F.lit(1).alias("leaf"))
    members = seqs.groupBy("node").agg(F.min("least").alias("owner"), F.sum("weight").alias("n_convs"), F.count("*").alias("n"))
    along = Window.partitionBy("whole")
    owned = F.col("least") == F.col("owner")
    rows = with_members(seqs, members).join(leaves, "whole", "left").select(
        "*", owned.alias("owned"), F.sum(F.when(owned, F.col("words")).otherwise(0)).over(along).alias("own"), F.lag("owner").over(along.orderBy("depth")).alias("parent"),
    )
    once = F.sum("own") + F.sum(F.when(F.col("owned"), F.col("rest") - F.col("own")).otherwise(0))
    nodes = rows.groupBy("node").agg(
        F.first("above").alias("above"), F.first("depth").cast("long").alias("depth"), F.first("owner").alias("conv_id"), F.first("parent").alias("parent_conv_id"), F.first("n_convs").alias("n_convs"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), (F.sum(F.col("weight") * F.col("rest")) - once).alias("saved_tokens"),
    )
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.count("*").alias("n_children"))
    return nodes.join(children, "node", "left").fillna(0, ["n_children"])


def end_lists(table: DataFrame) -> DataFrame:
    """The conversations that end at a node, in pieces: node, piece, ids (ascending; at most 4,096)."""
    ended = table.where(F.col("node") == F.col("whole")).select("node", F.shiftright("conv_id", PIECE_BITS).alias("piece"), "conv_id")
    return ended.groupBy("node", "piece").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))


def list_digests(lists: DataFrame) -> DataFrame:
    """node and ends_sha256: of its ids in decimal, joined by commas.  Pieces stream in order through one task per node,
    as the digest is sequential by definition; a task holds one batch of pieces."""
    rows = lists.select("node", "piece", F.array_join("ids", ",").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        kind = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["node", "ends_sha256"])

        for batch in batches:
            kind = batch.column("node").type
            for own, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if own == node:
                    state.update(b",")
                else:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield flush()
        if state:
            done.append((node, state.hexdigest()))
            yield flush()

    return rows.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(digest, "node struct<k0:long,k1:long>, ends_sha256 string")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all `conversations`, rebuilt so that those of a family share beginnings."""
    table = prefixes(rebuilt(materialize(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")))
    digests = list_digests(end_lists(table))
    nodes = prefix_nodes(table).join(digests, "node", "left").fillna(hashlib.sha256().hexdigest(), ["ends_sha256"])
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as pos, digest, words
  from (select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
        from conversations where conv_id is not null)),
ids as (
  select conv_id, conv_id - ((conv_id % 20) + 20) % 20 as base,
         xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(conv_id::varchar) + 1),
               lambda i: [ascii(substr(conv_id::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, v: case when v >= 0 then xor(c, v) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295) % 4 as h
  from (select distinct conv_id from turns)),
rows_ as (
  select conv_id, -1 as part, 0 as pos, '' as digest, 0 as words from ids
  union all select i.conv_id, 0, t.pos, t.digest, t.words from ids i join turns t on t.conv_id = i.base and t.pos < i.h
  union all select t.conv_id, 1, t.pos, t.digest, t.words from turns t join ids i using (conv_id) where t.pos >= i.h),
placed as (
  select conv_id, words, row_number() over w - 1 as depth, sha256(string_agg(digest, ',') over w) as node,
         row_number() over (partition by conv_id order by part desc, pos desc) = 1 as is_end
  from rows_ window w as (partition by conv_id order by part, pos)),
linked as (select *, lag(node) over (partition by conv_id order by depth) as above from placed),
nodes as (
  select node, any_value(above) as above, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends_sha256
  from linked group by node),
pairs as (select distinct u.node, v.node as below from placed u join placed v on u.conv_id = v.conv_id and v.depth >= u.depth),
children as (select above, count(*) as n from nodes where above is not null group by above),
sums as (
  select p.node, cast(sum((v.n_convs - 1) * v.words) as bigint) as saved_tokens, count(*) filter (c.n is null) as n_leaves
  from pairs p join nodes v on v.node = p.below left join children c on c.above = p.below group by p.node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from nodes n join sums s using (node) left join nodes p on p.node = n.above left join children c on c.above = n.node
"""
