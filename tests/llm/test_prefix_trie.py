import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tests.llm.conftest import WORD
from tidebook.llm import prefix_trie
from tidebook.llm.prefix_trie import end_lists, op12_prefix_trie, prefix_nodes, prefixes, rebuilt, turns_of

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long"


def plain(rows):
    """The nodes by following every conversation turn by turn."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members, last, ends = defaultdict(list), {}, defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    below = defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for node in members:
        if node:
            below[node[:-1]][0] += 1
    parents = {n[:-1] for n in members if n}
    for node, of in members.items():
        saved = (len(of) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            below[node[:d]][1] += node not in parents
            below[node[:d]][2] += saved
    out = []
    for node, of in members.items():
        listed = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), *below[node], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(rng, families=3, most=6):
    texts = [None, "", " ", "a b", "a  b c", "é x", "long " * 5]
    rows = []
    for conv in rng.sample(range(20 * families), 12 * families):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(texts), "clash", 7))
    rows += [rows[0], rows[0]]  # repeated rows are turns
    rows += [(None, 0, "user", "nobody's", None, None), (None, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = rows_of(random.Random(seed))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in op12_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)


@pytest.mark.parametrize("least", [0, 3])
def test_nodes_of_many_sequences_are_split_off(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(prefix_trie, "LEAST_HEAVY", least)
    rows = rows_of(random.Random(3), families=2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in op12_prefix_trie(spark, str(tmp_path)).collect()), key=str) == plain(rows)


def test_copies_and_a_long_conversation(spark):
    same = [(c, t, "user", f"t {t}") for c in range(1000, 1300) for t in range(6)]
    long = [(7, t, "user", f"word {t % 5}") for t in range(3000)]
    table = prefixes(rebuilt(turns_of(spark.createDataFrame(same + long, "conv_id long, turn long, role string, text string"))))
    nodes = {(r.conv_id, r.depth): r for r in prefix_nodes(table).collect()}
    h = zlib.crc32(b"7") % 4
    assert nodes[7, 3000 - h].n_children == 0 and nodes[7, 0].n_convs == 301
    assert nodes[7, 0].saved_tokens == sum(n.saved_tokens - sum(m.saved_tokens for m in nodes.values() if (m.parent_conv_id, m.depth) == (n.conv_id, n.depth + 1)) for n in nodes.values())
    assert nodes[7, 0].n_leaves == sum(n.n_children == 0 for n in nodes.values())
    lists = end_lists(table).collect()
    assert sum(len(r.ids) for r in lists) == 301 and all(list(r.ids) == sorted(r.ids) for r in lists)


def test_roles_and_texts_are_not_run_together(spark):
    rows = [(20, 0, "ab", "c"), (21, 0, "a", "bc"), (40, 0, "ab", "c")]
    nodes = prefix_nodes(prefixes(turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).selectExpr("conv_id", "1 part", "pos", "digest", "words")))
    assert sorted((r.conv_id, r.n_convs) for r in nodes.collect() if r.depth == 0) == [(20, 2), (21, 1)]  # without starting rows, the first turns are roots


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12_prefix_trie(spark, str(tmp_path)).collect() == []
