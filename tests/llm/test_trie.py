"""The prefix trie and its totals against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest


def brute_force(rows, hash_of):
    """rows: (conv, turn, role, text); hash_of orders turns of equal number."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), hash_of[r or "", x or ""], (r or "", x or "")))
    turns = {c: [x for *_, x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = {}
    for p, m in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in m if made[c] == p).encode()).hexdigest()
        out[m[0], len(p)] = (members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], ends)
    return out


def compare(spark, df, rows):
    from pyspark.sql import functions as F

    from crosstide.llm import trie

    pairs = list({(r or "", x or "") for _, _, r, x in rows})
    hashed = spark.createDataFrame(pairs or [("", "")], "r string, x string").select("r", "x", F.xxhash64(F.lit(1), "r", "x"), F.xxhash64(F.lit(2), "r", "x")).collect()
    got = trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(df))).collect()
    want = brute_force(rows, {(r, x): (a, b) for r, x, a, b in hashed})
    assert len(got) == len(want)
    assert {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got} == want


SCHEMA = "conv_id long, turn int, role string, text string, id string, d int, parent string, kids int, x1 long"


def test_trie_of_rebuilt_conversations(spark, monkeypatch):
    from crosstide.llm import trie

    monkeypatch.setattr(trie, "BLOCK", 7)
    monkeypatch.setattr(trie, "ID_BLOCK", 16)
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", None, "assistant"]), rnd.choice(["hé", "", None, "what then"])) for c in range(60) for t in range(rnd.randint(1, 12))]
    rows += [(c, t, "user", "the same") for c in range(100, 180) for t in range(3)]  # one conversation many times
    rows += [(200, t, "user", f"a long one {t % 5}") for t in range(90)] + [(201, t, "user", f"a long one {t % 5}") for t in range(0, 90)]
    rows += [(300, None, "user", "no number"), (300, None, None, None), (300, 1, "user", "x"), (300, 1, "user", "y"), (300, 1, "user", "y")]
    rows += [(None, 0, "user", "no conversation"), (7_000_000_001, 0, "user", "far away"), (303, 0, "a", "b"), (304, 0, "a", "b")]
    df = spark.createDataFrame([(*r, "7", 7, "7", 7, 7) for r in rows], SCHEMA).repartition(5)
    compare(spark, df, rows)


def test_empty_and_single(spark):
    from crosstide.llm import trie

    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(none))).collect() == []
    compare(spark, spark.createDataFrame([(3, None, None, None)], none.schema), [(3, None, None, None)])
    turns = trie.numbered_turns(spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b")], none.schema))
    got = sorted(map(tuple, trie.prefix_trie(*trie.as_sequences(turns)).select("conv_id", "depth", "n_convs", "n_leaves").collect()))
    assert got == [(1, 0, 2, 1), (1, 1, 2, 1), (2, 2, 1, 1)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_contraction_of_any_tree(spark, shape):
    from crosstide.llm import trie

    rnd = random.Random(9)
    n = 120
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rnd.randrange(i), "caterpillar": lambda i: i - 1 if i % 2 else max(0, i - 2)}[shape]
    parent = {0: None, **{i: up(i) for i in range(1, n)}, n: None, n + 1: n}
    depth, line, total = {}, {}, defaultdict(int)
    for i, p in parent.items():
        depth[i] = 0 if p is None else depth[p] + 1
        line[i] = i if p is None or p in line.values() and rnd.random() < 0.3 or any(line[j] == line[p] and depth[j] == depth[i] for j in line) else line[p]
        at = i
        while at is not None:
            total[at] += i * i + 1
            at = parent[at]
    tree = spark.createDataFrame([(i, p, line[i], depth[i], i * i + 1) for i, p in parent.items()], "id long, parent long, line long, depth int, v long")
    assert dict(map(tuple, trie.subtree_totals(tree, ["v"], 8).collect())) == dict(total)


def test_a_circle_is_an_error(spark):
    from crosstide.llm import trie

    with pytest.raises(ValueError):
        trie.subtree_totals(spark.createDataFrame([(1, 2, 1, 1, 1), (2, 3, 2, 1, 1), (3, 1, 3, 1, 1), (4, 3, 4, 1, 1)], "id long, parent long, line long, depth int, v long"), ["v"])


def test_query_on_a_table(spark):
    from crosstide.llm.trie import op11_prefix_trie

    got = op11_prefix_trie(spark, "/root/testdata/sf0.001")
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes[:7]} == {"bigint"}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hash_of = defaultdict(int)
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got.collect()} == brute_force(rows, hash_of)
