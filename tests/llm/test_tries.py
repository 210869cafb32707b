"""The conversation trie against nested loops."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tenderloom.llm import tries

SCHEMA = "conv_id long, turn int, role string, text string, node string, depth int, conv int, top binary, name int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, b"t", 3) for r in rows], SCHEMA).repartition(3)


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(math.fmod(c, 100))  # SQL's remainder has the sign of c
        rebuilt = turns.get(first, [])[:h] + turns[c][h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        ends[tuple(rebuilt)].append(c)
    out = []
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    for node, m in members.items():
        ids = ",".join(map(str, ends[node]))
        out.append(
            (m[0], len(node), members[node[:-1]][0] if node else None, len(m), children[node], leaves[node], saved[node],
             hashlib.sha256(ids.encode()).hexdigest())
        )
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def check(spark, rows, *limits):
    want = sorted(expected(rows), key=key)
    for limit in limits:
        got = sorted(map(tuple, tries.conversation_trie(frame(spark, rows), limit).collect()), key=key)
        assert got == want


def conversations(n, seed=1, longest=9, words=3):
    rng = random.Random(seed)
    ids = rng.sample(range(500), n)
    return [
        (c, t, "user" if t % 2 == 0 else "assistant", f"say {rng.randrange(words)}" + "x" * rng.randrange(2))
        for c in ids
        for t in range(rng.randrange(1, longest))
    ]


def test_against_loops(spark):
    rows = conversations(120)
    random.Random(2).shuffle(rows)
    check(spark, rows, tries.LIMIT, 60, 5)


def test_odd_turns(spark):
    rows = conversations(30) + [
        (0, None, None, None), (0, None, "user", "é😀"), (0, 1, "user", ""), (0, 1, "user", ""), (7, 3, "a", "bc"),
        (8, 3, "ab", "c"), (None, 1, "user", "nobody"), (-1, 0, "user", "x"), (-101, 0, "user", "x"), (-100, 2, "user", "y"),
        (901, 0, "user", "long " * 50_000), (902, 5, None, "long " * 50_000),
    ]
    check(spark, rows, tries.LIMIT, 10)


@pytest.fixture
def many_tasks(spark):
    """Small tasks stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_long_conversation_over_many_tasks(spark, many_tasks):
    rows = [(100, t, "user", f"turn {t % 7}") for t in range(300)] + [(c, t, "user", f"turn {t}") for c in (101, 102, 103) for t in range(9)]
    rows += [(205, t, "user", "again") for t in range(60)]
    parts = frame(spark, rows)
    assert tries._local_names(parts).where("conv = 100").select("part").distinct().count() > 1
    check(spark, rows, tries.LIMIT, 20)


def test_one_first_turn_for_all(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c}") for c in range(0, 20_000, 100) for t in range(2)]
    check(spark, rows, tries.LIMIT, 50)


def test_conversation_without_turns_left(spark):
    """The first turns of a conversation whose family has no first are dropped, all of them if few."""
    c = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 6 == 5)
    check(spark, [(c, t, "user", "x") for t in range(3)], tries.LIMIT)


def test_no_rows(spark):
    assert tries.conversation_trie(frame(spark, [(1, 1, "a", "b")]).where("false")).collect() == []


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_rolled_component(shape):
    rng = random.Random(4)
    n = 400
    parents = [-1] + [i - 1 if shape == "path" else 0 if shape == "star" else rng.randrange(i) for i in range(1, n)]
    values = [[rng.randrange(10) for _ in range(n)] for _ in range(2)]
    weights = [rng.randrange(1, 4) for _ in range(n)]
    want = [list(v) for v in values]
    for i in range(n - 1, 0, -1):
        weights[parents[i]] += weights[i]
        for v in want:
            v[parents[i]] += v[i]
    sums = [[0] * n, [0] * n]
    tries.rolled_component(parents, weights, values, sums)
    assert sums == want
