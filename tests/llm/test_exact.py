"""Exact dedup against plain grouping."""

import hashlib
import random
from collections import defaultdict

import pytest

from tenderloom.llm import exact

FOLD = str.maketrans(exact.UPPER, exact.LOWER)


def digest(text):
    return hashlib.sha256((text or "").translate(FOLD).encode()).hexdigest()


def expected(rows):
    """Sorted (doc_id, keep_id, group_size, text_sha256), and the ids that stay for each text."""
    groups = defaultdict(list)
    for r in rows:
        groups[digest(r[1])].append(r[0])
    stays = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in groups.items()}
    return [(r[0], stays[digest(r[1])], len(groups[digest(r[1])]), digest(r[1])) for r in rows], stays


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("most_bits", [exact.MOST_BITS, 2**5])
def test_odd_rows(odd, most_bits):
    rows = [tuple(r)[:2] for r in odd.collect()]
    want, stays = expected(rows)
    got = exact.exact_dedup(odd, most_bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(kept) == sorted(stays.items(), key=lambda x: x[0])


@pytest.mark.parametrize("most_bits", [exact.MOST_BITS, 2**5])
def test_whole_rows(odd, most_bits):
    rows = [tuple(r)[:2] for r in odd.collect()]
    left = exact.distinct_documents(odd, most_bits)
    assert left.columns == odd.columns
    got = sorted((digest(r.text), r.doc_id) for r in left.collect())
    assert got == sorted(expected(rows)[1].items())


def test_no_rows(none):
    assert exact.exact_dedup(none).collect() == []
    assert exact.distinct_documents(none).collect() == []


def test_a_to_z_only(spark, docs):
    got = {r.doc_id: r.keep_id for r in exact.exact_dedup(docs("ÀB c", "Àb C", "àB c", "İK", "İk", "K")).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 4, 4: 4, 5: 5}


def test_hot_text_and_lone_rows(spark):
    rng = random.Random(3)
    rows = [(i, "the same" if i % 3 == 0 else f"text {rng.randrange(900)}") for i in range(2_000)]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(expected(rows)[0])


def test_no_python_and_lone_rows_stay(spark):
    """Rows that stand alone are never shuffled: nothing is joined but the possibly repeated ones."""
    rows = [(i, f"text {i}") for i in range(3_000)] + [(9_000, "text 7"), (9_001, "text 8")]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", exact.text_sha256(exact.F.col("text")))
    bits = exact.filter_bits(len(rows))
    asked = exact.with_possible(keyed, "k", exact.repeated_positions(keyed, "k", bits), bits, "possible")
    found = {r.doc_id for r in asked.where("possible").collect()}
    assert {7, 8, 9_000, 9_001} <= found and len(found) < 200
