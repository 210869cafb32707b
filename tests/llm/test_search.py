"""Near duplicates, leaks, licences and mixing."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import near
from tenderloom.llm.common import common_subsequence
from tenderloom.llm.leaks import benchmark_leaks, clean_documents
from tenderloom.llm.leaks import words as leak_words
from tenderloom.llm.licenses import BASE, license_scan, template_words
from tenderloom.llm.mixing import apportion, mix, mixed_documents, targets
from tenderloom.llm.near import near_duplicates

from .conftest import odd_rows, sentence


def edited(rng, text, share):
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 999))
    return " ".join(words)


def true_classes(texts):
    """Classes by comparing every pair."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_classes_against_all_pairs(docs):
    rng = random.Random(1)
    texts = []
    for size in [4, 6, 9, 15, 30, 60, 150, 400] * 5:
        base = sentence(rng, size)
        texts += [base] + [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.05])) for _ in range(3)]
    chain = sentence(rng, 300)
    for _ in range(12):
        chain = edited(rng, chain, 0.012)
        texts.append(chain)
    texts += ["", None, "a b c d e f g h", "a b c d e f g"]
    rng.shuffle(texts)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == true_classes(texts)


def test_true_pairs_in_a_family_of_dissimilar_texts(docs):
    """Members of one template are mostly below 0.8 to each other, the first of a bucket too, but each has a
    copy that is near."""
    rng = random.Random(7)
    template, texts = sentence(rng, 300).split(), []

    def changed(words, places):
        out = list(words)
        for at in places:
            out[at] = f"edit{rng.randint(0, 10**9)}"
        return out

    for _ in range(150):
        member = changed(template, [37 + 75 * i + rng.randrange(30) for i in range(4)])
        texts += [" ".join(member), " ".join(changed(member, rng.sample(range(300), 6)))]
    rng.shuffle(texts)
    want = true_classes(texts)
    assert len(set(want)) < len(texts) - 75
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def template_family(rng, members, size, changes, edits):
    """Copies of one template with ``changes`` words of their own, and a copy of each with ``edits`` more."""
    template, texts = sentence(rng, size).split(), []

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"edit{rng.randint(0, 10**9)}"
        return out

    for _ in range(members):
        member = changed(template, changes)
        texts += [" ".join(member), " ".join(changed(member, rng.choice(edits)))]
    rng.shuffle(texts)
    return texts


def test_links_that_the_neighbours_miss_are_found(docs, spark, monkeypatch):
    """Only the nearest texts of a bucket are compared at first; no link may hang on that."""
    none = spark.createDataFrame([], "a binary, b binary")
    monkeypatch.setattr(near, "neighbour_pairs", lambda mixed, sketches: none)
    texts = template_family(random.Random(7), 100, 300, 4, [6])
    want = true_classes(texts)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_rarest_pairs_hold_every_link(docs, spark):
    """Against all pairs, whatever the length; texts of one class are left alone."""
    rng = random.Random(8)
    texts = template_family(rng, 24, 200, 6, [1, 2, 3]) + template_family(rng, 8, 30, 1, [1])
    texts += [sentence(rng, n) for n in (1, 3, 5, 6)] + ["a b c d e f g h i j", "b a b c d e f g h i j"]
    sigs = [near._signature(t.encode().split()) for t in texts]
    sets = [set(near.shingles(t.encode().split()).tolist()) for t in texts]
    rows = [(s, s if i else sigs[1]) for i, s in enumerate(sigs)]
    open_ = spark.createDataFrame(rows, "sig binary, label binary")
    pairs = spark.createDataFrame([(a, a) for a in sigs], "a binary, b binary")
    got = {(bytes(r.a), bytes(r.b)) for r in near.rarest_pairs(open_, near.held_texts(pairs, docs(*texts))).collect()}
    want = {
        (min(sigs[i], sigs[j]), max(sigs[i], sigs[j]))
        for i in range(len(texts))
        for j in range(i)
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and {i, j} != {0, 1}
    }
    assert len(want) > 20 and want <= got and all(a < b for a, b in got)
    assert tuple(sorted([sigs[0], sigs[1]])) not in got


def test_shuffled_paragraphs_are_not_near(docs):
    rng = random.Random(2)
    parts = [sentence(rng, 120) for _ in range(6)]
    got = near_duplicates(docs(" ".join(parts), " ".join(parts[3:] + parts[:3]))).collect()
    assert len({r.class_id for r in got}) == 2


def test_near_classes_of_odd_rows(odd, none):
    got = defaultdict(list)
    for r in near_duplicates(odd).collect():
        got[r.class_id].append(r.doc_id)
    # The null id has the text of 4, so its class is named by 4; 5 is near both.
    assert sorted(map(str, got[4])) == ["4", "4", "5", "None"]
    assert got[12] == [12, 13] or sorted(got[12]) == [12, 13]
    assert {1, 2, 3} <= {c for c, members in got.items() if members == [c]}
    kept = near.kept_documents(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 1 and ids[4] == ids[5] == 0 and ids[12] == 1 and ids[13] == 0 and ids[14] == 2
    assert near_duplicates(none).count() == 0 and near.kept_documents(none).count() == 0


def test_one_row_of_repeated_rows_stays(docs):
    df = docs("w " * 3 + "x y z one two three four")
    assert near.kept_documents(df.unionByName(df)).count() == 1


def test_distance_is_insertions_and_deletions():
    rng = random.Random(6)
    for _ in range(200):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        lcs = int(table[-1, -1])
        assert common_subsequence(a, b) == lcs
        assert near._distance(a, b, 60) == len(a) + len(b) - 2 * lcs
        assert near._distance(a, b, len(a) + len(b) - 2 * lcs - 1) is None


def test_labels_tell_occurrences_apart():
    hashes = np.array([5, 7, 5, 5, 9], np.uint64)
    labels = near.labelled(hashes)
    assert len(set(labels.tolist())) == 5 and near.labelled(hashes[:2]).tolist() == [5, 7]


def leak_tables(spark, docs):
    rng = random.Random(3)
    items = [sentence(rng, n) for n in (12, 20, 35, 60, 60)]
    fill = lambda n: sentence(rng, n)
    swapped = items[3].split()
    for i in range(3, 36, 8):
        swapped[i] = "other"
    texts = [
        fill(200),
        fill(90) + " " + items[0] + " " + fill(300),
        items[1] + "! " + fill(20),
        items[2].upper().replace(" ", ", "),
        fill(150) + " " + " ".join(swapped) + " " + fill(10),
        fill(40) + " " + " ".join(items[4].split()[:25]) + " " + fill(60),
        None,
        "",
        fill(100) + " " + items[0] + " " + fill(400) + " " + items[4],
    ] + [fill(150) for _ in range(40)]
    rows = [*enumerate(items), (7, None), (8, ""), (9, "?!"), (0, items[0])]
    bench = spark.createDataFrame(rows, "item_id long, text string").withColumn("did", F.lit(1))
    return docs(*texts), bench


def test_leaks_are_found_and_clean_documents_left(spark, docs):
    df, bench = leak_tables(spark, docs)
    got = sorted((r.doc_id, r.item_id) for r in benchmark_leaks(df, bench).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (8, 0), (8, 4)]
    in_blocks = sorted((r.doc_id, r.item_id) for r in benchmark_leaks(df, bench, items=2).collect())
    assert in_blocks == got
    left = {r.doc_id for r in clean_documents(df, bench).collect()}
    assert left == set(range(49)) - {1, 2, 3, 4, 8}


def held_by_brute_force(text, item, coverage=0.6, sure=0.8, answer=0.75):
    """The item's words against every stretch of the text, wherever they stand."""
    text, item = leak_words(text or ""), leak_words(item)
    n, known = len(item), set(item)
    width, step = n + n // 4 + 4, max(1, n // 8)
    tail = item[-max(1, min(n, max(3, n // 5))) :]
    for at in range(0, max(1, len(text) - width + step), step):
        stretch = text[at : at + width]
        if sum(w in known for w in stretch) < coverage * n:
            continue
        share = common_subsequence(item, stretch) / n
        if share >= sure or share >= coverage and common_subsequence(tail, stretch) / len(tail) >= answer:
            return True
    return False


def test_leaks_of_any_length_as_by_brute_force(spark, docs):
    rng = random.Random(8)
    # Common words are frequent, as in real texts.
    words = [sentence(rng, 1) + str(i) for i in range(4_000)]
    fill = lambda n: " ".join(words[int(4_000 * rng.random() ** 3)] for _ in range(n))
    sizes = (10, 40, 64, 65, 129, 400, 1_200, 1_800, 2_048, 2_500, 5_000)
    items = [fill(n) for n in sizes]
    texts, planted = [], set()
    for i, item in enumerate(items):
        planted |= {(len(texts), i), (len(texts) + 1, i), (len(texts) + 2, i)}
        texts.append(fill(170) + " " + item + " " + fill(90))
        # A word in ten is another one; a word in ten is added.
        texts.append(fill(37) + " " + " ".join("other" if rng.random() < 0.1 else w for w in item.split()))
        texts.append(" ".join(w + " more" if rng.random() < 0.1 else w for w in item.split()) + " " + fill(500))
        # Less than half of it is not the item.
        texts.append(fill(30) + " " + " ".join(item.split()[: len(item.split()) * 9 // 20]) + " " + fill(60))
    texts += [fill(n) for n in (50, 200, 3_000, 9_000)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    wanted = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if held_by_brute_force(t, item)}
    assert planted <= wanted
    got = benchmark_leaks(docs(*texts), bench, items=120).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and len(got) == len(wanted)
    assert min(r.coverage for r in got if r.doc_id % 4 == 0) == 1.0


def every_stretch(text, item, coverage=0.6, sure=0.8, answer=0.75):
    """``held_by_brute_force`` from every word of the text."""
    text, item = leak_words(text), leak_words(item)
    n, width = len(item), len(item) + len(item) // 4 + 4
    tail = item[-max(1, min(n, max(3, n // 5))) :]
    for at in range(max(1, len(text) - width + 1)):
        stretch = text[at : at + width]
        share = common_subsequence(item, stretch) / n
        if share >= sure or share >= coverage and common_subsequence(tail, stretch) / len(tail) >= answer:
            return True
    return False


def test_leaks_far_from_their_item_are_found(spark, docs):
    rng = random.Random(21)
    # Items of words that are everywhere, in texts full of other items' rare words.
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(900)]
    some = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    items = [some(common, n) for n in (3, 8, 12, 12, 16, 24)] + [some(rare, 40) for _ in range(20)]
    items.append(" ".join(f"r{i} c{i % 40}" for i in range(0, 900, 4)))

    def kept(item, share):
        words = item.split()
        left = set(rng.sample(range(len(words)), round(share * len(words))))
        return " ".join(w if i in left else rng.choice(rare) for i, w in enumerate(words))

    texts = [some(common, 60) + " " + some(rare, 90) for _ in range(150)]
    for item in items:
        for share in (0.6, 0.7, 0.8, 0.9):
            texts.append(some(rare, rng.randint(20, 70)) + " " + kept(item, share) + " " + some(rare, rng.randint(20, 70)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    wanted = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if every_stretch(t, item)}
    got = benchmark_leaks(docs(*texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and len(got) == len(wanted)
    in_blocks = benchmark_leaks(docs(*texts), bench, items=9).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} == wanted


def test_leaks_of_odd_rows(spark, odd, none):
    passage = " ".join(odd_rows()[7][1].split()[40:80])
    bench = spark.createDataFrame([(None, passage), (2, passage[:-1])], "item_id long, text string")
    got = benchmark_leaks(odd, bench).collect()
    assert {r.doc_id for r in got} == {6, 7} and {r.item_id for r in got} == {None, 2}
    assert clean_documents(odd, bench).columns == odd.columns
    assert clean_documents(odd, bench).count() == len(odd_rows()) - 2
    empty = spark.createDataFrame([], "item_id long, text string")
    assert benchmark_leaks(odd, empty).count() == 0 and benchmark_leaks(none, bench).count() == 0


def base_places(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]
    hits = [
        (i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_places(docs):
    texts = [
        "MIT License mit license; mit-license, general public license General\nPublic LICENSE",
        "apachelicense apache licenseé x apache license apache_license",
        "mit mit license license", None, "", "mit", "general public public license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of any charge to any person obtaining one copy of this software",
        "All rights reserved. Licensed under CC BY-NC 4.0.", "licensed under cc by sa",
        "All rights reserved. " * 3, "all rights reserved " * 40 + "mit license", "all rights all rights",
    ]
    got = {r.doc_id: r for r in license_scan(docs(*texts)).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(text), text
    assert got[7].labels == "mit" and got[7].score == 1.0
    assert got[8].labels == "mit" and 0.6 < got[8].score < 1.0
    assert got[9].labels == "cc-by-nc,proprietary" and got[10].labels == "" and got[3].score == 0.0
    assert (got[11].labels, got[11].score) == ("proprietary", 1.0) and got[12].labels == "mit,proprietary"
    assert got[13].labels == ""


def test_licences_of_odd_rows(odd, none):
    got = license_scan(odd).collect()
    want = Counter((i, *base_places(t)) for i, t, *_ in odd_rows())
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert license_scan(none).count() == 0


def test_templates_have_pairs():
    assert all(len(template_words(t)) > 1 for _, t in BASE)


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in held)
        share = sum(weight[s] for s in order if s not in held)
        now = {s: most * sizes[s] if s in held else rest * weight[s] / share for s in order}
        above = {s for s in order if s not in held and now[s] > most * sizes[s]}
        if not above:
            return now
        held |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_fill_by_weight(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 5, 100, 1000, 40_000]) for i in range(9)} | {None: 700, "é": 1}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def highest(weights, seats):
    won = Counter()
    for _ in range(seats):
        best = max(weights, key=lambda k: (weights[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return {k: won[k] for k in weights}


@pytest.mark.parametrize("seed", range(5))
def test_seats_go_to_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    weights = {i: float(rng.choice([0, 1, 7, 50, 400, 3000]) + rng.random()) for i in range(12)}
    seats = rng.choice([3, 40, 500])
    df = spark.createDataFrame(list(weights.items()), "k int, w double")
    got = {r.k: r.quota for r in apportion(df, [], "k", "w", F.lit(seats)).collect()}
    assert got == highest(weights, seats)


def test_mix_comes_near_its_targets(docs):
    rng = random.Random(9)
    df = docs(*[sentence(rng, rng.randint(1, 400)) for _ in range(150)])
    for shard in (1_000_000, 3_000):
        rows = mix(df, shard_words=shard).collect()
        assert len(rows) == 150 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
        by = defaultdict(int)
        for r in rows:
            by[r.source_size, r.target] += r.taken
        assert all(abs(taken - target) <= max(64 * 4, 0.02 * target) for (_, target), taken in by.items())
        assert sorted(mix(df.repartition(7), shard_words=shard).collect()) == sorted(rows)


def test_mix_of_small_sources(spark):
    rng = random.Random(10)
    words = {"a": 8, "b": 1, "c": 70, "d": 6_000, "e": 40, None: 3}
    rows, i = [], 0
    for source, n in words.items():
        while n:
            take = min(n, rng.randint(1, 90))
            rows.append((i, sentence(rng, take), source))
            n, i = n - take, i + 1
    for shard in (1_000_000, 20):
        got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=shard).collect()
        by = defaultdict(int)
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"]
            by[rows[r.doc_id][2], r.target] += r.taken
        assert len(by) == 6
        assert all(abs(taken - target) <= max(1, target / 32) for (_, target), taken in by.items()), by


def test_mix_of_odd_rows(odd, none):
    rows = mix(odd).collect()
    assert len(rows) == len(odd_rows()) and all(r.taken <= 3 * r["size"] for r in rows)
    assert {r.doc_id: r["size"] for r in rows}[3] == 0
    left = mixed_documents(odd)
    assert left.columns == odd.columns and left.schema["taken"].dataType.typeName() == "long"
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0


def test_near_classes_of_the_sample_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = true_classes([r.text for r in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if want[i] == want[j]]
    found = sum(got[rows[i].doc_id] == got[rows[j].doc_id] for i, j in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    assert all(want[i] == want[j] for i in range(len(rows)) for j in range(i) if got[rows[i].doc_id] == got[rows[j].doc_id])
