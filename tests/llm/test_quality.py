"""Quality rules and classifier, token counts."""

import random
import zlib

import numpy as np
import pytest

from tenderloom.llm import quality, rules
from tenderloom.llm.quality import Machine, features, quality_scores
from tenderloom.llm.rules import Rule, Test, kept_documents, learn, quality_rules
from tenderloom.llm.stats import COUNTS, measure
from tenderloom.llm.tokens import LAST, TokenCounter, token_counts

from .conftest import odd_rows, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = str(public_tokenizers.path("byte_bpe_50k.json"))


def counted(text):
    """The base numbers by their definition."""
    words = "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in text or "").split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), dup, len(hit)]


def test_counts_follow_their_definition():
    texts = [t for _, t, *_ in odd_rows() if len(t or "") < 9000] + ["a b c a b c a", "x\nx\n\n \nx", "a b   c#*|<>"]
    for text in texts:
        assert measure((text or "").encode())[0] == counted(text), text


def corpus(rng, n):
    good = [sentence(rng, 80) for _ in range(n)]
    bad = [" | ".join(sentence(rng, 40).split()) for _ in range(n)]
    shout = [sentence(rng, 70).upper().replace(" ", "!! ") for _ in range(n)]
    return good, bad + shout


def test_rules_reject_what_the_labels_mark(docs, labels):
    good, bad = corpus(random.Random(3), 40)
    df = docs(*good, *bad, "too short")
    marks = labels(*[(i, int(i < len(good)), 0) for i in range(0, len(good + bad), 2)])
    got = {r.doc_id: r for r in quality_rules(df, marks).collect()}
    assert all(got[i].kept for i in range(len(good)))
    assert not any(got[i].kept for i in range(len(good), len(good + bad)))
    assert got[len(good + bad)].base_failed and not got[len(good + bad)].kept
    assert {r.doc_id for r in kept_documents(df, marks).collect()} == set(range(len(good)))


def test_rules_on_odd_rows(odd, none, labels):
    marks = labels((4, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0))
    got = quality_rules(odd, marks).collect()
    assert len(got) == len(odd_rows())
    for row in got:
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert row.kept == (not row.base_failed)
    want = sorted([str(i), *counted(t)] for i, t, *_ in odd_rows() if i != 10)
    assert sorted([str(r.doc_id), *[r[c] for c in COUNTS]] for r in got if r.doc_id != 10) == want
    assert kept_documents(odd, marks).columns == odd.columns
    assert quality_rules(none, labels()).count() == 0


def test_no_rule_without_precision():
    rng = np.random.default_rng(1)
    noise = {f: rng.random(300) for f in rules.FEATURES} | {"label": rng.integers(0, 2, 300)}
    assert learn(noise) == []
    assert learn({"label": np.zeros(0)}) == []


def test_rule_is_a_spark_condition(spark):
    rule = Rule((Test("x", True, 0.5), Test("y", False, 2.0)))
    df = spark.createDataFrame([(0.6, 2.0), (0.5, 1.0), (0.7, 2.1)], "x double, y double")
    assert [r[0] for r in df.select(rule.column()).collect()] == [True, False, False]
    assert str(rule) == "reject if x > 0.5 and y <= 2"


def test_pairwise_part_is_the_sum_over_pairs():
    machine = Machine(np.zeros(quality.EXTRA), np.ones(quality.EXTRA), seed=2)
    rng = np.random.default_rng(0)
    machine.w, machine.b = rng.normal(size=quality.SIZE), 0.3
    at, x = features(b"some words and some more", None)
    z = machine.scaled(x)
    pairs = sum(
        machine.v[at[i]] @ machine.v[at[j]] * z[i] * z[j] for i in range(len(at)) for j in range(i)
    )
    want = 1 / (1 + np.exp(-(machine.b + machine.w[at] @ z + pairs)))
    assert machine.score(at, x) == pytest.approx(want, rel=1e-9)


def test_held_out_accuracy(docs, labels):
    good, bad = corpus(random.Random(8), 60)
    texts = good + bad
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    marks = [(i, int(i < len(good)), 0) for i in range(len(texts))]
    got = quality_scores(docs(*texts), labels(*marks)).collect()
    assert all(r.held_out == out(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in got)
    right = [r.predicted == int(r.doc_id < len(good)) for r in got if r.held_out]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    # Labels of held-out rows change nothing.
    flipped = [(i, 1 - q if out(i) else q, 0) for i, q, _ in marks]
    again = quality_scores(docs(*texts), labels(*flipped)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_scores_of_odd_rows(odd, none, labels):
    got = quality_scores(odd, labels()).collect()
    assert len(got) == len(odd_rows()) and all(r.score == pytest.approx(0.5, abs=0.2) for r in got)
    assert quality_scores(none, labels()).count() == 0


def test_the_bound_of_the_fit_holds_for_rows(spark, labels, monkeypatch):
    from tenderloom.llm import quality

    rows = [(None if i % 2 else 1, f"text number {i} " * 9, None) for i in range(60)] + [(2, "another one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    sizes = []
    monkeypatch.setattr(quality.Machine, "fit", lambda self, rows, labels: sizes.append(len(rows)))
    quality.fit(df, labels((None, 1, 0), (1, 0, 0), (2, 1, 0)), rows=3)
    assert 1 <= sizes[0] <= 3


def test_tokens_as_the_library_counts_them(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    got = sorted(map(str, (tuple(r) for r in token_counts(odd, FILE).collect())))
    want = []
    for i, t, *_ in odd_rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append(str((i, len((t or "").encode()), n, n > 1024)))
    assert got == sorted(want)
    assert token_counts(none, FILE).count() == 0


def test_pretokens_of_random_texts():
    counter = TokenCounter(open(FILE, encoding="utf-8").read(), {})
    rng = random.Random(4)
    blanks = [32, 10, 9, 39, 0x85, 0xA0, 0x1C, 0x1F, 115]
    for _ in range(3000):
        pick = lambda: chr(rng.choice([rng.randint(0, 127), rng.randint(0, LAST), rng.choice(blanks)]))
        text = "".join(pick() for _ in range(rng.randint(0, 14))) + rng.choice(["", "<|endoftext|>", " "])
        assert counter.count(text) == counter.whole(text), ascii(text)


def test_pretokens_of_all_planes():
    counter = TokenCounter(open(FILE, encoding="utf-8").read(), {})
    rng = random.Random(6)
    spans = [(0x20, 0x7E), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
    spans += [(0x600, 0x6FF), (0x900, 0x97F), (0x1F300, 0x1F6FF), (0x20000, 0x2A6D6), (0x1D400, 0x1D7FF), (0, 0x10FFFF)]
    cut = 0
    for _ in range(4000):
        first, last = rng.choice(spans)
        codes = [rng.choice([32, 97, 10, 49, rng.randint(first, last), rng.randint(first, last)]) for _ in range(9)]
        text = "".join(chr(c) for c in codes if not 0xD800 <= c <= 0xDFFF)
        cut += counter.pieces(text) is not None
        assert counter.count(text) == counter.whole(text), ascii(text)
    assert cut > 2_000
    # Each character, after a letter and after a digit.
    pre = counter.tokenizer.pre_tokenizer
    for code in range(LAST + 1, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        text = "a" + chr(code) + "1" + chr(code) + " " + chr(code)
        pieces = counter.pieces(text)
        if pieces is not None:
            assert len(pieces) == len(pre.pre_tokenize_str(text)), hex(code)
    plain = "The “quick” fox — €5, 東京 and 😀!"
    assert counter.pieces(plain) is not None and "".join(counter.pieces(plain)) == plain


def test_the_sample_is_the_smallest_by_hash(spark):
    from tenderloom.llm.common import fewest

    df = spark.range(5_000).withColumnRenamed("id", "did").repartition(5)
    all_ = [r.did for r in fewest(df, 9_000, 3).collect()]
    assert len(all_) == 5_000
    assert [r.did for r in fewest(df, 400, 3).collect()] == all_[:400]
