"""Substring, suffix-array and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tenderloom.llm import repeats
from tenderloom.llm.automata import Automaton, without_earlier_spans
from tenderloom.llm.lines import line_dedup, shortened_documents
from tenderloom.llm.suffixes import common, multikey_quicksort, without_repeated_bytes
from tenderloom.llm.windows import Windows, byte_grams

from .conftest import odd_rows, sentence

LOW = -(2**63)


def covered(starts, n, length):
    mask = np.zeros(n, bool)
    for s in starts:
        mask[s : s + length] = True
    return mask


def earlier_spans(rows, length):
    texts = [(LOW if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for a in range(len(w) - length + 1):
            key = tuple(w[a : a + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for (shown, _), (i, w) in zip(rows, texts):
        mask = covered([a for a in range(len(w) - length + 1) if first[tuple(w[a : a + length])] < i], len(w), length)
        kept = b" ".join(x for x, gone in zip(w, mask) if not gone)
        out.append((shown, len(w), int(mask.sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeated_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[a : a + length] for _, b in texts for a in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        mask = covered([a for a in range(len(b) - length + 1) if seen[b[a : a + length]] > 1], len(b), length)
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        kept = bytes(x for x, gone in zip(b, mask) if not gone)
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def spliced(seed, n=60):
    """Texts made of shared pieces of every length, so that windows overlap in many ways."""
    rng = random.Random(seed)
    pieces = [sentence(rng, rng.randint(5, 120)) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(pieces) if rng.random() < 0.6 else sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 6))]
        words = " ".join(parts).split()
        a = rng.randint(0, len(words) // 3)
        out.append(" ".join(words[a : len(words) - rng.randint(0, len(words) // 3)]))
    return out + ["ab" * 300, "ab" * 300 + "c", "a b " * 90, "a b " * 200]


def pairs(df, *columns):
    return Counter(tuple(r) for r in df.select("doc_id", *columns).collect())


def check_both(df, rows):
    assert pairs(without_earlier_spans(df), "n_words", "n_removed", "kept_sha256") == earlier_spans(rows, 50)
    assert pairs(without_repeated_bytes(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeated_bytes(rows, 200)


def test_odd_rows(odd):
    check_both(odd, [r[:2] for r in odd_rows()])


def test_spliced_texts(docs):
    texts = spliced(3)
    check_both(docs(*texts), list(enumerate(texts)))


def test_groups_too_big_to_gather(docs, monkeypatch):
    monkeypatch.setattr(repeats, "BIG", 2)
    texts = spliced(4)
    check_both(docs(*texts), list(enumerate(texts)))


def test_empty_table(none):
    assert without_earlier_spans(none).count() == 0
    assert without_repeated_bytes(none).count() == 0
    assert line_dedup(none).count() == 0
    assert shortened_documents(none).columns == none.columns


def test_windows_cover_each_start_once():
    data = random.Random(1).randbytes(900)
    cut = Windows(byte_grams(data, 32), 200, 32)
    assert cut.count == 701
    assert cut.starts[0] == 0 and cut.ends[-1] == 700 and (cut.starts[1:] == cut.ends[:-1] + 1).all()
    assert ((cut.anchors >= cut.ends) & (cut.anchors < cut.starts + 169)).all()


def test_equal_windows_have_equal_hashes():
    rng = random.Random(2)
    shared = rng.randbytes(260)
    a, b = (Windows(byte_grams(rng.randbytes(n) + shared + rng.randbytes(50), 32), 200, 32) for n in (77, 130))
    every = np.arange(61)
    assert (a.content(77 + every, 77 + every) == b.content(130 + every, 130 + every)).all()


def test_quicksort_orders_strings_of_any_length():
    rng = random.Random(7)
    strings = [rng.randbytes(rng.randint(0, 30)).replace(b"\x00", b"") for _ in range(300)]
    strings += [b"same" * 9] * 5 + [b"same" * 9 + b"x", b"", b""]
    order = multikey_quicksort(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)


@pytest.mark.parametrize("a, b, n", [(b"", b"x", 0), (b"abc", b"abd", 2), (b"abc", b"abc", 3), (b"x", b"y", 0), (b"ab", b"abc", 2)])
def test_common_prefix(a, b, n):
    assert common(a, b) == n


def test_automaton_knows_first_holders():
    automaton = Automaton()
    for i, text in enumerate([b"a b c d", b"b c d e a b", b"x b c", b"a b c d"]):
        automaton.add(text.split(), i)
    assert automaton.first_holders(b"z b c d e a b c q b c".split(), 3) == [(1, 0), (2, 1), (3, 1), (4, 1), (5, 0)] 
    assert automaton.first_holders(b"x b".split(), 2) == [(0, 2)]


def later_lines(rows, least=10):
    """Lines inside a run of 1, 2, 4, ... lines that stands earlier and has enough words."""
    places = sorted({(LOW if i is None else i, t or "") for i, t in rows}, key=lambda p: p[0])
    cut = {p: p[1].encode().split(b"\n") for p in places}
    gone, length = {p: set() for p in places}, 1
    while length <= max(map(len, cut.values())):
        seen = set()
        for p in places:
            for a in range(len(cut[p]) - length + 1):
                run = tuple(cut[p][a : a + length])
                if run in seen and sum(len(x.split()) for x in run) >= least:
                    gone[p] |= set(range(a, a + length))
                seen.add(run)
        length *= 2
    return cut, gone


def test_lines_of_odd_rows(odd):
    rows = [r[:2] for r in odd_rows() if r[0] != 14]
    cut, gone = later_lines(rows)
    want = Counter()
    for i, t in rows:
        p = (LOW if i is None else i, t or "")
        kept = b"\n".join(x for j, x in enumerate(cut[p]) if j not in gone[p])
        runs = sum(j - 1 not in gone[p] for j in gone[p])
        want[(i, len(cut[p]), len(gone[p]), runs, hashlib.sha256(kept).hexdigest())] += 1
    got = pairs(line_dedup(odd.where("doc_id is null or doc_id <> 14")), "n_lines", "n_removed", "n_runs", "kept_sha256")
    assert got == want


def test_short_lines_go_only_in_longer_runs(docs):
    one, two = "a b c d e f", "g h i j k l"
    df = docs(f"{one}\n{two}\nx", f"{one}\ny", f"z\n{one}\n{two}", f"{two}\n{one}")
    assert [(r.doc_id, r.n_removed) for r in line_dedup(df).orderBy("doc_id").collect()] == [(0, 0), (1, 0), (2, 2), (3, 0)]
    kept = {r.doc_id: (r.text, r.n_chars) for r in shortened_documents(df).collect()}
    assert kept[2] == ("z", 1) and kept[1] == (f"{one}\ny", None)


def test_runs_of_any_length_go(docs):
    """Against all run lengths: a run of three, and the short tail of a passage, have no power of two."""
    rng = random.Random(4)
    three, tail = "a b c d\ne f g h\ni j k l", " ".join(map(str, range(45))) + "\na\nb\n\nc\nd\ne"
    texts = [f"x\n{three}\ny", f"{tail}\nv", f"z\n{three}\nw", f"u\n{tail}"]
    for _ in range(40):
        texts.append("\n".join(rng.choice(["a", "b c", "d e f", "", "g h i j k"]) for _ in range(rng.randint(1, 20))))
    cut, seen, want = [t.split("\n") for t in texts], set(), []
    for lines in cut:
        gone = set()
        for b in range(1, len(lines) + 1):
            for a in range(b):
                run = tuple(lines[a:b])
                if run in seen and sum(len(x.split()) for x in run) >= 10:
                    gone |= set(range(a, b))
            # Runs that end further up or here may be the earlier copy of those that end below.
            seen |= {tuple(lines[a:b]) for a in range(b)}
        want.append(len(gone))
    assert want[2:4] == [3, 7]
    assert [r.n_removed for r in line_dedup(docs(*texts)).orderBy("doc_id").collect()] == want


def test_documents_left_without_words_are_gone(docs, odd):
    text = " ".join("abcdefghijkl")
    assert {r.doc_id for r in shortened_documents(docs(text, text, "", None)).collect()} == {0, 2, 3}
    assert shortened_documents(odd).columns == odd.columns
