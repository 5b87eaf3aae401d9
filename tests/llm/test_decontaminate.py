from __future__ import annotations

import random
import re

import numpy as np
import pytest

from llm_rows import by_id
from flowgauge.llm import decontaminate
from flowgauge.llm.common import ALNUM, word_hashes, words
from flowgauge.llm.decontaminate import find_contamination, remove_contamination
from flowgauge.llm.fm_index import FmIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width):
    out = {}
    for i, text in rows:
        w, hit, names = tokens(text), set(), set()
        for name, item in items:
            own = tokens(item)
            for a in range(max(len(own) - width, 0) + 1 if own else 0):
                window = own[a : a + width]
                for k in range(len(w) - len(window) + 1):
                    if w[k : k + len(window)] == window:
                        hit |= set(range(k, k + len(window)))
                        names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def result(df):
    return {
        i: (r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), r["items"])
        for i, r in by_id(df).items()
    }


@pytest.mark.parametrize("block_bytes", [10**6, 150])
def test_against_brute_force(spark, docs_of, block_bytes):
    """One block of items, and several whose hits must be merged."""
    rng = random.Random(5)
    vocabulary = ["a", "B", "c", "dé", "9"]
    make = lambda n: rng.choice([" ", ", "]).join(rng.choices(vocabulary, k=n))
    rows = [(i, make(rng.randrange(0, 50))) for i in range(30)] + [(30, None), (31, ""), (32, "-- !")]
    items = [(i, make(rng.choice([0, 2, 3, 4, 7]))) for i in range(12)] + [(12, None), (3, make(6))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = result(find_contamination(docs_of(rows), benchmark, 4, block_bytes=block_bytes))
    assert got == brute(rows, items, 4)


def test_spans_are_cut_and_the_rest_stays(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "one two three"), (None, "four five")], "item_id long, text string")
    rows = [(1, "Zero, ONE two\nthree; end."), (2, "é four five"), (3, "clean"), (None, "one two three"), (4, None)]
    docs = docs_of(rows)
    out = remove_contamination(docs, benchmark)
    assert out.columns == docs.columns
    got = by_id(out)
    assert [got[i]["text"] for i in (1, 2, 3, None, 4)] == ["Zero,  ; end.", "é  ", "clean", " ", None]
    assert by_id(find_contamination(docs, benchmark))[2]["items"] == ["null"]


def test_rows_that_share_an_id_are_cleaned_each_by_its_text(spark, docs_of):
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    rows = [(7, "one two three x"), (7, "one two three x"), (7, "another clean text"), (None, "one two three x")]
    got = sorted((str(r.doc_id), r.text) for r in remove_contamination(docs_of(rows), benchmark).collect())
    assert got == [("7", "  x"), ("7", "  x"), ("7", "another clean text"), ("None", "  x")]


def mirrored_words():
    """A word over two letters and its mirror image, which sums of powers can't tell apart."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_sums_of_powers_confuse_are_told_apart(spark, docs_of):
    one, other = mirrored_words()
    benchmark = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert result(find_contamination(docs_of([(1, other), (2, one)]), benchmark)) == {1: (1, 0, []), 2: (1, 1, ["1"])}


def test_word_hashes():
    rng = random.Random(12)
    made = {}
    text = " ".join("".join(rng.choices("ab", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 3000]))) for _ in range(3000))
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    for a, b, h in zip(starts, ends, word_hashes(data, starts, ends).tolist()):
        assert made.setdefault(text[a:b], h) == h
    assert len(set(made.values())) == len(made)
    assert len(word_hashes(data, starts[:0], ends[:0])) == 0


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(find_contamination(docs_of([(1, "a b")]), none)) == {1: (2, 0, [])}
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_contamination(docs_of([]), some).count() == 0


def test_repeated_rows_and_a_long_text(spark, docs_of):
    rng = random.Random(8)
    phrase = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(rng.choice(phrase.split()) for _ in range(200_000)) + " " + phrase
    some = spark.createDataFrame([(7, phrase)], "item_id long, text string")
    rows = [(1, long), (2, phrase), (2, phrase)]
    found = find_contamination(docs_of(rows), some, block_bytes=5).collect()
    assert sorted((r["doc_id"], len(r["hits"]) > 0, r["items"]) for r in found) == [
        (1, True, ["7"]), (2, True, ["7"]), (2, True, ["7"])
    ]


@pytest.mark.parametrize("name", [7, None])
def test_rows_of_one_item_are_spread_over_blocks(spark, docs_of, monkeypatch, name):
    taken, phrases_of = [], decontaminate.phrases_of
    monkeypatch.setattr(decontaminate, "phrases_of", lambda rows, width: (
        taken.append(sum(len(text) for _, text in rows)), phrases_of(rows, width))[1])
    items = [(name, f"k{i} l{i} m{i} n{i} o{i}") for i in range(200)] + [(name, "same words all over")] * 200
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"x {items[i * 9][1]} y {items[300][1]}" if i % 2 else f"k{i} l{i}") for i in range(20)]
    got = result(decontaminate.find_contamination(docs_of(rows), benchmark, 4, block_bytes=1000))
    assert len(taken) > 3 and max(taken) < 2000
    assert got == brute(rows, [("null" if i is None else i, text) for i, text in items], 4)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = np.append(rng.integers(0, 4, rng.integers(1, 80)), 0)
        order = suffix_array(text)
        keys = [tuple((-1, k) if s == 0 else (s, 0) for k, s in enumerate(text[i:], i)) for i in order]
        cut = [k[: [x[0] for x in k].index(-1) + 1] for k in keys]
        assert cut == sorted(cut)
        index = FmIndex(text, 4)
        phrases = rng.integers(1, 4, (20, 3))
        lo, hi = index.search(phrases, np.full(20, 3))
        for p, a, b in zip(phrases, lo, hi):
            want = [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
