from __future__ import annotations

import random
import re

import numpy as np
import pytest

from llm_rows import by_id
from flowgauge.llm import jaccard_join
from flowgauge.llm.components import components
from flowgauge.llm.jaccard_join import Similarity, block_links, jaccard_components, one_per_component


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, like):
    sets = [(i, shingles(t, like.width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            both = len(x & y)
            if both and like.den * both >= like.num * (len(x) + len(y) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def family(rng, size, n_words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(n_words)]
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(n_words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("like", [Similarity(), Similarity(4, 5, 5), Similarity(1, 2, 2)])
def test_against_all_pairs(docs_of, like):
    """Small families and one with far more rows than a column may have before it is blocked."""
    rng = random.Random(7)
    texts = [t for size in (2, 3, 5) for t in family(rng, size, 60, 3)] + list(family(rng, 70, 120, 6))
    texts += [" ".join(f"v{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    texts += ["one", "One", "one two three", "ONE two\tthree", "", "  \n", "a b c d"] + texts[:4]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = by_id(jaccard_components(docs_of(rows), like))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(rows, like)


def test_nulls_repeats_and_missing_ids(docs_of):
    rows = [(5, None), (4, ""), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "lonely words here")]
    got = sorted(
        ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(rows)).collect()),
        key=str,
    )
    assert got == sorted(
        [(5, 0, 5), (4, 0, 4), (3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None)], key=str
    )


def test_empty_table(docs_of):
    out = jaccard_components(docs_of([]))
    assert out.columns[:3] == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_one_row_of_each_component_stays(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(9, text), (2, text + " more"), (2, text + " more"), (7, "other text"), (1, ""), (None, text)]
    kept = one_per_component(docs_of(rows), Similarity(4, 5, 5))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 7]
    assert "hits" in kept.columns


def test_a_very_long_text(docs_of):
    rng = random.Random(1)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:290_000])), (3, "w1 w2 w3 w4 w5")]
    got = by_id(jaccard_components(docs_of(rows)))
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 3]


def test_block_product_against_sets():
    rng = np.random.default_rng(3)
    like = Similarity(3, 5, 4)
    for same in (True, False):
        blocks = [
            [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(20)]
            for _ in range(1 if same else 2)
        ]
        rows, cols = block_links([], blocks, like)
        want = {
            (i, j) for i, x in enumerate(blocks[0]) for j, y in enumerate(blocks[-1])
            if (not same or i < j) and 5 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y))
        }
        assert set(zip(rows.tolist(), cols.tolist())) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 160)} == {100}
    assert found[300] == found[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_that_sums_of_powers_confuse_are_not_linked(docs_of):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    got = by_id(jaccard_components(docs_of([(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one)])))
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 1}


def test_no_family_by_a_few_common_columns(docs_of, monkeypatch):
    """Different texts with some passages in common, which lie among the rarest columns if these are
    ordered by chance, are no family: each would meet all others."""
    rng = random.Random(5)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(4)) for _ in range(30)]
    texts = []
    for _ in range(40):
        parts = [*passages, *(" ".join(f"u{rng.randrange(10**9)}" for _ in range(8)) for _ in range(30))]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [f"{t} more" for t in texts[:3]]
    members = []
    links = jaccard_join._family_links
    monkeypatch.setattr(jaccard_join, "_column_counts", lambda survey: np.zeros(jaccard_join.COUNT_CELLS, np.int32))
    monkeypatch.setattr(jaccard_join, "_family_links", lambda m, like: members.append(m.count()) or links(m, like))
    rows = list(enumerate(texts))
    got = by_id(jaccard_components(docs_of(rows)))
    assert members == [0]
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute(rows, Similarity())
