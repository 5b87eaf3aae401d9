from __future__ import annotations

import random

import pytest

from llm_rows import by_id
from flowgauge.llm import suffix_dedup
from flowgauge.llm.suffix_dedup import remove_repeats


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for at in range(len(data) - length + 1):
            piece = data[at : at + length]
            if piece in seen:
                covered[at : at + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out[i] = (len(data), len(data) - len(kept), spans, kept)
    return out


def result(df):
    return {
        i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in by_id(df).items()
    }


@pytest.mark.parametrize("length, shard", [(20, 700), (8, 10**6), (21, 300)])
def test_against_brute_force(docs_of, monkeypatch, length, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = random.Random(length)
    pool = ["".join(rng.choices("abcé ", k=rng.randrange(1, 60))) for _ in range(25)]
    texts = ["".join(rng.choices(pool, k=rng.randrange(0, 6))) for _ in range(60)]
    texts += ["ab" * 60, "a" * 90, "a" * 200, "", None, "é" * 40, "è" * 40] + texts[:5]
    rows = list(enumerate(texts))
    assert result(remove_repeats(docs_of(rows), length)) == brute(rows, length)


def test_hundred_bytes_are_the_limit(docs_of):
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefghij", k=100))
    rows = [(1, "x" + passage + "y"), (2, "u" + passage + "v"), (3, "u" + passage[:99] + "!"), (4, passage)]
    got = result(remove_repeats(docs_of(rows)))
    assert [got[i][1] for i in (1, 2, 3, 4)] == [0, 100, 100, 100]
    assert got[2][3] == b"uv" and got[3][3] == b"!" or got[3][1] == 100


def test_repeated_rows_missing_ids_and_characters_cut_in_two(docs_of):
    passage = "".join(random.Random(9).choices("abcdefghij", k=150))
    rows = [(1, passage), (1, passage), (None, passage), (3, "é" + passage), (2, "è" + passage + "ü")]
    out = [(r["doc_id"], r["n_removed"]) for r in remove_repeats(docs_of(rows)).collect()]
    assert sorted(out, key=str) == sorted([(1, 0), (1, 0), (None, 150), (3, 150), (2, 150)], key=str)
    half = "é" + "x" * 99, "ù" + "x" * 99  # both end their first character differently
    cut = remove_repeats(docs_of([(1, "a" + half[0][:1] + "q"), (2, half[0]), (3, half[0])]), 100, as_text=True)
    assert by_id(cut)[3]["kept"] == ""


def test_empty_table_and_short_length(docs_of):
    assert remove_repeats(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs_of([]), 3)


def test_a_very_long_text(docs_of):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2_500_000))
    got = result(remove_repeats(docs_of([(1, long), (2, "z" + long[1_000_000:1_000_500])])))
    assert got[1][1] == 0 and got[2][:3] == (501, 500, 1)


def test_strings_around_a_common_phrase_are_not_sent(docs_of, monkeypatch):
    """A phrase shorter than the strings puts those around it under one q-gram, but their cores differ."""
    rng = random.Random(11)
    phrase = "".join(rng.choices("abcdefghij", k=40))
    rows = [(i, phrase.join("".join(rng.choices("klmnopqrst", k=300)) for _ in range(2))) for i in range(20)]
    sent, strings = [], suffix_dedup._strings
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "_strings", lambda *a: sent.append(strings(*a)) or sent[-1])
    assert result(remove_repeats(docs_of(rows))) == brute(rows, 100)
    assert [s.count() for s in sent] == [0]
