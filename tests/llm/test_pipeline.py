"""The pipeline against a plain version of each stage, on planted cases."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from flowgauge.llm.queries import tokenizer_path
from llm_rows import by_id
from test_decontaminate import WORD
from test_jaccard import brute as near_groups
from test_suffix import brute as without_repeats


def write(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() + ("." if k % 9 == 8 else "") for k in range(n)) + "."
    passage, items = prose(60), [prose(14) for _ in range(4)]
    rows, labels = [], []
    for i in range(60):
        rows.append((i, prose(rng.randrange(40, 90))))
        labels.append((i, 1, 0))
    for i in range(60, 80):
        rows.append((i, " ".join(w + "***" for w in prose(50).split())))
        labels.append((i, 0, 0))
    rows += [(80, rows[3][1]), (81, rows[4][1].replace(" ", "  ", 3) + " end"), (82, prose(30) + " " + passage),
             (83, passage.upper() + prose(3)), (84, prose(20) + "\n" + passage + "\né" + prose(20)),
             (85, prose(25) + " " + items[0].upper() + " " + prose(25)), (86, items[1]), (87, None), (88, ""),
             (None, "no id " + passage), (5, rows[5][1])]
    docs = [(i, t, "en", f"src{k % 4}", len(t or "")) for k, (i, t) in enumerate(rows)]
    for name, data, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", list(enumerate(items)), "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return rows, items


def cut(text, items, width=10):
    """The text with runs of hit words replaced by a space."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    found = list(WORD.finditer(low))
    words, hit = [m[0] for m in found], set()
    for item in items:
        own = WORD.findall(item.lower())
        for a in range(len(own) - width + 1):
            for k in range(len(words) - width + 1):
                if words[k : k + width] == own[a : a + width]:
                    hit |= set(range(k, k + width))
    parts, at = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            parts.append(text[at : found[k].start()])
        if k + 1 not in hit:
            at = found[k].end()
    return " ".join([*parts, text[at:]])


def test_stages_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = write(spark, str(tmp_path))
    docs, results = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        results.append(docs)
    texts = dict(rows)
    kept = {r["doc_id"] for r in results[0].collect()}
    assert kept >= set(range(60)) | {80, 81, 82, 84, 85, None} and not kept & (set(range(60, 80)) | {87, 88})
    named = [(i, texts[i]) for i in kept if i is not None]
    near = near_groups(named, corpus_pipeline.NEAR)
    single = {i: texts[i] for i, _ in named if near[i][1] == i}
    assert {80, 81} & set(single) == set()
    # The row without an id is a near copy of 83, which stays.
    assert 83 in single and {r["doc_id"] for r in results[1].collect()} == set(single)
    plain = {i: r[3].decode("utf-8", "ignore") for i, r in without_repeats(list(single.items()), 100).items()}
    plain = {i: t for i, t in plain.items() if t.strip()}
    assert {i: r["text"] for i, r in by_id(results[2]).items() if i is not None} == plain
    clean = {i: cut(t, items) for i, t in plain.items()}
    clean = {i: t for i, t in clean.items() if t.strip()}
    found = by_id(results[3])
    assert {i: r["text"] for i, r in found.items() if i is not None} == clean
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    for stage in results[:-1]:
        assert set(stage.columns) == set(corpus_pipeline.COLUMNS)
    library = Tokenizer.from_file(tokenizer_path())
    last = by_id(results[4])
    assert {i: r["ids"] for i, r in last.items() if i is not None} == {
        i: library.encode(t, add_special_tokens=False).ids for i, t in clean.items()
    }


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path / "full"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_ids_go_through_all_stages(spark, tmp_path):
    rows, items = write(spark, str(tmp_path / "with_ids"))
    docs = spark.read.parquet(f"{tmp_path}/with_ids/documents.parquet").where("doc_id IS NOT NULL")
    own = "a text that only this row has and that reads like the others do in this small corpus of ours"
    more = [rows[65][1], rows[3][1], own, own, f"{own} {items[2]} {own[::-1]}"]  # junk, a copy, twins, benchmark
    extra = spark.createDataFrame(
        [(None, t, "en", f"src{k % 4}", len(t)) for k, t in enumerate(more)], docs.schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/with_ids/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        left.append(sorted(r.text for r in docs.where("doc_id IS NULL").collect()))
    assert left[0] == sorted(more[1:])
    assert left[1] == sorted([own, more[4]])
    assert not any(items[2] in t for t in left[3]) and len(left[3]) == 2
    assert docs.where("doc_id = 3").count() == 1
