"""Quality rules, WARC, site quality, URL filter, HTML text, LM scores and BPE."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import bpe, html_text, lm_scoring, quality_rules, site_quality, url_filter, warc
from flowgauge.llm.queries import QUERIES, tokenizer_path
from llm_rows import by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(120_000))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- quality rules ---------------------------------------------------------------------------


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def test_quality_measures_and_verdicts(docs_of):
    rng = random.Random(3)
    prose = lambda n: ". ".join(
        " ".join("".join(rng.choices("abcdefghijklmno", k=rng.randrange(2, 9))) for _ in range(9)).capitalize()
        for _ in range(n)) + "."
    texts = [prose(8) for _ in range(40)]
    junk = [" ".join(w + "***" for w in prose(6).split()) for _ in range(6)]
    junk += [" | ".join(prose(6).split()) for _ in range(6)]
    odd = [None, "", " \n\t ", "a b", "x\n\nx\n x \ny", "the the " * 60, prose(2) + "\n" + prose(1) * 4, LONG, "é𝄞#" * 30, texts[0]]
    rows = list(enumerate(texts + junk + odd)) + [(None, texts[1])]
    got = by_id(quality_rules.judge_quality(docs_of(rows)))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, text in rows:
        assert tuple(got[i][n] for n in names) == base_of(text), text and text[:50]
    assert all(got[i]["kept"] for i in range(40))
    assert not any(got[i]["kept"] for i in range(40, 52))
    assert quality_rules.judge_quality(docs_of([])).count() == 0


def test_rules_that_agree_are_trusted():
    rng = random.Random(1)
    model = quality_rules.RuleModel(rules=quality_rules.RULES[:4])
    accuracy, votes = (0.95, 0.9, 0.85, 0.55), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes[tuple((1 if (rng.random() < a) == good else -1) if rng.random() < 0.8 else 0 for a in accuracy)] += 1
    fitted = quality_rules.fit(list(votes.items()), model)
    assert fitted.good_share == pytest.approx(0.8, abs=0.03)
    assert fitted.accuracy == pytest.approx(accuracy, abs=0.05)
    with pytest.raises(RuntimeError):
        quality_rules.fit(list(votes.items()), quality_rules.RuleModel(rules=quality_rules.RULES[:4], max_rounds=2))


def test_quality_rules_run_no_python(docs_of):
    plan = quality_rules.measures(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


# ---- site quality ----------------------------------------------------------------------------


def test_sites_shrink_and_clean_texts_stay(spark):
    rng = random.Random(2)
    clean = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)).capitalize() + "."
    junk = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) + "***" for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, junk() if bad else clean(), "en" if i % 2 else "de", f"s{i % 5}", "x"))
        if i < 200:
            labels.append((i, 0 if bad else 1, "y"))
    rows += [(300, clean(), "en", "lone", "x"), (301, None, None, None, "x"), (302, "", "en", "s0", "x"),
             (None, clean(), "en", None, "x"), (5, rows[5][1], "en", "s0", "x")]
    labels += [(None, 1, "y"), (7, None, "y"), (8, 1, "y"), (8, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string")
    got = site_quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, site string"))
    found = got.collect()
    assert len(found) == len(rows)
    kept = by_id(got)
    assert all(kept[i]["kept"] == (i % 6 != 0) for i in range(300)) and kept[300]["kept"] and kept[None]["kept"]
    assert not kept[301]["kept"] and kept[302]["posterior"] == 0
    share = sum(r["doc_prob"] for r in found) / len(found)
    assert kept[300]["site_prob"] == pytest.approx(share, abs=1e-3)  # a lone document tells nothing of its site
    none = site_quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert sum(r["kept"] for r in none.collect()) == len(rows) - 2
    empty = site_quality.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, site string"))
    assert empty.count() == 0


def test_held_out_accuracy(spark):
    """Half of the labels are withheld."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = by_id(site_quality.classify(docs, labels.where("doc_id % 2 = 0")))
    held = [(r["quality"], got[r["doc_id"]]["kept"]) for r in labels.where("doc_id % 2 = 1").collect()]
    assert sum(bool(q) == k for q, k in held) >= 0.95 * len(held)


def strength_by_hand(groups, over):
    """``groups``: lists of doc_probs; ``over``: the share above each."""
    total = sum(map(len, groups))
    spread = sum(len(g) * (sum(g) / len(g) - o) ** 2 for g, o in zip(groups, over))
    noise = sum(sum(p * (1 - p) for p in g) / len(g) for g in groups)
    chance = sum(len(g) * max(o * (1 - o), 1e-6) for g, o in zip(groups, over))
    between = max(spread / total - noise / total, 0.0)
    return min(max(chance / total / between - 1, 1.0), 1e6) if between > 0 else 1e6


def test_shares_are_shrunken_as_defined(spark):
    """Site and section shares and posteriors, worked out from the evidence of the texts."""
    rng = random.Random(21)
    rows = []
    for i in range(400):
        site = rng.choice(["a", "a", "a", "b", "c", None])
        good = rng.random() < {"a": 0.9, "b": 0.2, "c": 0.6, None: 0.5}[site]
        words = "".join(rng.choices("abcdefgh", k=6)) if good else "$$$ ### x"
        rows.append((i, " ".join([words, "and the"] * rng.randrange(5, 30)), rng.choice(["en", "fr"]), site))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("$" not in t)) for i, t, _, _ in rows[::2]], "doc_id long, quality int")
    got = by_id(site_quality.classify(docs, labels))
    prob = {i: got[i]["doc_prob"] for i, *_ in rows}
    sites, sections = {}, {}
    for i, _, lang, site in rows:
        sites.setdefault(site, []).append(prob[i])
        sections.setdefault((site, lang), []).append(prob[i])
    share = sum(prob.values()) / len(prob)
    of_site = strength_by_hand(list(sites.values()), [share] * len(sites))
    above = [sum(sites[site]) / len(sites[site]) for site, _ in sections]
    of_section = strength_by_hand(list(sections.values()), above)
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for i, _, lang, site in rows:
        own, near = sites[site], sections[site, lang]
        site_prob = (of_site * share + sum(own) - prob[i]) / (of_site + len(own) - 1)
        path_prob = (of_section * site_prob + sum(near) - prob[i]) / (of_section + len(near) - 1)
        posterior = 1 / (1 + math.exp(-(odds(prob[i]) + odds(path_prob) - odds(share))))
        found = got[i]
        assert (found["site_prob"], found["path_prob"], found["posterior"]) == pytest.approx((site_prob, path_prob, posterior))
        assert found["kept"] == (found["posterior"] >= 0.5)


def test_the_labelled_sample_is_bounded_and_the_same(spark, monkeypatch):
    """Fitting on part of the labels takes those with the smallest hashes, whatever is sent."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    few = site_quality.SiteQuality(max_sample=40)
    taken = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40)
    assert by_id(site_quality.classify(docs, labels, few)).keys() == by_id(docs).keys()
    one, other = (by_id(site_quality.classify(docs, of, few)) for of in (labels, taken))
    assert all(one[i]["doc_prob"] == pytest.approx(other[i]["doc_prob"]) for i in one)


# ---- WARC ------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "same"), (5, "http://b", "same"),
            (3, "u", None), (4, "u", ""), (None, "u", "same"), (7, "u", "x" * 300_000), (5, "http://b", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write_archives(pages.repartition(2), str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert all(r["error"] is None for r in got)
    found = Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = i == largest[html or ""]
        name = f"<urn:page:{'' if i is None else i}>"
        want[name, "response" if first else "revisit", None if first else f"<urn:page:{largest[html or '']}>", len(data), digest] += 1
    assert found == want
    payloads = {r["record_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert payloads["<urn:page:1>"].decode() == rows[0][2]


def test_large_records_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_PAYLOAD", 1000)
    rows = [(i, "u", f"{i} " + "x" * (2000 if i % 3 == 0 else 10)) for i in range(9)] + [(20, "u", "0 " + "x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    sizes = [len(p.read_text().split("WARC/1.1")) - 1 for p in (tmp_path / "a").glob("*.txt") if p.stat().st_size > 1000]
    assert sizes.count(1) >= 3
    got = {r["record_id"]: (r["record_type"], r["payload_bytes"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert len(got) == 10 and got["<urn:page:0>"] == ("revisit", 2002) and got["<urn:page:20>"] == ("response", 2002)


def test_smaller_payloads_are_all_responses_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                                  "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"), min_payload=3)
    got = {r["record_id"]: r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert [got[f"<urn:page:{i}>"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def record(i, payload):
    data = payload.encode()
    return (warc.record_text(i, "http://a", payload, warc.payload_digest(data), len(data), None, "2024-01-01T00:00:00Z")
            + "\r\n\r\n").encode()


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress], ids=["plain", "gzip"])
def test_salvage_recovers_what_follows_damage(pack):
    rng = random.Random(6)
    parts = [pack(record(i, f"page {i} " * rng.randrange(1, 30))) for i in range(8)]
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    broken = bytearray(b"".join(parts))
    broken[starts[3] - 10 : starts[3] - 4] = b"XXXXXX"
    cut = bytes(broken[: starts[7] + 40])  # the last record is torn off
    found = list(warc.salvage(cut))
    names = [e.headers.get("warc-record-id") for e in found if not e.error]
    assert names == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5, 6)]
    gaps = [(e.start, e.end) for e in found if e.error]
    assert gaps == [(starts[2], starts[3]), (starts[7], len(cut))]
    assert list(warc.salvage(b"")) == [] and [e.error is None for e in warc.salvage(b"junk")] == [False]
    assert all(a.end == b.start for a, b in zip(found, found[1:]))  # no byte is unaccounted for


def test_salvage_looks_into_gzip_members():
    rng = random.Random(7)
    parts = [record(i, " ".join(str(rng.random()) for _ in range(3000))) for i in range(6)]
    names = lambda data: [e.headers.get("warc-record-id") for e in warc.salvage(data) if not e.error]
    whole = gzip.compress(b"".join(parts))
    found = list(warc.salvage(whole))
    assert [(e.start, e.end, e.error) for e in found] == [(0, len(whole), None)] * 6
    assert names(whole) == [f"<urn:page:{i}>" for i in range(6)]
    torn = list(warc.salvage(whole[: len(whole) * 3 // 4]))
    assert [e.headers.get("warc-record-id") for e in torn if not e.error] == [f"<urn:page:{i}>" for i in range(4)]
    assert sum(e.error is not None for e in torn) >= 1
    inner = bytearray(b"".join(parts))
    inner[len(parts[0]) + 5] = 0
    assert names(gzip.compress(inner) + gzip.compress(record(9, "after"))) == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5, 9)]


# ---- URL filter ------------------------------------------------------------------------------


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/x", "", "", None, "allow"),
    ("HTTP://WWW.Example.ORG/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/1234", "example.org", "/en/1234", "example.org/en/1", "block"),
    ("http://badexample.org/en/1", "badexample.org", "/en/1", "org/", "allow"),
    ("http://org?casino", "org", "", None, "block"), ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://a.com/fr/porn", "a.com", "/fr/porn", "com/fr/", "allow"),
    ("http://a.net/casino", "a.net", "/casino", None, "block"), ("http://a.net/casinos", "a.net", "/casinos", None, "allow"),
    ("http://a.net/bet-bet", "a.net", "/bet-bet", None, "allow"), ("http://a.net/bet-POKER", "a.net", "/bet-POKER", None, "block"),
    ("http://a.net#x://b/c", "a.net", "", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    got = by_id(url_filter.judge_urls(spark.createDataFrame([(1, url, "h")], "page_id long, url string, host string")), "page_id")[1]
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, verdict)


def test_url_tables(spark):
    schema = "page_id long, url string"
    assert url_filter.judge_urls(spark.createDataFrame([], schema)).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([(None, "http://" + "a" * 10**6), (1, "u"), (1, "u")], schema)).count() == 3


# ---- HTML ------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">one</a><li><a href="/b">two</a></ul></nav><div class="ad">Buy this now</div>
%s<div class="comments"><p>Nice article, thank you so much for writing all of this down.</p></div>
<aside>Also read these</aside><form><p>Subscribe here</p></form><footer>&copy; me</footer></body></html>"""
ARTICLE = "<h1>A &amp; B</h1><p>First  <b>bold</b>text,\nlong enough to be the content.<p>Second&nbsp;one &lt;tag&gt;<br>with a break.</p>"
TEXT = "A & B First boldtext, long enough to be the content. Second one <tag> with a break."


@pytest.mark.parametrize("html, text", [
    (PAGE % f"<article>{ARTICLE}</article>", TEXT), (PAGE % f"<div id=main>{ARTICLE}</div>", TEXT),
    (PAGE % f"<main><section>{ARTICLE}</section></main>", TEXT), ("", ""), (None, ""), ("plain words", "plain words"),
    ("<p>", ""), ("<!-- no end", ""), ("a < b", "a < b"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<body>" + "<p>word</p>" * 20_000, " ".join(["word"] * 20_000)),
])
def test_main_text(html, text):
    assert " ".join(html_text.extract(html or "")) == text


def paragraphs(word, n, length=200):
    return "".join(f"<p>{(word + ' ') * (length // (len(word) + 1))}</p>" for _ in range(n))


LINKS = "<div><ul>" + "".join(f"<li><a href='/{i}'>linked page {i}</a>" for i in range(20)) + "</ul></div>"


@pytest.mark.parametrize("html, words", [
    (f"<section>{paragraphs('one', 5)}</section><section>{paragraphs('two', 5)}</section>", {"one", "two"}),
    (f"<section>{paragraphs('one', 6)}</section><section>{paragraphs('two', 2)}</section>", {"one", "two"}),
    (f"<main><article>{paragraphs('one', 5)}</article><article>{paragraphs('two', 3)}</article></main>", {"one", "two"}),
    (f"<div><div>{paragraphs('one', 5)}</div>{LINKS}</div>", {"one"}),
    (f"<div><h2>Title</h2><div>{paragraphs('one', 5)}</div><h2>More</h2>{LINKS}</div>", {"Title", "one"}),
    (f"{'loose ' * 100}<b>text</b><div>{paragraphs('one', 9)}</div>{LINKS}", {"loose", "text", "one"}),
])
def test_every_dense_branch_is_main_text(html, words):
    assert set(" ".join(html_text.extract(f"<html><body>{html}</body></html>")).split()) == words


@pytest.mark.parametrize("html, words", [
    *((f"<div class='{name}'>{paragraphs('one', 5)}</div>{LINKS}", {"one"})
      for name in ("content has-sidebar", "no-sidebar", "search-results", "social-science", "widget")),
    (f"<div id='search'><div>{paragraphs('one', 5)}</div><div class='comments'>{paragraphs('two', 2)}</div></div>", {"one"}),
    (f"<div>{paragraphs('one', 5)}</div><div class='box related'>{paragraphs('two', 2)}</div>", {"one"}),
    (f"<div>{paragraphs('one', 2)}</div><div class='menu'>{LINKS * 9}</div>", {"one"}),
    ("<div class='ad'>Buy this, it is longer.</div><article><p>one</p></article>", {"one"}),
    (f"<article>{paragraphs('one', 5)}<figure><img src=x><figcaption>A caption</figcaption></figure></article>", {"one", "A", "caption"}),
])
def test_names_are_evidence_only(html, words):
    assert set(" ".join(html_text.extract(f"<html><body>{html}</body></html>")).split()) == words


@pytest.mark.parametrize("mark", [
    'aria-hidden="false"', 'data-hidden="false"', 'title="hidden gems"', "title='a > b'", "data-class=ad", "CLASS = content",
])
def test_only_whole_attribute_names_count(mark):
    page = f"<html><body><div {mark}>{paragraphs('one', 5)}<p title='The hidden truth'>two</p></div>{LINKS}</body></html>"
    assert set(" ".join(html_text.extract(page)).split()) == {"one", "two"}


@pytest.mark.parametrize("mark", ["hidden", "HIDDEN=''", 'aria-hidden="true"', "style='color:red; display: none'"])
def test_hidden_parts_go(mark):
    page = f"<html><body><article>{paragraphs('one', 5)}<div {mark}>{paragraphs('two', 2)}</div></article></body></html>"
    assert set(" ".join(html_text.extract(page)).split()) == {"one"}


@pytest.mark.parametrize("name", ["comment-list", "comments_area", "reply-form", "disqus_thread"])
def test_readers_comments_go(name):
    page = f"<html><body><article>{paragraphs('one', 5)}<ol class='x {name}'>{paragraphs('two', 2)}</ol></article></body></html>"
    assert set(" ".join(html_text.extract(page)).split()) == {"one"}


@pytest.mark.parametrize("piece", ["<a ", "<a href='", '<a "', "<!", "<!--x", "</", "</b ", "<b>", "</i>", "<p>", "<", "<li>", "&lt"])
def test_broken_markup_takes_time_in_proportion(piece):
    start = time.perf_counter()
    html_text.extract("<html><body><p>text</p>" + piece * (300_000 // len(piece)))
    html_text.extract("<b>" * 10_000 + piece * (30_000 // len(piece)) + ">")
    assert time.perf_counter() - start < 20


def density_by_hand(node):
    """(chars, tags, link chars, link tags) from the definition, by walking down."""
    if isinstance(node, str):
        return len(" ".join(node.split())), 0, 0, 0
    parts = [(i, density_by_hand(i)) for i in node.items if isinstance(i, str) or not i.skip]
    chars = sum(p[0] for _, p in parts)
    tags = sum(p[1] + (not isinstance(i, str)) for i, p in parts)
    if node.tag == "a":
        return chars, tags, chars, tags
    links = sum(p[2] for _, p in parts)
    link_tags = sum(p[3] + (not isinstance(i, str) and i.tag == "a") for i, p in parts)
    return chars, tags, links, link_tags


def test_densities_follow_their_definition():
    rng = random.Random(6)
    for _ in range(60):
        page = "<html><body>"
        for _ in range(rng.randrange(2, 30)):
            page += rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "<ul><li>", "</ul>"])
            page += "word " * rng.randrange(12)
        root = html_text.parse(page)
        order = html_text._in_order(root)
        body = next(n for n in order if n.tag == "body")
        html_text.measure(order, body)
        chars, _, links, _ = density_by_hand(body)
        share = links / max(chars, 1)
        for node in order:
            c, t, lc, lt = density_by_hand(node)
            expected = 0.0
            if c:
                value = c / max(lc, 1) * max(t, 1) / max(lt, 1)
                base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
                expected = c / max(t, 1) * math.log(value) / base if value > 1 and base > 0 else 0.0
            assert node.density == pytest.approx(expected)
        for node in order:
            inline = [i for i in node.items if not isinstance(i, str) and i.tag in html_text.INLINE and i.tag != "a"]
            own = sum(density_by_hand(i)[0] for i in [*inline, *(i for i in node.items if isinstance(i, str))])
            blocks = [i for i in node.items if not isinstance(i, str) and i.tag not in html_text.INLINE]
            assert node.total == pytest.approx(own + sum(i.density for i in blocks))


def test_page_tables(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", PAGE % ARTICLE, "t"), (1, "u", PAGE % ARTICLE, "t"), (None, None, None, None)]
    got = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert len({r["n_blocks"] for r in got}) == 2 and len(got) == 3
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


# ---- LM scoring ------------------------------------------------------------------------------


@pytest.mark.parametrize("batch_bytes, slice_text", [(4_000_000, 16_000_000), (900, 100_000)])
def test_lm_scores(docs_of, monkeypatch, batch_bytes, slice_text):
    """Base scores are exact, also over many batches and slices; the model's are near those of exact
    counts of all pairs."""
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(lm_scoring, "SLICE_TEXT", slice_text)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ä", "X"]
    texts = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(202)], k=rng.randrange(0, 80))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(60, None), (61, ""), (62, LONG), (60, None), (None, "unseen words")]
    held = lambda i: i is None or i % 7 == 2
    out = lm_scoring.score_texts(docs_of(rows), F.col("doc_id").isNull() | (F.col("doc_id") % 7 == 2))
    got = by_id(out)
    tokens = {i: WORD.findall(lowered(t)) + ["\0end"] for i, t in rows}
    counts, pairs = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            counts.update(tokens[i])
            pairs.update(zip(["\0start", *tokens[i]], tokens[i]))
    total, distinct = sum(counts.values()), len(counts)
    starts = sum(not held(i) for i, _ in rows)
    for i, own in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(own), total)
        assert r["n_known"] == sum(counts[t] > 0 for t in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own))
        exact = 0.0
        for before, t in zip(["\0start", *own], own):
            c, h = pairs[before, t], starts if before == "\0start" else counts[before]
            exact += math.log10((c + 50 * (counts[t] + 1) / (total + distinct + 1)) / (h + 50))
        assert r["score"] / len(own) == pytest.approx(exact / len(own), abs=0.25)
    assert got[0]["false_rate"] < 0.05


def test_lm_without_training_and_without_rows(docs_of):
    got = by_id(lm_scoring.score_texts(docs_of([(1, "a b")]), F.lit(True)))
    assert got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0
    assert lm_scoring.score_texts(docs_of([]), F.lit(False)).count() == 0


def test_arrow_batches_of_questions_and_texts_are_bounded(docs_of, spark, monkeypatch):
    key, bounds, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], lm_scoring.written
    before = spark.conf.get(key, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 60, 1, 1).selectExpr("repeat(cast(id % 10 as string), 100000) AS text").repartition(1)
    assert write(texts.mapInArrow(sizes, "n long"), 500_000).agg(F.max("n")).first()[0] < 1_000_000
    assert spark.conf.get(key, None) == before
    monkeypatch.setattr(lm_scoring, "written", lambda df, *bound: bounds.append(bound) or write(df, *bound))
    assert lm_scoring.score_texts(docs_of([(1, "a b"), (2, "b c")]), F.lit(False)).count() == 2
    assert bounds == [(), (lm_scoring.ARROW_BYTES,), (lm_scoring.ARROW_BYTES,)]


def test_levels_hold_what_was_entered():
    model = lm_scoring.LogBloom()
    count = np.array([1, 2, 3, 4, 7, 8, 1000, 10**6])
    assert model.level(count).tolist() == [1, 2, 2, 3, 3, 4, 10, 20]
    assert model.count(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_lm_filter_grows_with_the_corpus(docs_of, monkeypatch):
    """A filter too large to be broadcast has as few false answers and gives the same scores."""
    rng = random.Random(8)
    texts = ["the end " + " ".join(f"v{rng.randrange(3000)}" for _ in range(400)) for _ in range(300)]
    docs = docs_of(list(enumerate(texts)) + [(300, None), (301, ""), (302, LONG), (None, "unseen words")])
    held = F.col("doc_id").isNull() | (F.col("doc_id") % 7 == 2)
    for slice_text in (1 << 24, 1 << 17):
        monkeypatch.setattr(lm_scoring, "SLICE_TEXT", slice_text)
        wide = by_id(lm_scoring.score_texts(docs, held))
        got = by_id(lm_scoring.score_texts(docs, held, lm_scoring.LogBloom(max_bytes=1 << 16)))
        assert len(got) == len(wide) and got[0]["false_rate"] == wide[0]["false_rate"] < 0.02
        for i, r in wide.items():
            assert got[i].pop("score") == pytest.approx(r["score"])
            assert got[i].pop("base_score") == pytest.approx(r["base_score"])
            assert got[i] == {k: v for k, v in r.items() if k not in ("score", "base_score")}


def test_lm_query_counts_pairs_seen_once(docs_of, spark, tmp_path):
    """Against exact counts of all pairs; most pairs of these texts are seen once."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"u{rng.randrange(300)}" for _ in range(40))) for i in range(30)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(QUERIES["op9_lm_scoring"](spark, str(tmp_path)))
    rows = [(i, t) for i, t in rows if not got[i]["held_out"]]
    tokens = {i: [*WORD.findall(t), "\0end"] for i, t in rows}
    counts = Counter(t for own in tokens.values() for t in own)
    pairs = Counter(p for own in tokens.values() for p in zip(["\0start", *own], own))
    assert sum(c == 1 for c in pairs.values()) > 0.9 * len(pairs)
    counts_before = counts + Counter({"\0start": len(rows)})
    total, distinct = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        exact = sum(
            math.log10((pairs[b, t] + 50 * (counts[t] + 1) / (total + distinct + 1)) / (counts_before[b] + 50))
            for b, t in zip(["\0start", *own], own))
        assert got[i]["score"] / len(own) == pytest.approx(exact / len(own), abs=0.1)


def test_lookup_of_a_full_filter_ends():
    grams = np.arange(5, dtype=np.uint64)
    assert lm_scoring.lookup(np.full(lm_scoring.CHUNK_BITS // 8, 255, np.uint8), 0, grams, 7).tolist() == [7] * 5


# ---- BPE -------------------------------------------------------------------------------------


def test_numbers_as_bytes():
    for values in ([], [0], [5, 0, 255], [256, 2**40], [2**64 - 1]):
        whole = np.array(values, np.uint64)
        assert lm_scoring.unpack(lm_scoring.pack(whole)).tolist() == values
        if values:
            assert lm_scoring.unpack_names(lm_scoring.pack_names(np.sort(whole))).tolist() == sorted(values)


def test_bpe_is_exact():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as file:
        own = bpe.WordBpe(file.read())
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC 0123456789'!?.,;<>|/w_-éßΣσαİǅ中文日本\u200b\u0300\u0085\t\n\x1c\x0b🎉👍🏽ﬁ²½Ⅷ"
    tokens = [t.replace("</w>", "") for t in own.id_of]
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choices(tokens, k=rng.randrange(1, 5))) for _ in range(3000)]
    texts += ["", " \n", "a" * 5000, "ab" * 2000, "<|endoftext|>x<|startoftext|>", "</w></w>", "don't I'LL 's 's", "\x00"]
    marks = [chr(c) for c in (*range(0x300, 0x370), 0xC3C, 0x1715, 0x10940, 0x1C89, 0xA7CB, 0x1100, 0x1161, 0x11A8)]
    texts += ["".join(rng.choices(marks + list("aéΣ 1"), k=rng.randrange(1, 20))) for _ in range(1500)]
    # Every code point but surrogates, some hundreds to a text.
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["a".join(points[k : k + 300]) for k in range(0, len(points), 300)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == expected, text
        assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_bpe_tables(docs_of):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, None), (2, ""), (3, LONG)]
    out = bpe.encode_decode(docs_of(rows), tokenizer_path())
    got = out.collect()
    assert len(got) == 5
    kept = by_id(out)
    assert kept[1]["decoded"] == "hello</w> world</w>" and kept[2]["ids"] == [] and kept[None]["decoded"] == ""
    assert len(kept[3]["ids"]) > 120_000
    assert bpe.encode_decode(docs_of([]), tokenizer_path()).count() == 0


def test_long_pieces_are_encoded_but_not_remembered():
    from flowgauge.llm import bpe
    from flowgauge.llm.queries import tokenizer_path

    with open(tokenizer_path(), encoding="utf-8") as file:
        known = bpe.remembering(bpe.WordBpe(file.read()))
    long = [f"{k}" * 5_000 for k in range(10, 60)]
    assert all(known[piece][0] for piece in long) and known["short"][0]
    assert [*known] == ["short"] and not known.older


def test_remembered_pieces_stay_below_their_bound(monkeypatch):
    from flowgauge.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 10)
    made = []
    known = bpe._Remembered(lambda key: made.append(key) or key, bpe.REMEMBERED_PIECES)
    assert [known[f"{k % 25}"] for k in range(200)] == [f"{k % 25}" for k in range(200)]
    assert len(known) <= 10 and len(known.older) <= 10 and len(set(made)) == 25
