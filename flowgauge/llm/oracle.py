"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from flowgauge.llm import secret_ledger
from flowgauge.llm.url_filter import RULES, UrlVocabulary

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


def _url_filter() -> str:
    vocabulary = UrlVocabulary()

    def count(terms: tuple[str, ...]) -> str:
        return " + ".join(
            rf"CAST(regexp_matches(u, '(^|[^\pL\pN]){t}($|[^\pL\pN])') AS INTEGER)" for t in terms
        )

    by_length = sorted(RULES, key=lambda r: -len(r.name))
    fits = {
        r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
        for r in by_length
    }
    rule = " ".join(f"WHEN {fits[r]} THEN '{r.name}'" for r in by_length)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{r.verdict}'" for r in by_length)
    return f"""
WITH cut AS (
  SELECT page_id, {_lowered("coalesce(url, '')")} AS u,
    CASE WHEN contains(coalesce(url, ''), '://')
      THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, u, {_lowered("regexp_extract(rest, '^[^/]*')")} AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
  FROM cut
), hits AS (
  SELECT *, {count(vocabulary.strict)} AS any_strict, {count(vocabulary.soft)} AS soft_hits
  FROM parts
)
SELECT page_id, host, path, CASE {rule} END AS rule, soft_hits,
  CASE {verdict} WHEN any_strict > 0 OR soft_hits >= {vocabulary.soft_limit} THEN 'block'
  ELSE 'allow' END AS verdict
FROM hits
"""


def _warc() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [f"CAST('0x' || substr(sha, {5 * g + 1}, 5) AS BIGINT)" for g in range(8)]
    base32 = " || ".join(
        f"substr('{letters}', CAST(1 + (({v} >> {shift}) & 31) AS INTEGER), 1)"
        for v in groups for shift in (15, 10, 5, 0)
    )
    return f"""
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS sha
  FROM pages
), largest AS (SELECT sha, max(page_id) AS largest FROM payloads GROUP BY sha)
SELECT page_id, payload_bytes, {base32} AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM payloads JOIN largest USING (sha)
"""


def _decontaminate(width: int = 10) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def split(table: str, key: str) -> str:
        return f"""SELECT {key}, regexp_extract_all({_lowered("coalesce(text, '')")}, '{word}') AS w
  FROM {table}"""

    return f"""
WITH d AS ({split("documents", "doc_id")}), i AS ({split("benchmark", "item_id")}),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {width}) AS n, array_to_string(w[k : k + {width - 1}], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {width}, 0) + 2)) AS k FROM i WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
found AS (
  SELECT p.doc_id, p.k, x.n, x.item_id
  FROM places p JOIN lengths l ON p.k + l.n - 1 <= len(p.w)
  JOIN windows x ON x.n = l.n AND x.t = array_to_string(p.w[p.k : p.k + l.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items,
    sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _prefix_trie(family: int = 20) -> str:
    # CRC-32, bit by bit over the digits of the number.
    bit = "lambda r, k: xor(r >> 1, (r & 1) * 3988292384::BIGINT)"
    byte = f"lambda r, b: list_reduce(range(8), {bit}, xor(r, b))"
    digits = "list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])::BIGINT)"
    crc = f"xor(list_reduce({digits}, {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""
WITH own AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), drawn AS (
  SELECT c, turns, c - (c % {family} + {family}) % {family} AS base, CAST({crc} % 4 AS BIGINT) AS h
  FROM (SELECT *, CAST(c AS VARCHAR) AS t FROM own)
), rebuilt AS (
  SELECT d.c, CASE WHEN d.c = d.base THEN d.turns
    ELSE list_concat(coalesce(b.turns, [])[1 : d.h], d.turns[d.h + 1 :]) END AS turns
  FROM drawn d LEFT JOIN own b ON b.c = d.base
), prefixes AS (
  SELECT c, turns[1 : d] AS prefix, d AS depth, len(turns) AS n
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, max(n) > depth AS has_child,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256,
    (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(prefix)[-1].text, ''), '[^\\x20\\x09-\\x0D]+')) AS own_saved
  FROM prefixes GROUP BY prefix, depth
), below AS (
  SELECT a.prefix, sum(n.own_saved) AS saved_tokens, count(*) FILTER (NOT n.has_child) AS n_leaves,
    count(*) FILTER (n.depth = a.depth + 1) AS n_children
  FROM nodes a JOIN nodes n ON n.depth >= a.depth AND n.prefix[1 : a.depth] = a.prefix
  GROUP BY a.prefix
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1 : n.depth - 1] AND p.depth = n.depth - 1
"""


def _fill_middle() -> str:
    return """
WITH digests AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), drawn AS (
  SELECT *, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (n + 1) AS x,
    CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (n + 1) AS y,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 AS z,
    CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 AS q
  FROM digests
), formed AS (
  SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR z >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form,
    substr(text, 1, least(x, y)) AS p, substr(text, least(x, y) + 1, abs(x - y)) AS m,
    substr(text, greatest(x, y) + 1) AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(x, y) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN abs(x - y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM formed
"""


def _secrets() -> str:
    def kind(number: int, rule: secret_ledger.SecretRule) -> str:
        pattern = rule.pattern.replace("'", "''")
        flags = ", 'i'" if rule.ignore_case else ""
        regex = f"{'(?i)' if rule.ignore_case else ''}{pattern}"
        value = f"regexp_extract(found, '{pattern}', {rule.group}{flags})" if rule.group else "found"
        chars = f"string_split({value}, '')"
        share = f"(list_count(list_filter({chars}, lambda y: y = x)) / length({value}))"
        entropy = f"-list_sum(list_transform(list_distinct({chars}), lambda x: {share} * log2({share})))"
        tests = [f"length({value}) >= {rule.least}"] + [f"{entropy} >= {rule.entropy}"] * (rule.entropy > 0)
        return f"""
  SELECT blob, {number} AS rank, '{rule.kind}' AS kind, first, first + length(found) AS last
  FROM (
    SELECT blob, founds[k] AS found,
      CAST(list_sum(list_transform(parts[1 : k], lambda x: length(x)))
        + coalesce(list_sum(list_transform(founds[1 : k - 1], lambda x: length(x))), 0) AS BIGINT) AS first
    FROM (
      SELECT *, unnest(range(1, len(founds) + 1)) AS k
      FROM (SELECT blob, regexp_extract_all(text, '{regex}') AS founds,
        string_split_regex(text, '{regex}') AS parts FROM blobs)
    )
  ) WHERE {" AND ".join(tests)}"""

    spans = " UNION ALL ".join(kind(k, r) for k, r in enumerate(secret_ledger.RULES))
    base = ", ".join(f"'{r.kind}'" for r in secret_ledger.BASE_RULES)
    listed = "string_agg(kind || ':' || first || ':' || last, ',' ORDER BY first, rank)"
    counts = ", ".join(
        f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_ledger.BASE_RULES)
    counted = ", ".join(
        f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_ledger.BASE_RULES)
    return f"""
WITH addressed AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS blob, coalesce(text, '') AS text FROM documents
), blobs AS (SELECT blob, any_value(text) AS text FROM addressed GROUP BY blob),
spans AS ({spans}
), findings AS (
  SELECT blob, {counted}, {listed} AS spans, {listed} FILTER (kind IN ({base})) AS base
  FROM spans GROUP BY blob
)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM addressed LEFT JOIN findings USING (blob)
"""


def statements() -> dict[str, str]:
    return {
        "op3_warc": _warc(),
        "op4_decontaminate": _decontaminate(),
        "op6_url_filter": _url_filter(),
        "op11_prefix_trie": _prefix_trie(),
        "op12_fill_middle": _fill_middle(),
        "op13_secret_ledger": _secrets(),
    }
