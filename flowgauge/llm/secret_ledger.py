"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content, the SHA-256 of its bytes. The ledger is a table
that says which blob was scanned by which version of which rule, and what was found. A scan reads
only the pairs of blob and rule version that the ledger lacks; findings are then joined back to all
the rows (paths, versions) that hold the blob. A changed rule gets another version by itself.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import maybe_in, membership_bitmap, slices, written


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches of ``pattern`` over the bytes; of these stay the ones whose
    ``group`` has ``least`` characters or more and, if asked for, ``entropy`` bits a character."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    entropy: float = 0.0
    ignore_case: bool = False

    @property
    def version(self) -> str:
        """Changes with anything that changes what the rule finds."""
        parts = (self.kind, self.pattern, self.group, self.least, self.entropy, self.ignore_case)
        return f"{self.kind}@{hashlib.sha256(repr(parts).encode()).hexdigest()[:16]}"


# The kinds that every scan looks for.
BASE_RULES = (
    SecretRule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=6, ignore_case=True,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", r"[0-9a-f]+", least=24),
)
#: Rules beside them, in the order in which equal starts are listed.
MORE_RULES = (
    SecretRule(
        "private_key",
        r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]*"
        r"(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?",
    ),
    SecretRule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("login", r"://[A-Za-z0-9._%+-]{1,64}:([A-Za-z0-9._%+!$*-]{3,128})@", group=1),
    SecretRule("bearer", r"\bbearer\x20+([A-Za-z0-9+/_.=-]+)", group=1, least=16, entropy=3.0, ignore_case=True),
    SecretRule("prefixed", r"\b(?:gh[a-z]_|xox[a-z]-|[a-z]{2}_live_)[A-Za-z0-9-]+", least=20, entropy=3.0),
)
RULES = BASE_RULES + MORE_RULES


def entropy(value: bytes) -> float:
    """Bits a character of the value's own letter frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


class _Scanner:
    def __init__(self, rules: Sequence[SecretRule]):
        self.rules = []
        for rule in rules:
            # One class repeated: short runs need not be looked at one by one.
            single = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
            pattern = f"{single[1]}{{{rule.least},}}" if single and rule.least else rule.pattern
            flags = re.IGNORECASE if rule.ignore_case else 0
            self.rules.append((rule, re.compile(pattern.encode(), flags)))

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, number of the rule) over bytes."""
        found = []
        for number, (rule, pattern) in enumerate(self.rules):
            for match in pattern.finditer(text):
                value = match[rule.group]
                if len(value) >= rule.least and (not rule.entropy or entropy(value) >= rule.entropy):
                    found.append((match.start(), match.end(), number))
        return found


_FOUND = "array<struct<rule: string, kind: string, start: long, `end`: long>>"
_LEDGER = f"blob binary, rules array<string>, found {_FOUND}"


def _address(data: pa.Array | str):
    return F.unhex(F.sha2(F.col(data).cast("binary"), 256))


class SecretLedger:
    """A ledger in ``folder``: rows (blob, rules: versions that the row covers, found), appended by
    each scan in one commit. A scan that dies leaves nothing, and the next one repeats it; pairs
    that two scans recorded at once are read as one."""

    def __init__(self, spark: SparkSession, folder: str, rules: Sequence[SecretRule] = RULES):
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("rules must have kinds of their own")
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), tuple(rules)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], _LEDGER).write.mode("append").parquet(self.folder)

    @property
    def versions(self) -> list[str]:
        return [r.version for r in self.rules]

    def entries(self) -> DataFrame:
        return self.spark.read.schema(_LEDGER).parquet(self.folder)

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """(blob, rules): the present rule versions that each distinct blob was not scanned by."""
        seen = self.entries().select("blob", F.explode("rules").alias("rule"))
        seen = seen.where(F.col("rule").isin(self.versions)).groupBy("blob").agg(
            F.collect_set("rule").alias("seen")  # no more than there are rules
        )
        every = F.array(*map(F.lit, self.versions))
        lacking = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        return (
            blobs.select("blob").distinct().join(seen, "blob", "left")
            .select("blob", lacking.alias("rules")).where(F.size("rules") > 0)
        )

    def scan(self, texts: DataFrame, text_col: str = "text") -> DataFrame:
        """Scan what is unseen and append it. Returns the inventory: the columns of ``texts`` but
        the text, and ``blob``.

        Copies are combined before the texts move, and texts that are surely known stay where they
        are: a bitmap of bounded size says which rows may hold an unseen blob.
        """
        if "blob" in texts.columns:
            raise ValueError("the rows already have a column 'blob'")
        addressed = texts.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))).withColumn(
            "blob", _address(text_col))
        inventory = written(addressed.drop(text_col))
        unseen = written(self.unseen(inventory))
        total, open_blobs = inventory.select("blob").distinct().count(), unseen.count()
        if open_blobs == 0:
            return inventory
        # Names only choose which texts move; the join below decides.
        wanted = addressed.select("blob", F.col(text_col).alias("text"))
        if open_blobs < total:
            wanted = _may_hold(wanted, unseen)
        held = wanted.groupBy("blob").agg(F.first("text").alias("text"))
        found = held.join(unseen, "blob").mapInArrow(_scanner(self.rules), _LEDGER)
        found.write.mode("append").parquet(self.folder)
        return inventory

    def findings(self, inventory: DataFrame) -> DataFrame:
        """The inventory's rows with ``found``: what the present rules found in the row's blob, by
        start and then in the order of the rules. Every row must have been scanned."""
        present = F.filter("found", lambda f: f["rule"].isin(self.versions))
        # Blobs without findings, nearly all, need not meet the inventory; a blob that a third of
        # the rows hold is one row here, and the rows' side of the join can be split.
        hits = self.entries().select("blob", present.alias("found")).where(F.size("found") > 0)
        hits = hits.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        order = F.create_map(*(F.lit(x) for k, r in enumerate(self.rules) for x in (r.kind, k)))
        ranked = F.transform("found", lambda f: F.struct(
            f["start"].alias("start"), order[f["kind"]].alias("order"), f["end"].alias("end"), f["kind"].alias("kind")))
        listed = F.transform(F.array_sort(ranked), lambda f: F.struct(
            f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end")))
        nothing = F.array().cast("array<struct<kind: string, start: long, `end`: long>>")
        return inventory.join(hits.select("blob", listed.alias("found")), "blob", "left").withColumn(
            "found", F.coalesce("found", nothing))


def _may_hold(rows: DataFrame, unseen: DataFrame) -> DataFrame:
    """Rows whose blob may be one of ``unseen``: all that are, and some others."""
    name = F.xxhash64("blob")
    bits = rows.sparkSession.sparkContext.broadcast(membership_bitmap(unseen.select(name.alias("name")), "name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = maybe_in(bits.value, batch.column("name").to_numpy())
            if kept.any():
                yield batch.filter(pa.array(kept)).select(["blob", "text"])

    return rows.withColumn("name", name).mapInArrow(run, "blob binary, text string")


def _scanner(rules: Sequence[SecretRule]):
    """A ledger row for each (blob, text, rules)."""
    kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners: dict[tuple[str, ...], _Scanner] = {}
        for batch, data, offsets in slices(batches):
            out = []
            for k, wanted in enumerate(batch.column("rules").to_pylist()):
                key = tuple(wanted)
                if key not in scanners:
                    scanners[key] = _Scanner([r for r in rules if r.version in key])
                scanner, own = scanners[key], data[offsets[k] : offsets[k + 1]]
                spans = scanner.spans(own.tobytes())
                if spans:
                    # Byte places to code points: continuation bytes before a place don't count.
                    before = np.append(0, np.cumsum((own & 0xC0) != 0x80))
                    spans = [
                        {"rule": r.version, "kind": r.kind, "start": int(before[a]), "end": int(before[b])}
                        for a, b, r in ((a, b, scanner.rules[n][0]) for a, b, n in spans)
                    ]
                out.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("rules"), pa.array(out, kind)], ["blob", "rules", "found"])

    return run


def find_secrets(
    documents: DataFrame, folder: str, rules: Sequence[SecretRule] = RULES, *,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, blob (SHA-256 of the text) and ``found``, an array of (kind,
    start, end) in code points, end exclusive; blobs that the ledger in ``folder`` knows are not
    scanned again.

    Whole texts are scanned. Null texts are empty ones; null ids and repeated rows are kept; an
    empty table gives an empty result; other columns are not read. A kind's matches do not overlap;
    matches of different kinds may.
    """
    ledger = SecretLedger(documents.sparkSession, folder, rules)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return ledger.findings(ledger.scan(rows)).select(F.col("id").alias(id_col), "blob", "found")


def new_ledger(shared: str) -> str:
    """A folder for a ledger that lives as long as the application."""
    return f"{shared}/ledger-{uuid.uuid4().hex}"
