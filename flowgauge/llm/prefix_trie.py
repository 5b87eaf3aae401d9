"""Prefix trie of conversations by collapsing whole sequences.

Conversations are rebuilt, and identical ones become one weighted sequence with the list of its
members. A sequence that is a proper prefix of another is no leaf; an anti-join finds the leaves.
All node figures are then sums over the weighted sequences' prefixes, so a conversation that was
copied a million times costs what one costs.

A prefix is named by its depth and four sums of 32-bit hashes of (place, SHA-256 of the turn). Sums
can be taken block by block, so a long conversation is ranked and named in several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import written

#: Turns of one conversation that one task orders or sums up.
BLOCK_TURNS = 4096
#: Members in one piece of a list of ends.
PIECE_ENDS = 2048
#: Turns that a conversation may take from the first of its family.
_MOST_HEAD = 3
_LANES = ("s0", "s1", "s2", "s3")
_NAME = ("depth", *_LANES)


def _own_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, digest, words): all that is needed of a turn; the text goes no further."""
    role_text = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text)]
    digest = F.sha2(F.concat(F.char_length(role_text[0]).cast("string"), F.lit(":"), *role_text), 256)
    return conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"),
        F.unhex(digest).alias("digest"),
        F.regexp_count(role_text[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def _earlier(rows: DataFrame, keys: list[str], block: str, sums: dict[str, Column]) -> DataFrame:
    """For every block of a key but its first: the sums over the blocks before it. Keys of one
    block, nearly all, give no row."""
    totals = rows.groupBy(*keys, block).agg(*(value.alias(name) for name, value in sums.items()))
    before = Window.partitionBy(*keys).orderBy(F.col(block).asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    return totals.select(*keys, block, *(F.sum(name).over(before).alias(name) for name in sums)).where(
        " OR ".join(f"{name} IS NOT NULL" for name in sums))


def _ranked(turns: DataFrame) -> DataFrame:
    """(c, place, digest, words): turns counted from 0 in the order of turn (null first) and, among
    equal turns, digest. Ordered in blocks of turn numbers, whose sizes are then added up."""
    # Equal turn numbers without end must not fill one block either: the digest splits them.
    turns = turns.withColumn("block", F.struct(
        F.floor(F.col("turn") / BLOCK_TURNS).alias("turns"),
        F.when(F.col("turn").isNull(), F.substring("digest", 1, 1)).alias("ties")))
    local = written(turns.withColumn("local", F.row_number().over(
        Window.partitionBy("c", "block").orderBy(F.col("turn").asc_nulls_first(), "digest")) - 1))
    offset = _earlier(local, ["c"], "block", {"offset": F.count(F.lit(1))})
    offset = offset.select(F.col("c").alias("of"), F.col("block").alias("from"), "offset")
    same = (F.col("c") == F.col("of")) & F.col("block").eqNullSafe(F.col("from"))
    return local.join(offset, same, "left").select(
        "c", (F.coalesce("offset", F.lit(0)) + F.col("local")).alias("place"), "digest", "words")


def _rebuilt(ranked: DataFrame, family: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (c) and their rebuilt turns (c, depth, digest, words), depth from 1."""
    base = (F.col("c") - F.pmod("c", F.lit(family))).alias("base")
    convs = ranked.select("c", base).distinct()
    heads = ranked.where((F.pmod("c", F.lit(family)) == 0) & (F.col("place") < _MOST_HEAD))
    # A family has at most `family` conversations.
    families = convs.groupBy("base").agg(F.collect_list("c").alias("members")).join(
        heads.groupBy(F.col("c").alias("base")).agg(F.count(F.lit(1)).alias("n_base")), "base", "left"
    ).withColumn("n_base", F.coalesce("n_base", F.lit(0)))
    heads = heads.join(families.select(F.col("base").alias("c"), "members"), "c").select(
        F.explode("members").alias("member"), "c", "place", "digest", "words")
    heads = heads.where((F.col("member") != F.col("c")) & (F.col("place") < taken("member"))).select(
        F.col("member").alias("c"), (F.col("place") + 1).alias("depth"), "digest", "words")
    own = ranked.withColumn("base", base).join(families.select("base", "n_base"), "base")
    kept = (F.col("c") == F.col("base")) | (F.col("place") >= taken("c"))
    missing = F.when(F.col("c") == F.col("base"), 0).otherwise(taken("c") - F.least(taken("c"), "n_base"))
    own = own.where(kept).select("c", (F.col("place") + 1 - missing).alias("depth"), "digest", "words")
    return convs.select("c"), own.unionByName(heads)


def taken(column: str) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % (_MOST_HEAD + 1)


def _named(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, depth, words, name, parent) of every prefix of every conversation, the empty one too."""
    lanes = []
    for seed in (1, 2):
        value = F.xxhash64(F.lit(seed), "depth", "digest")
        lanes += [F.shiftrightunsigned(value, 32), value.bitwiseAND(0xFFFFFFFF)]
    rows = turns.select(
        "c", "depth", "words", F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("block"),
        *(value.alias(f"v{k}") for k, value in enumerate(lanes)))
    upto = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = written(rows.withColumns({s: F.sum(f"v{k}").over(upto) for k, s in enumerate(_LANES)}))
    offset = _earlier(local, ["c"], "block", {f"o{k}": F.sum(f"v{k}") for k in range(4)})
    joined = local.join(offset, ["c", "block"], "left").withColumns(
        {s: F.col(s) + F.coalesce(f"o{k}", F.lit(0)) for k, s in enumerate(_LANES)})
    parent = [(F.col("depth") - 1).alias("depth"), *((F.col(s) - F.col(f"v{k}")).alias(s) for k, s in enumerate(_LANES))]
    zero = F.struct(*(F.lit(0).cast("long").alias(x) for x in _NAME))
    tops = convs.select("c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"),
                        zero.alias("name"), F.lit(None).cast(zero_type()).alias("parent"))
    return joined.select(
        "c", "depth", "words", F.struct(*_NAME).alias("name"), F.struct(*parent).alias("parent")
    ).unionByName(tops)


def zero_type() -> str:
    return "struct<" + ",".join(f"{x}: long" for x in _NAME) + ">"


def collapse(whole: DataFrame) -> DataFrame:
    """(name, conv_id, weight, ends_sha256) of every distinct sequence, from (c, name) of every
    conversation. ``ends_sha256`` is the hash of the members' numbers, ascending, comma-joined.

    Members are ordered over all tasks and joined in pieces; only pieces meet in one task, which
    feeds them to the hash one after the other and holds one at a time.
    """
    schema = f"name {zero_type()}, least long, n long, numbers string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            out = []
            for own, c in zip(batch.column("name").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if own != name or len(held) == PIECE_ENDS:
                    if held:
                        out.append(piece(name, held))
                    name, held = own, []
                held.append(c)
            yield rows(out)
        if held:
            yield rows([piece(name, held)])

    def piece(name: dict, held: list[int]) -> dict:
        return {"name": name, "least": held[0], "n": len(held), "numbers": ",".join(map(str, held))}

    def rows(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, pa.schema([
            ("name", pa.struct([(x, pa.int64()) for x in _NAME])), ("least", pa.int64()),
            ("n", pa.int64()), ("numbers", pa.string())]))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, least, n, digest = None, 0, 0, None
        shape = pa.schema([
            ("name", pa.struct([(x, pa.int64()) for x in _NAME])), ("conv_id", pa.int64()),
            ("weight", pa.int64()), ("ends_sha256", pa.string())])

        def done() -> dict:
            return {"name": name, "conv_id": least, "weight": n, "ends_sha256": digest.hexdigest()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["name"] != name:
                    if digest is not None:
                        out.append(done())
                    name, least, n, digest = row["name"], row["least"], 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row["numbers"].encode())
                n += row["n"]
            yield pa.RecordBatch.from_pylist(out, shape)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([done()], shape)

    ordered = whole.select("name", "c").repartitionByRange("name", "c").sortWithinPartitions("name", "c")
    joined = ordered.mapInArrow(pieces, schema)
    return joined.repartition("name").sortWithinPartitions("name", "least").mapInArrow(
        ends, f"name {zero_type()}, conv_id long, weight long, ends_sha256 string")


def _suffix_sums(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Each of ``values`` replaced by its sum over this and all later prefixes of the sequence."""
    rows = rows.withColumn("block", -F.floor((F.col("depth") - 1) / BLOCK_TURNS))
    later = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    local = written(rows.withColumns({f"{v}_sum": F.sum(v).over(later) for v in values}))
    offset = _earlier(local, ["conv"], "block", {f"{v}_later": F.sum(v) for v in values})
    return local.join(offset, ["conv", "block"], "left").withColumns(
        {v: F.col(f"{v}_sum") + F.coalesce(f"{v}_later", F.lit(0)) for v in values})


def prefix_trie(
    conversations: DataFrame, *, family: int = 20, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt as the first h turns of conversation c - c mod ``family`` (the remainder
    is not negative; h comes from the hash of c) and its own after its first h. Turns are ordered by turn, null first; equal turn
    numbers by the hash of role and text, so the order is defined; repeated rows are turns of their own.
    Null role and text are empty, null and empty texts have no words. Rows without a conversation
    number belong to none and are left out. A conversation may end up without turns: it ends at the
    root. An empty table has no conversation and so no node; other columns are not read.
    """
    ranked = written(_ranked(_own_turns(conversations, conv_col, turn_col, role_col, text_col)))
    prefixes = written(_named(*_rebuilt(ranked, family)))
    # Whole sequences: the name of the longest prefix.
    whole = prefixes.groupBy("c").agg(F.max("name").alias("name"))
    sequences = written(collapse(written(whole)))
    # One conversation stands for its sequence from here on.
    standing = prefixes.join(sequences.select(F.col("conv_id").alias("c"), "weight", F.col("name").alias("full")), "c")
    rows = written(standing.select(
        F.col("c").alias("conv"), "depth", "words", "name", "parent", "weight",
        (F.col("name") != F.col("full")).alias("proper")))
    leaves = sequences.join(rows.where("proper").select("name").distinct(), "name", "left_anti")
    is_leaf = leaves.select(F.col("conv_id").alias("conv"), F.lit(1).cast("long").alias("leaf"))
    shared = rows.groupBy("name").agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"))
    # A node's own figures are entered once, in the row of the sequence with its smallest member: so a
    # prefix of a third of all sequences meets one row here.
    own = shared.select("name", F.col("conv_id").alias("conv"), "n_convs")
    entered = rows.join(own, ["conv", "name"], "left").join(is_leaf, "conv", "left").select(
        "conv", "depth", "name", "parent", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.coalesce((F.col("n_convs") - 1) * F.col("words"), F.lit(0)).alias("saved"))
    nodes = written(_suffix_sums(entered, ("saved",)).groupBy("name").agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.first("parent").alias("parent")))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    # Written, so that the nodes' side, in which most may have one parent, can be split.
    inner = written(nodes.select("name", "conv_id").join(children.withColumnRenamed("parent", "name"), "name"))
    below = nodes.join(
        inner.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    return (
        below.join(inner.select("name", "n_children"), "name", "left")
        .join(sequences.select("name", "ends_sha256"), "name", "left")
        .select(
            "conv_id", F.col("name.depth").alias("depth"), "parent_conv_id", "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
