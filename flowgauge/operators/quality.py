"""Rule checks, completeness checks and conflicting labels. All look at every raw row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.functions.predicates import apply_filters, direction_sign
from flowgauge.table import FlowTable, in_small_tasks, missing, with_keys

Filters = Mapping[str, Any] | None


def rule_violations(
    table: FlowTable, category: str, expected: str, filters: Filters = None
) -> DataFrame:
    """One row: rows of a category, those not in the expected direction (``receipts`` or
    ``deliveries``; a missing sign is a violation) and their share in percent. No row when
    the category has none; ``profile.distinct_values`` lists the categories."""
    violates = _violates(table, expected)
    return _share_of_category(table, category, filters, violates, "violations")


def rule_violation_examples(
    table: FlowTable, category: str, expected: str, filters: Filters = None, limit: int = 10,
    *, stored: bool = False,
) -> DataFrame:
    """The earliest violations, or with ``stored`` the first ones in the order of the files."""
    roles = table.roles
    columns = [roles.time, roles.require("pipeline"), roles.require("location"),
               roles.require("sign")]
    rows = _category_rows(table, category, filters).where(_violates(table, expected))
    if stored:
        return first_stored(rows, columns, limit)
    return rows.select(*columns).orderBy(*columns).limit(limit)


def rule_violations_by(
    table: FlowTable, category: str, expected: str, by: str = "pipeline",
    filters: Filters = None, limit: int | None = 10,
) -> DataFrame:
    """Groups with the most violations."""
    by = table.column(by)
    rows = _category_rows(table, category, filters).where(_violates(table, expected))
    counts = with_keys(rows, by).groupBy(by).agg(F.count(F.lit(1)).alias("violations"))
    return counts if limit is None else (
        counts.orderBy(F.col("violations").desc(), by).limit(limit)
    )


def completeness(
    table: FlowTable, category: str, required: Sequence[str], mode: str = "all_missing",
    filters: Filters = None,
) -> DataFrame:
    """One row: rows of a category, those with missing or empty required fields, and their
    share in percent. ``all_missing`` counts rows that lack every field, ``any_missing``
    rows that lack at least one."""
    lacks = _lacks(table, required, mode)
    return _share_of_category(table, category, filters, lacks, "incomplete")


def completeness_examples(
    table: FlowTable, category: str, required: Sequence[str], mode: str = "all_missing",
    filters: Filters = None, limit: int = 10, *, stored: bool = False,
) -> DataFrame:
    """Incomplete rows with the list of fields they lack; with ``stored`` the first ones in the
    order of the files."""
    names = [table.column(c) for c in required]
    keys = [table.roles.require("pipeline"), table.roles.require("location")]
    fields = F.filter(
        F.array(*[
            F.when(missing(table, c, empty_is_missing=True), F.lit(c)) for c in names
        ]),
        lambda name: name.isNotNull(),
    )
    rows = _category_rows(table, category, filters).where(_lacks(table, required, mode))
    if stored:
        return first_stored(rows, [*keys, fields.alias("missing_fields")], limit)
    examples = rows.select(*keys, fields.alias("missing_fields"))
    return examples.orderBy(*keys, "missing_fields").limit(limit)


#: Entities shown that are sent to all tasks; more of them meet the rows as Spark chooses.
MAX_BROADCAST_ENTITIES = 10_000


def entity_conflicts(
    table: FlowTable, entity: Sequence[str], dimensions: Sequence[str], filters: Filters = None
) -> DataFrame:
    """Per dimension: how many entities appear with more than one value of it, out of all
    entities, and the share in percent. Entities with a null in a key are left out; a null
    dimension is no value."""
    names = [table.column(d) for d in dimensions]
    counted = _conflicting(table, entity, names, filters).agg(
        F.count(F.lit(1)).alias("total_entities"),
        *[F.count_if(F.col(f"conflict_{k}")).alias(f"duplicates_{k}") for k in range(len(names))],
    ).where("total_entities > 0")
    by_dimension = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"duplicates_{k}").alias("duplicate_count"))
        for k, d in enumerate(names)
    ])
    return counted.select(F.inline(by_dimension), "total_entities").withColumn(
        "duplicate_pct",
        F.bround(F.try_divide(F.col("duplicate_count") * 100.0, F.col("total_entities")), 2),
    )


def entity_conflict_details(
    table: FlowTable, entity: Sequence[str], dimensions: Sequence[str],
    filters: Filters = None, limit: int = 10, max_values: int = 1000,
) -> DataFrame:
    """Per dimension the first ``limit`` conflicting entities (by key) with the number of their
    values and the first ``max_values`` of them as a sorted array. ``entity_conflict_values`` lists
    all conflicts, one row per value."""
    keys = [table.column(c) for c in entity]
    names = [table.column(d) for d in dimensions]
    found = _conflicting(table, entity, names, filters)
    conflicts = found.select(*keys, F.explode(F.filter(
        F.array(*[F.when(F.col(f"conflict_{k}"), F.lit(d)) for k, d in enumerate(names)]),
        lambda d: d.isNotNull(),
    )).alias("dimension"))
    position = F.row_number().over(Window.partitionBy("dimension").orderBy(*keys))
    examples = conflicts.withColumn("position", position).where(F.col("position") <= limit)
    # Only the rows of these few entities, ``limit`` per dimension, are looked at.
    rows = apply_filters(table, table.raw, filters).select(*dict.fromkeys([*keys, *names]))
    few = examples.drop("position")
    rows = rows.join(F.broadcast(few) if limit * len(names) <= MAX_BROADCAST_ENTITIES else few, keys)
    value = F.coalesce(*[F.when(F.col("dimension") == d, F.col(d).cast("string")) for d in names])
    chosen = rows.select("dimension", *keys, value.alias("value")).where("value IS NOT NULL").distinct()
    of_entity = Window.partitionBy("dimension", *keys)
    # Numbered and counted in windows, which can spill; no list is longer than asked for.
    placed = chosen.withColumns({
        "place": F.row_number().over(of_entity.orderBy("value")),
        "n_values": F.count(F.lit(1)).over(of_entity),
    }).where(F.col("place") <= max_values)
    return placed.groupBy("dimension", *keys, "n_values").agg(
        F.array_sort(F.collect_list("value")).alias("values"))


def entity_conflict_values(
    table: FlowTable, entity: Sequence[str], dimensions: Sequence[str], filters: Filters = None
) -> DataFrame:
    """Every conflicting entity, one row per value it appears with."""
    keys = [table.column(c) for c in entity]
    values = _entity_values(table, entity, dimensions, filters).where("value IS NOT NULL")
    conflicts = _value_counts(values, table, entity).where("n_values > 1")
    return values.join(conflicts, ["dimension", *keys])


def first_stored(rows: DataFrame, columns: Sequence[str | Column], limit: int) -> DataFrame:
    """The first ``limit`` of ``rows`` as they lie in the files: files by name, then rows by their
    number in the file; with ``position``, counted from 1. ``rows`` must be read from Parquet files,
    with nothing but filters and projections in between. Each task keeps ``limit`` rows at most, so no
    more than these are ever sent."""
    try:
        placed = rows.select(*columns, F.struct("_metadata.file_path", "_metadata.row_index").alias("__place"))
    except AnalysisException as error:
        raise ValueError("only rows that come straight from Parquet files have a stored order") from error
    first = placed.orderBy("__place").limit(limit)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__place"))
    return first.withColumn("position", position).drop("__place")


def _category_rows(table: FlowTable, category: str, filters: Filters) -> DataFrame:
    column = table.roles.require("category")
    return apply_filters(table, table.raw.where(F.col(column) == category), filters)


def _violates(table: FlowTable, expected: str) -> Column:
    return ~table.sign.eqNullSafe(direction_sign(expected))


def _lacks(table: FlowTable, required: Sequence[str], mode: str) -> Column:
    if mode not in ("all_missing", "any_missing"):
        raise ValueError(f"unknown mode '{mode}'; use all_missing or any_missing")
    if not required:
        raise ValueError("name at least one required field")
    checks = [missing(table, table.column(c), empty_is_missing=True) for c in required]
    return reduce(and_ if mode == "all_missing" else or_, checks)


def _share_of_category(
    table: FlowTable, category: str, filters: Filters, flagged: Column, name: str
) -> DataFrame:
    rows = _category_rows(table, category, filters)
    return rows.agg(
        F.lit(category).alias("category"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(flagged).alias(name),
    ).where("total > 0").withColumn(
        "pct", F.bround(F.col(name) * 100.0 / F.col("total"), 1)
    )


def _entity_values(
    table: FlowTable, entity: Sequence[str], dimensions: Sequence[str], filters: Filters
) -> DataFrame:
    """The distinct (dimension, entity, value) triples of all dimensions, in one pass."""
    keys = [table.column(c) for c in entity]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
        for c in (table.column(d) for d in dimensions)
    ])
    rows = with_keys(apply_filters(table, table.raw, filters), *keys)
    return rows.select(*keys, F.inline(pairs)).distinct()


def _conflicting(
    table: FlowTable, entity: Sequence[str], names: Sequence[str], filters: Filters
) -> DataFrame:
    """One row per entity: for the k-th dimension, whether it has more than one value. Smallest
    and largest value tell, so no values are gathered and rows are not multiplied."""
    keys = [table.column(c) for c in entity]
    rows = with_keys(apply_filters(table, table.raw, filters), *keys)
    # Dealt out by time as well, so that an entity with a large share of all rows is spread.
    rows = in_small_tasks(table, rows, *dict.fromkeys([*keys, *names, table.roles.time]))
    return rows.groupBy(*keys).agg(*[
        F.coalesce(
            F.min(F.col(d).cast("string")) != F.max(F.col(d).cast("string")), F.lit(False)
        ).alias(f"conflict_{k}")
        for k, d in enumerate(names)
    ])


def _value_counts(values: DataFrame, table: FlowTable, entity: Sequence[str]) -> DataFrame:
    keys = [table.column(c) for c in entity]
    return values.groupBy("dimension", *keys).agg(F.count("value").alias("n_values"))
