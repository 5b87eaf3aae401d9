"""The distinct copy and what it was made from."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowgauge.functions.sketches import LOG_REGISTERS, distinct_sketch, relative_error
from flowgauge.operators import patterns, quality, retrieval
from flowgauge.sources import DistinctStore, distinct_store, parse_times, read_flow_table, write_distinct
from flowgauge.sources.distinct_store import fingerprint


@pytest.fixture
def written(spark, flow_of, tmp_path):
    rows = [{"pipeline_name": "P1", "scheduled_quantity": float(q)} for q in (1, 1, 2)]
    path = str(tmp_path / "rows")
    flow_of(rows).raw.coalesce(1).write.parquet(path)
    write_distinct(read_flow_table(spark, path), str(tmp_path / "distinct"))
    return path, str(tmp_path / "distinct")


def test_a_copy_that_fits_is_used(spark, written):
    path, copy = written
    table = read_flow_table(spark, path, distinct_path=copy)
    assert retrieval.top_by_volume(table).first()["total_volume"] == 3.0


def test_appended_rows_make_the_copy_unusable(spark, written):
    path, copy = written
    spark.read.parquet(path).limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="write it again"):
        read_flow_table(spark, path, distinct_path=copy)


def test_a_file_rewritten_in_place_makes_the_copy_unusable(spark, flow_of, written, tmp_path):
    path, copy = written
    rows = [{"pipeline_name": "P1", "scheduled_quantity": float(q)} for q in (1, 1, 3)]
    flow_of(rows).raw.coalesce(1).write.parquet(str(tmp_path / "corrected"))
    (new,), (old,) = (list(Path(p).glob("*.parquet")) for p in (tmp_path / "corrected", path))
    old.write_bytes(new.read_bytes())
    old.with_name(f".{old.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="write it again"):
        read_flow_table(spark, path, distinct_path=copy)


def test_other_types_make_the_copy_unusable(spark, written, tmp_path):
    path, copy = written
    other = str(tmp_path / "other")
    spark.read.parquet(path).withColumn("rec_del_sign", F.col("rec_del_sign").cast("long")).write.parquet(other)
    with pytest.raises(ValueError, match="types"):
        read_flow_table(spark, other, distinct_path=copy)


def test_row_counts(flow_of):
    table = flow_of([{"state_abb": "TX"}, {"state_abb": "TX"}, {"state_abb": "PA"}])
    assert retrieval.row_counts(table, {"state": "TX"}).first().asDict() == {"rows_after": 2, "rows_before": 3}
    assert retrieval.row_counts(table, {"state": "TX"}, dedup=True).first()["rows_after"] == 1


def test_approximate_results_are_near(flow_of):
    table = flow_of([{"scheduled_quantity": float(q), "pipeline_name": f"P{q % 7}"} for q in range(101)])
    assert retrieval.average_quantity(table, approximate=True).first()["median_quantity"] == 50.0
    assert retrieval.unique_count(table, approximate=True).first()[0] == 7


def test_estimates_count_the_empty_string_and_no_nulls(flow_of):
    """Exact numbers of active partners count the empty string as one; few values are not estimated."""
    table = flow_of([
        {"connecting_entity": e, "eff_gas_day": f"2024-{month:02d}-{d:02d}"}
        for month, entities in ((1, ("",)), (2, ("", "A", "ÿ", None)), (3, (None,)), (4, ("A", "B")))
        for d in (1, 2) for e in entities
    ])
    for analysis in (patterns.monthly_trends, patterns.quarterly_activity):
        exact, near = ({r["period"]: r["active_partners"] for r in analysis(table, approximate=approximate).collect()}
                       for approximate in (False, True))
        assert near == exact
    points = [sorted(patterns.correlation_points(
        table, "unique_entities", "volume", grain="monthly", approximate=approximate).collect())
        for approximate in (False, True)]
    assert points[0] == points[1]
    assert [p["x"] for p in points[1]] == [1, 3, 0, 2]


def test_values_go_into_sketches_by_their_text(spark):
    """Apart from the empty string, estimates are those of the values' texts."""
    rows = spark.range(20_000).select(F.concat(F.lit("é"), F.col("id").cast("string")).alias("name"))
    plain = F.hll_sketch_estimate(F.hll_sketch_agg("name", LOG_REGISTERS))
    ours = F.hll_sketch_estimate(distinct_sketch(F.col("name")))
    near = rows.agg(plain.alias("plain"), ours.alias("ours")).first()
    assert near["plain"] == near["ours"] and abs(near["ours"] - 20_000) < 20_000 * 3 * relative_error()


# ---- the copy that grows ---------------------------------------------------------------------


def append(flow_of, path, rows):
    flow_of(rows).raw.coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def growing(spark, flow_of, tmp_path):
    path = str(tmp_path / "rows")
    append(flow_of, path, [{"pipeline_name": f"P{q}", "scheduled_quantity": float(q)} for q in (1, 1, 2, 3)])
    store = DistinctStore(spark, path, str(tmp_path / "store"), buckets=64)
    store.grow()
    return store, path


def in_store(store):
    return sorted((r.pipeline_name, r.scheduled_quantity) for r in store.rows().collect())


def test_new_files_add_only_new_rows(spark, flow_of, growing):
    store, path = growing
    assert in_store(store) == [("P1", 1.0), ("P2", 2.0), ("P3", 3.0)]
    append(flow_of, path, [{"pipeline_name": "P2", "scheduled_quantity": 2.0},
                           {"pipeline_name": "P9", "scheduled_quantity": 9.0},
                           {"pipeline_name": "P9", "scheduled_quantity": 9.0}])
    with pytest.raises(ValueError, match="grow"):
        store.table()
    table = store.grow()
    assert in_store(store) == [("P1", 1.0), ("P2", 2.0), ("P3", 3.0), ("P9", 9.0)]
    assert table.rows(dedup=True).count() == 4 == store.table().rows(dedup=True).count()
    assert table.raw.count() == 7 == retrieval.row_counts(table, {}).first()["rows_before"]
    log = [tuple(r) for r in store.log().orderBy("batch_no").collect()]
    assert [r[1:4] for r in log] == [(1, 4, 3), (1, 3, 1)] and log[1][4] <= 2
    before = log
    store.grow()  # nothing has come
    assert [tuple(r) for r in store.log().orderBy("batch_no").collect()] == before


def test_rows_that_count_as_equal_are_one(spark, flow_of, tmp_path):
    path = str(tmp_path / "rows")
    store = DistinctStore(spark, path, str(tmp_path / "store"))
    values = [0.0, float("nan"), None, 5.0]
    append(flow_of, path, [{"scheduled_quantity": q, "county_name": None} for q in values])
    store.grow()
    append(flow_of, path, [{"scheduled_quantity": q, "county_name": None} for q in [-0.0, float("nan"), None]])
    append(flow_of, path, [{"scheduled_quantity": None, "county_name": "x", "connecting_entity": None},
                           {"scheduled_quantity": None, "county_name": None, "connecting_entity": "x"}])
    table = store.grow()
    assert table.rows(dedup=True).count() == table.raw.dropDuplicates().count() == 6


def test_neighbouring_values_do_not_run_together(spark):
    rows = spark.createDataFrame(
        [("ab", "c"), ("a", "bc"), (None, "x"), ("x", None), ("-", "x"), ("1:a", "")], "p string, q string")
    assert rows.select(fingerprint(rows).alias("f")).distinct().count() == 6
    assert rows.select("q", "p").select(fingerprint(rows)).count() == 6


def test_replaced_and_removed_files_are_refused(spark, flow_of, growing):
    store, path = growing
    (file,) = Path(path).glob("*.parquet")
    content = file.read_bytes()
    append(flow_of, path, [{"pipeline_name": "other"}])
    store.grow()
    file.write_bytes(content + b"")
    os.utime(file, (1, 1))
    with pytest.raises(ValueError, match="replaced or removed"):
        store.grow()
    file.unlink()
    with pytest.raises(ValueError, match="replaced or removed"):
        store.grow()


def test_a_batch_without_a_commit_is_not_read(spark, flow_of, growing, monkeypatch):
    store, path = growing
    append(flow_of, path, [{"pipeline_name": "P9", "scheduled_quantity": 9.0}])
    monkeypatch.setattr(distinct_store, "Row", lambda **_: 1 / 0)  # dies before the commit
    with pytest.raises(ZeroDivisionError):
        store.grow()
    assert len(in_store(store)) == 3 and store.log().count() == 1
    monkeypatch.undo()
    store.grow()
    assert len(in_store(store)) == 4 and store.log().count() == 2


def test_only_new_files_and_touched_buckets_are_read(spark, flow_of, growing, monkeypatch):
    store, path = growing
    append(flow_of, path, [{"pipeline_name": "P9", "scheduled_quantity": 9.0}])
    seen = []
    cut = distinct_store.cut_lineage
    monkeypatch.setattr(distinct_store, "cut_lineage", lambda df: (seen.append(df), cut(df))[1])
    store.grow()
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    buckets = [p for p in plans if "bucket#" in p and "PartitionFilters: [" in p and "bucket#" in p.split("PartitionFilters: [")[1]]
    assert buckets
    reads = [set(df.inputFiles()) for df in seen if "eff_gas_day" in df.columns]
    old = {f for f in spark.read.parquet(path).inputFiles()} - reads[0]
    assert len(reads[0]) == 1 and len(old) == 1 and not any(old & r for r in reads)


def test_other_columns_are_refused(spark, growing, tmp_path):
    store, path = growing
    spark.read.parquet(path).withColumn("rec_del_sign", F.col("rec_del_sign").cast("long")).coalesce(1).write.parquet(
        str(tmp_path / "longer"))
    (file,) = (tmp_path / "longer").glob("*.parquet")
    file.rename(Path(path) / "part-zzz.parquet")
    with pytest.raises(ValueError, match="columns or types"):
        store.grow()


def test_whole_rows_are_shuffled_once_and_never_checkpointed(spark, flow_of, growing, monkeypatch):
    store, path = growing
    append(flow_of, path, [{"pipeline_name": "P2", "scheduled_quantity": 2.0}]
           + [{"pipeline_name": "P9", "scheduled_quantity": 9.0}] * 50)
    seen, cut = [], distinct_store.cut_lineage
    monkeypatch.setattr(distinct_store, "RANGE_ROWS", 10)
    monkeypatch.setattr(distinct_store, "cut_lineage", lambda df: (seen.append(df), cut(df))[1])
    first, made = distinct_store.DistinctStore._first_of_each, []
    monkeypatch.setattr(distinct_store.DistinctStore, "_first_of_each", lambda *a: (made.append(first(*a)), made[-1])[1])
    store.grow()
    assert seen and all(set(df.columns) <= {"eff_gas_day", distinct_store.PRINT} for df in seen)
    text = made[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and "Exchange rangepartitioning" in text
    assert in_store(store) == [("P1", 1.0), ("P2", 2.0), ("P3", 3.0), ("P9", 9.0)]


def test_zeros_inside_arrays_and_structs_are_alike(spark):
    rows = spark.createDataFrame(
        [([0.0, 1.0], (0.0,)), ([-0.0, 1.0], (-0.0,)), ([1.0, 0.0], (0.0,)), (None, None)],
        "a array<double>, s struct<x: double>")
    assert rows.select(fingerprint(rows)).distinct().count() == rows.dropDuplicates().count() == 3


# ---- text for times --------------------------------------------------------------------------


def test_rows_without_a_readable_time_are_kept_apart(spark, flow_of, tmp_path):
    texts = ["2024-01-31", "2024-01-31T10:20:30", "31.01.2024", "2024-02-30", "soon", "", " ", None]
    base = flow_of([{"pipeline_name": f"P{k}"} for k in range(len(texts))]).raw.drop("eff_gas_day")
    named = spark.createDataFrame([(f"P{k}", t) for k, t in enumerate(texts)], "pipeline_name string, eff_gas_day string")
    rows = base.join(named, "pipeline_name")
    parsed = parse_times(rows, str(tmp_path / "out"), formats=["dd.MM.yyyy"])
    assert parsed.counts == {"rows": 8, "parsed": 3, "missing": 3, "failed": 2}
    assert sorted(r.eff_gas_day for r in parsed.quarantine.collect()) == ["2024-02-30", "soon"]
    good = {r.pipeline_name: r.eff_gas_day for r in parsed.table.raw.collect()}
    assert good["P0"] == good["P2"] == dt.datetime(2024, 1, 31) and good["P1"] == dt.datetime(2024, 1, 31, 10, 20, 30)
    assert {k for k, v in good.items() if v is None} == {"P5", "P6", "P7"}
    assert parsed.table.raw.columns == rows.columns


def test_a_time_column_has_nothing_to_quarantine(flow_of, tmp_path):
    parsed = parse_times(flow_of([{}, {}]).raw, str(tmp_path / "out"))
    assert parsed.counts["failed"] == 0 and parsed.table.raw.count() == 2
    empty = parse_times(flow_of([]).raw, str(tmp_path / "none"))
    assert empty.counts == {"rows": 0, "parsed": 0, "missing": 0, "failed": 0}


# ---- examples in the order of the files ------------------------------------------------------


def test_examples_come_in_stored_order(spark, flow_of, tmp_path):
    path = str(tmp_path / "rows")
    signs = [1, -1, -1, 1, -1, -1]
    for k, start in enumerate((10, 0, 20)):  # files in an order of their own
        flow_of([{"loc_name": f"L{start + i}", "rec_del_sign": s} for i, s in enumerate(signs)]).raw.coalesce(
            1).write.parquet(str(tmp_path / f"w{k}"))
        (file,) = (tmp_path / f"w{k}").glob("*.parquet")
        Path(path).mkdir(exist_ok=True)
        file.rename(Path(path) / f"part-{k}.parquet")
    table = read_flow_table(spark, path)
    rows = quality.rule_violation_examples(table, "LDC", "receipts", limit=6, stored=True).collect()
    assert [(r.position, r.loc_name) for r in rows] == [
        (1, "L11"), (2, "L12"), (3, "L14"), (4, "L15"), (5, "L1"), (6, "L2")]
    with pytest.raises(ValueError, match="stored order"):
        quality.rule_violation_examples(flow_of([{"rec_del_sign": -1}]), "LDC", "receipts", stored=True)
