"""The flow table derived from the given star schema: 13 columns with nulls, empty strings and
exact duplicates. FIXTURES.md describes it; both definitions below say the same."""

from __future__ import annotations

import uuid
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgauge import FlowSchema, FlowTable
from flowgauge.session import shared_folder
from flowgauge.sources import as_flow_table, read_flow_table

# The columns read from each table; stating them saves a schema job per table and query.
SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "customer": "c_custkey BIGINT, c_name STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}


#: Lines that a task of the first join takes, about, however large the tables.
JOIN_ROWS = 500_000


def flow_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The flow columns and, on request, ``more`` of the given tables' columns or the copy number."""
    def table(name: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    # Customers meet the orders, of which there are fewer than lines.
    orders = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table("lineitem")
    tasks = lines.count() // JOIN_ROWS  # from the footers
    if tasks > spark.sparkContext.defaultParallelism:
        # By bytes of a shuffle a task would get millions of these short rows, which it sorts, widens
        # and in some queries groups or sorts again.
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    joined = (
        lines
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    text = F.lit(None).cast("string")
    partner = F.concat(F.lit("Partner#"), (F.col("l_partkey") % 20).cast("string"))
    copies = F.when(F.col("l_orderkey") % 59 == 0, F.array(F.lit(1), F.lit(2)))
    return joined.select(
        F.explode(copies.otherwise(F.array(F.lit(1)))).alias("copy"),
        F.col("s_name").alias("pipeline_name"),
        F.col("p_name").alias("loc_name"),
        F.when(F.col("l_linenumber") > 5, partner).alias("connecting_pipeline"),
        F.when(F.col("l_orderkey") % 8 == 0, text)
        .when(F.col("l_orderkey") % 16 == 1, "")
        .otherwise(F.col("c_name")).alias("connecting_entity"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(-1).alias("rec_del_sign"),
        F.col("p_type").alias("category_short"),
        F.col("r_name").alias("country_name"),
        F.col("n_name").alias("state_abb"),
        F.when(F.col("l_partkey") % 10 != 0, F.col("p_brand")).alias("county_name"),
        text.alias("latitude"),
        text.alias("longitude"),
        F.col("l_shipdate").alias("eff_gas_day"),
        F.col("l_quantity").alias("scheduled_quantity"),
        *(F.col(c) for c in more if c != "copy"),
    ).drop(*({"copy"} - set(more)))


FLOW_SCHEMA = (
    "pipeline_name STRING, loc_name STRING, connecting_pipeline STRING, "
    "connecting_entity STRING, rec_del_sign INT, category_short STRING, country_name STRING, "
    "state_abb STRING, county_name STRING, latitude STRING, longitude STRING, "
    "eff_gas_day TIMESTAMP_NTZ, scheduled_quantity DOUBLE"
)
_written: dict[tuple, str] = {}
_lock = Lock()


def write_flow_table(spark: SparkSession, sf_dir: str) -> str:
    """Derive the flow table once and write it to the shared folder, the first row of each kind apart
    from its copies: the joins and the whole-row shuffle are then not repeated by every analysis."""
    folder = f"{shared_folder(spark)}/flow-{uuid.uuid4().hex}"
    # The joins run once; what looks at the rows again, as ranging does, reads what they made.
    flow_rows(spark, sf_dir).write.parquet(f"{folder}/joined")
    joined = spark.read.schema(FLOW_SCHEMA).parquet(f"{folder}/joined")
    told_apart(joined).write.partitionBy("again").parquet(f"{folder}/rows")
    return folder


#: Rows of a range, about: so many fit into the memory of a task at any size of the table.
RANGE_ROWS = 500_000


def told_apart(rows: DataFrame) -> DataFrame:
    """The rows and ``again``: whether there is an equal one before. They are laid out by time, so that
    a year filter skips files. Equal rows have one time and one hash, so they lie in one range and are
    numbered there: this takes no other shuffle."""
    columns, ranges = rows.columns, 1 + rows.count() // RANGE_ROWS
    ranged = rows.withColumn("name", F.xxhash64(*columns)).repartitionByRange(ranges, "eff_gas_day", "name")
    others = [c for c in columns if c != "eff_gas_day"]
    equal = Window.partitionBy("eff_gas_day", "name", *others).orderBy("eff_gas_day")
    marked = ranged.select(*columns, (F.row_number().over(equal) > 1).alias("again"))
    return marked.sortWithinPartitions("again", "eff_gas_day")


def flow(spark: SparkSession, sf_dir: str) -> FlowTable:
    """The flow table of an application and its distinct rows, written at first use and again
    when the given tables have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, _state_of(spark, sf_dir))
    with _lock:
        if key not in _written:
            _written[key] = write_flow_table(spark, sf_dir)
    read = spark.read.schema(FLOW_SCHEMA).parquet
    return as_flow_table(
        read(f"{_written[key]}/rows/again=*"), distinct=read(f"{_written[key]}/rows/again=false")
    )


def _state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files of the tables the flow table is derived from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in SCHEMAS:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        for file in path.getFileSystem(conf).listStatus(path):
            found.append((file.getPath().getName(), file.getLen(), file.getModificationTime()))
    return tuple(found)


def stored_flow(spark: SparkSession, sf_dir: str) -> FlowTable:
    """The flow table in files whose order is known: by order, line, copy and the line's content."""
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    keys = ("l_orderkey", "l_linenumber", "copy", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    rows = flow_rows(spark, sf_dir, *keys)
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).write.parquet(folder)
    return as_flow_table(spark.read.schema(FLOW_SCHEMA).parquet(folder))


def text_time_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table with text for times: ISO days, days in another format, none, and no days."""
    rows = flow_rows(spark, sf_dir)
    day, quantity = F.to_date("eff_gas_day"), F.col("scheduled_quantity")
    return rows.withColumn(
        "eff_gas_day",
        F.when(quantity == 13, "n/a").when(quantity == 17, "  ").when(quantity == 18, F.lit(None))
        .when(quantity == 19, F.date_format(day, "dd/MM/yyyy"))
        .when(quantity == 23, F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")))
        .otherwise(F.date_format(day, "yyyy-MM-dd")),
    )


def flow_in_place(spark: SparkSession, sf_dir: str) -> FlowTable:
    """The flow table as a plan over the given tables, duplicates removed on the way."""
    return as_flow_table(flow_rows(spark, sf_dir))


# The events table in the same roles: who, what, when, how much; it has no direction or place.
EVENT_ROLES = FlowSchema(
    pipeline="user_id", location=None, partner_pipeline=None, partner=None, sign=None,
    category="event_type", country=None, region=None, subregion=None,
    time="ts", measure="value",
)


def events(spark: SparkSession, sf_dir: str) -> FlowTable:
    return read_flow_table(spark, f"{sf_dir}/events.parquet", EVENT_ROLES,
                           schema=SCHEMAS["events"])


FLOW_CTE = """
joined AS (
  SELECT
    l_orderkey,
    s_name AS pipeline_name,
    p_name AS loc_name,
    CASE WHEN l_linenumber <= 5 THEN CAST(NULL AS VARCHAR)
         ELSE concat('Partner#', CAST(l_partkey % 20 AS VARCHAR)) END AS connecting_pipeline,
    CASE WHEN l_orderkey % 8 = 0 THEN CAST(NULL AS VARCHAR)
         WHEN l_orderkey % 16 = 1 THEN '' ELSE c_name END AS connecting_entity,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS rec_del_sign,
    p_type AS category_short,
    r_name AS country_name,
    n_name AS state_abb,
    CASE WHEN l_partkey % 10 = 0 THEN CAST(NULL AS VARCHAR) ELSE p_brand END AS county_name,
    CAST(NULL AS VARCHAR) AS latitude,
    CAST(NULL AS VARCHAR) AS longitude,
    l_shipdate AS eff_gas_day,
    l_quantity AS scheduled_quantity
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
raw AS (
  SELECT pipeline_name, loc_name, connecting_pipeline, connecting_entity, rec_del_sign,
         category_short, country_name, state_abb, county_name, latitude, longitude,
         eff_gas_day, scheduled_quantity
  FROM joined
  UNION ALL
  SELECT pipeline_name, loc_name, connecting_pipeline, connecting_entity, rec_del_sign,
         category_short, country_name, state_abb, county_name, latitude, longitude,
         eff_gas_day, scheduled_quantity
  FROM joined WHERE l_orderkey % 59 = 0
),
flow AS (SELECT DISTINCT * FROM raw)
"""
