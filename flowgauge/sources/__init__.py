"""Reading, checking and preparing a fact table."""

from flowgauge.sources.distinct_store import DistinctStore
from flowgauge.sources.flow_table import (
    as_flow_table,
    read_flow_table,
    table_size,
    write_distinct,
)
from flowgauge.sources.text_times import ParsedTimes, parse_times

__all__ = [
    "DistinctStore", "ParsedTimes", "as_flow_table", "parse_times", "read_flow_table", "table_size",
    "write_distinct",
]
