"""Flow analytics on Spark: analyses of large tables of signed daily transactions."""

from flowgauge.schema import FlowSchema
from flowgauge.table import FlowTable

__all__ = ["FlowSchema", "FlowTable"]
