"""The analyses. Each takes a ``FlowTable`` and parameters and returns a lazy DataFrame."""
