"""Streaming forms of the cell-level checks (an extension; the batch engine needs none)."""
