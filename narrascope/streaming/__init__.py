"""narrascope.streaming."""
