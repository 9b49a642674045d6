"""narrascope.sources."""
