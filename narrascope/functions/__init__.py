"""narrascope.functions."""
