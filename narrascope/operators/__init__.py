"""narrascope.operators."""
