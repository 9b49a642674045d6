"""narrascope.plans."""
