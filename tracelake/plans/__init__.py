"""Helpers that shape physical plans: lineage cuts, sized broadcasts, salted keys."""
