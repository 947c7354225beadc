"""Operators for preparing training data.  Nothing else in weftgraph imports this package."""
