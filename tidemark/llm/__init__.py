"""Operators for preparing language-model training data. `queries()` and `oracle_sql()` are in `catalogue`."""
