"""Relational operators: DataFrame in, DataFrame out; every ranked result is totally ordered."""
