"""Operators on long sensor tables: DataFrame in, DataFrame out; keys and order columns are arguments."""
