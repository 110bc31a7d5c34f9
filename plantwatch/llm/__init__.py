"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames, works on whole tables and whole
texts, and names its key and text columns as parameters. Nothing outside this
subpackage imports it.
"""
