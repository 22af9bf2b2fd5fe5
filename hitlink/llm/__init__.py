"""Operators for building training corpora, one module per operator.

Every operator takes a DataFrame and column names and returns a DataFrame with its own columns; nothing is
collected but bounded models and counters. Nothing else in the library imports this subpackage.

Input rules that hold for all of them: a null text counts as an empty text, a null id is a document like any
other, repeated rows are repeated documents unless a module says otherwise, an empty table gives an empty result
with the full schema, and only the named id and text columns are read, so further columns cannot clash.
"""
