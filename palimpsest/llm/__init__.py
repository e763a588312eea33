"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it; ``queries`` holds the thin
queries that apply each operator to a whole table.
"""
