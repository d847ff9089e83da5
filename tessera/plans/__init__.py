"""Declared tables, predicates, and the query builder, all of which lower to DataFrames."""
