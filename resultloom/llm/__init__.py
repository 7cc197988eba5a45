"""Operators for building training data, and the queries that apply them."""
