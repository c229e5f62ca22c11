"""Operators for preparing training data at corpus scale, and the queries that apply them."""
