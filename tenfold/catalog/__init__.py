"""Registered queries and the SQL that checks them."""

from __future__ import annotations


def _load():
    from tenfold.catalog import base, descriptive, models, relational  # noqa: F401

    return base


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
