"""Registers queries by their function's name."""

from __future__ import annotations


def register(queries: dict, sqls: dict):
    def query(sql: str | None = None):
        def keep(function):
            queries[function.__name__] = function
            if sql:
                sqls[function.__name__] = sql
            return function

        return keep

    return query
