"""Registered queries and the SQL each one is checked against."""

import importlib

SECTIONS = ("sources", "prep", "crosssection", "selection", "sizing", "accounting", "risk", "audits", "trials", "signals", "quality", "decisions", "altdata", "forecasting")


def load_all():
    from checks.registry import QUERIES, SQL
    for section in SECTIONS:
        importlib.import_module(f"checks.{section}")
    return QUERIES, SQL
