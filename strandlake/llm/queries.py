"""Registered queries of the corpus operators and their SQL, gathered from the operators' modules."""

from __future__ import annotations

import importlib

MODULES = ("quality", "bpe", "warc", "urls", "neardup", "toxicity", "lm", "packing", "ann", "html_extract", "linededup", "crosstok", "phrases")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _m = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
