"""Operators of a training-data pipeline: packing, licences, tokenisation, archives, language, media, search, quality, chat, near duplicates."""

from __future__ import annotations

import importlib

_MODULES = ("packing", "licences", "bpe", "warc", "langid", "matroska", "ann", "quality", "chat", "simhash")


def queries() -> dict:
    found: dict = {}
    for name in _MODULES:
        found |= importlib.import_module(f"textloom.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for name in _MODULES:
        found |= importlib.import_module(f"textloom.llm.{name}").SQL
    return found
