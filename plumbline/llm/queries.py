"""Registered queries of this package: ``name -> (query, SQL or None)``."""

from __future__ import annotations

from plumbline.llm import chat, decontaminate, embeddings, hmm, lines, packing, pii, quality, ranking, runs, simhash, substrings, suffixes

MODULES = [simhash, embeddings, substrings, hmm, suffixes, pii, lines, quality, packing, decontaminate, runs, chat, ranking]


def collect() -> dict:
    return {name: pair for module in MODULES for name, pair in module.QUERIES.items()}
