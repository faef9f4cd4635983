"""Operators for preparing text corpora: deduplication, decontamination, scoring, mixing and search.

Nothing else in the library imports this subpackage; its queries are in `tabulon.llm.queries`.
"""
