"""Operators of a training-data pipeline: mixing, search, filters, dedup, decontamination.

Nothing else in the library imports this subpackage.  ``queries`` and
``oracle_sql`` in :mod:`colloquy.llm.registry` are what the driver sees.
"""
