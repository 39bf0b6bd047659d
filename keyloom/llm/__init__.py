"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql``
(module :mod:`keyloom.llm.registry`) hold the driver-facing entries.
"""
