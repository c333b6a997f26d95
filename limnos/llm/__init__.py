"""Operators for training-data pipelines (text decontamination, dedup, PII, mixing, sharding, ...).

Nothing else in the library imports this subpackage.  ``limnos.llm.queries``
registers one query per operator.
"""
