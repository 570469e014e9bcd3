"""Operators for preparing text corpora: extraction, quality, language, duplicates, decontamination, packing.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface; ``queries`` registers one query per operator.
"""
