"""The queries of the training-data operators and their SQL."""

from importlib import import_module

MODULES = ["tiff", "langid", "dedup", "decontaminate", "toxicity", "html", "toolcalls", "bpe", "secrets", "quality"]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
