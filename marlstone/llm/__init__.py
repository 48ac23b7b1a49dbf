"""Corpus operators for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("bpe", "langid", "decontam", "quality_rules", "neighbours", "idfiles", "pitman_yor", "warc", "simhash", "prefix_counts", "resampling", "licenses", "whitening")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__name__}.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
