"""All queries of this subpackage, their SQL where there is any."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, language_id, license_scan, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity

_MODULES = (quality_rules, embedding_dedup, language_id, byte_bpe, toxicity, sharding, license_scan, packing, ngram_join, quality_classifier)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
