"""Registered queries of the corpus operators and their DuckDB SQL."""
from __future__ import annotations

import functools

from . import decontaminate, hilbert, hyperminhash, jaccard_join, line_quality, lm_score, mixing, pii_crf, prefix_trie, secret_scan, text_tries, toxicity, url_filter
from .common import ship_code

_QUERIES = (
    (lm_score.op1_stupid_backoff, None),
    (toxicity.op2_weak_toxicity, None),
    (pii_crf.op3_crf_pii, None),
    (line_quality.op4_line_quality, line_quality.SQL),
    (mixing.op5_mix_sources, mixing.SQL),
    (hilbert.op6_hilbert_shards, None),
    (url_filter.op7_bloom_urls, url_filter.SQL),
    (decontaminate.op8_contained_items, decontaminate.SQL),
    (secret_scan.op9_secret_scan, None),
    (jaccard_join.op10_token_groups, jaccard_join.SQL),
    (hyperminhash.op11_hyperminhash, hyperminhash.SQL),
    (prefix_trie.op12_prefix_trie, prefix_trie.SQL),
    (text_tries.op13_filter_audit, text_tries.SQL),
)


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_code(spark)
        return query(spark, sf_dir)
    return run


def queries():
    return {f.__name__: _shipped(f) for f, _ in _QUERIES}


def oracle_sql():
    return {f.__name__: sql for f, sql in _QUERIES if sql}
