"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import ann, bpe, fingerprints, html, merkle, mixing, quality, secrets, sharding, simhash, tokens, trie, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_tokens": tokens.op1_tokens,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_quality": quality.op3_quality,
        "op4_shards": sharding.op4_shards,
        "op5_main_text": html.op5_main_text,
        "op6_urls": urls.op6_urls,
        "op7_simhash": simhash.op7_simhash,
        "op8_bpe": bpe.op8_bpe,
        "op9_mix": mixing.op9_mix,
        "op10_secrets": secrets.op10_secrets,
        "op11_merkle": merkle.op11_merkle,
        "op12_trie": trie.op12_trie,
        "op13_neighbours": ann.op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality": quality.OP3_SQL,
        "op4_shards": sharding.OP4_SQL,
        "op6_urls": urls.OP6_SQL,
        "op9_mix": mixing.OP9_SQL,
        "op11_merkle": merkle.OP11_SQL,
        "op12_trie": trie.OP12_SQL,
    }
