"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, exact_dedup, lm_score, merkle, minhash, mixing, ngram_join, periodic, sharding, tiff, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_tiff": tiff.op4_tiff,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_hilbert_sharding": sharding.op7_hilbert_sharding,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_bbit_minhash": minhash.op13_bbit_minhash,
}

MODULES = (bpe, exact_dedup, lm_score, merkle, minhash, mixing, ngram_join, periodic, sharding, tiff, toxicity, url_filter, warc)
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
