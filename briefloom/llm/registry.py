"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exactdedup, hardneg, htmltext, lmscore, neardup, packing, pieces, quality, records, secrets, sharding, simhash, whitening

QUERIES = {
    f.__name__: f
    for f in (
        htmltext.op1_html_extraction,
        neardup.op2_minhash_near_dedup,
        lmscore.op3_backoff_scores,
        pieces.op4_sentencepiece,
        sharding.op5_histogram_sharding,
        packing.op6_best_fit_packing,
        records.op7_token_records,
        exactdedup.op8_exact_dedup,
        quality.op9_quality_rules,
        secrets.op10_secret_scans,
        hardneg.op11_hard_negatives,
        whitening.op12_embedding_whitening,
        simhash.op13_simhash_near_dedup,
    )
}
ORACLE_SQL = {"op8_exact_dedup": exactdedup.OP8_SQL, "op11_hard_negatives": hardneg.OP11_SQL}
