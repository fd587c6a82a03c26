"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from tidewell.llm import bpe, decontamination, fingerprint, kneser_ney, line_dedup, mixing, prefix_trie, quality_rules, simhash, token_counts, token_files, warc, whitening


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_golden_schedule": mixing.op1_golden_schedule,
        "op2_recursive_merges": bpe.op2_recursive_merges,
        "op3_kneser_ney": kneser_ney.op3_kneser_ney,
        "op4_segment_reassembly": warc.op4_segment_reassembly,
        "op5_digest_cache": token_counts.op5_digest_cache,
        "op6_zstd_dictionary": token_files.op6_zstd_dictionary,
        "op7_patience_alignment": line_dedup.op7_patience_alignment,
        "op8_decision_list": quality_rules.op8_decision_list,
        "op9_canonical_digest": fingerprint.op9_canonical_digest,
        "op10_vantage_points": simhash.op10_vantage_points,
        "op11_tree_contraction": prefix_trie.op11_tree_contraction,
        "op12_ngram_scan": decontamination.op12_ngram_scan,
        "op13_bidiagonal_qd": whitening.op13_bidiagonal_qd,
    }


#: SQL can express three of these queries whole; the tests hold the others against brute force.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT sha256(h) AS digest, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY 1)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
    CASE WHEN strlen(p.h) >= 100 AND d.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(p.h) >= 100 AND d.first <> p.page_id THEN d.first END AS refers_to
FROM p LEFT JOIN d ON d.digest = sha256(p.h)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_segment_reassembly": OP4_SQL, "op11_tree_contraction": prefix_trie.OP11_SQL, "op12_ngram_scan": decontamination.OP12_SQL}
