"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from sparkloom.llm import ann, bpe, decontaminate, html, license, lm, manifest, ngram_join, simhash, tokenfiles, toxicity, warc, whitening

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_warc": warc.op5_warc,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op7_toxicity": toxicity.op7_toxicity,
    "op3_html_extraction": html.op3_html_extraction,
    "op2_ann_search": ann.op2_ann_search,
    "op9_license_scan": license.op9_license_scan,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op11_ngram_jaccard_join": ngram_join.op11_ngram_jaccard_join,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLE_SQL: dict[str, str] = {"op5_warc": warc.OP5_SQL, "op6_decontamination": decontaminate.OP6_SQL, "op10_lm_scoring": lm.OP10_SQL, "op12_merkle_manifest": manifest.OP12_SQL}
