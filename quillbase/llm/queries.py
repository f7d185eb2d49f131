"""The subpackage's queries, and SQL for those that DuckDB can express.

Of the others: a decision list, a test battery, a model's scores, tokenisers' ids, packings, chunk lists and
near-duplicate classes are not relational results, and the 200-byte repeats of whole texts are far too slow in SQL.
"""

from quillbase.llm import bag_minhash, media_chunks, packing, piece_fst, quality_rules, secret_scan, suffix_dedup, token_files, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        suffix_dedup.op1_suffix_dedup,
        secret_scan.op2_secret_scan,
        token_files.op3_token_files,
        url_filter.op4_url_filter,
        toxicity.op5_toxicity,
        packing.op6_best_fit_packing,
        piece_fst.op7_sentencepiece_fst,
        quality_rules.op8_quality_rules,
        media_chunks.op9_media_chunks,
        bag_minhash.op10_bag_minhash,
    )
}
ORACLES = {"op4_url_filter": url_filter.SQL}
