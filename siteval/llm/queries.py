"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from siteval.llm import alignment, jaccard, langid, lattice, mixing, packing, passages, polytope, runs, secrets, shuffle, tokens, warc

QUERIES = {
    "op1_separator_scan": tokens.query,
    "op2_rake_mixing": mixing.query,
    "op3_ngram_jaccard_join": jaccard.query,
    "op4_e8_near_duplicates": lattice.query,
    "op5_warc_segments": warc.query,
    "op6_cross_polytope": polytope.query,
    "op7_length_buckets": packing.query,
    "op8_external_shuffle": shuffle.query,
    "op9_byte_cnn_language": langid.query,
    "op10_collinear_passages": passages.query,
    "op11_secret_scan": secrets.query,
    "op12_tokenizer_alignment": alignment.query,
    "op13_periodic_runs": runs.query,
}
ORACLES = {
    "op5_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(encode(h)) >= 100 GROUP BY d)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d""",
}
