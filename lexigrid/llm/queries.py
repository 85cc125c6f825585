"""Queries and SQL of this subpackage."""

from __future__ import annotations

from lexigrid.llm import blob_ledger, fertility_rules, host_paths, kd_sharding, kn_langid, odd_minhash, pfair_mixing, simhash_leaks, surrogates, token_orc

QUERIES = {
    "op1_kn_langid": kn_langid.op1,
    "op2_pfair_mix": pfair_mixing.op2,
    "op3_fertility_rules": fertility_rules.op3,
    "op4_surrogates": surrogates.op4,
    "op5_kd_shards": kd_sharding.op5,
    "op6_token_orc": token_orc.op6,
    "op7_host_paths": host_paths.op7,
    "op8_blob_ledger": blob_ledger.op8,
    "op9_odd_minhash": odd_minhash.op9,
    "op10_simhash_leaks": simhash_leaks.op10,
}

_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.c < e.b),
least_ AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT l.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept FROM least_ l LEFT JOIN n USING (doc_id)
"""

#: The other methods (models, schedules, trees, tokenizers, spans) are tested against brute force.
ORACLES: dict[str, str] = {"op9_odd_minhash": _OP9}
