"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.ann import op2_hilbert_search
from siltstone.llm.bitsliced import op12_bit_sliced_search
from siltstone.llm.chat import op7_tool_call_chats
from siltstone.llm.licenses import op3_license_scan
from siltstone.llm.mixing import op1_pareto_mix
from siltstone.llm.negatives import op11_hard_negatives
from siltstone.llm.packing import op10_pack_patterns
from siltstone.llm.pfor import op9_token_files
from siltstone.llm.quality import op8_quality_rules
from siltstone.llm.resampling import op13_importance_resample
from siltstone.llm.simhash import op6_simhash_components
from siltstone.llm.suffixes import op5_strip_repeats
from siltstone.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pareto_mix, op2_hilbert_search, op3_license_scan, op4_toxicity, op5_strip_repeats, op6_simhash_components, op7_tool_call_chats, op8_quality_rules, op9_token_files, op10_pack_patterns, op11_hard_negatives,
              op12_bit_sliced_search, op13_importance_resample)
}

#: All strings of 100 bytes, in hexadecimal, from pieces of a text that overlap; runs of those that start earlier as well are cut out.
STRIP_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
starts AS (SELECT doc_id, h, n, unnest(range(0, n - 99, 1000)) AS b FROM sized WHERE n >= 100),
pieces AS (SELECT doc_id, b, least(1000, n - 99 - b) AS many, substr(h, 2 * b + 1, 2198) AS s FROM starts),
places AS (SELECT doc_id, b, s, unnest(range(0, many)) AS j FROM pieces),
strings AS (SELECT doc_id, b + j AS i, md5_number(substr(s, 2 * j + 1, 200)) AS m FROM places),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM strings) WHERE k > 1),
edges AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head
        FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM sized LEFT JOIN cut USING (doc_id)"""

#: Scores of all pairs of an anchor and a row; windows of each anchor and positive; first rows by score.
NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

TOP_SQL = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs QUALIFY rank <= 5"""

#: The CRC of each distinct feature, byte by byte over a table that eight shifts make; counts, gains and ranks as the contract says.
RESAMPLE_SQL = """
WITH steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS step FROM range(256) t(i)),
texts AS (SELECT true AS ours, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
cut AS (SELECT ours, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (SELECT ours, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM cut),
per AS (SELECT ours, id, f, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                                    lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
          FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per)), steps),
held AS (SELECT bucket, coalesce(sum(n) FILTER (ours), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT ours), 0)::DOUBLE AS t FROM per JOIN coded USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM held),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM per JOIN coded USING (f) JOIN gains USING (bucket) WHERE ours GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM cut LEFT JOIN weights USING (id) WHERE ours)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) <= 5 * sum(able::INT) OVER () // 100
       THEN row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) END AS rank
FROM scored"""

ORACLES: dict[str, str] = {"op5_strip_repeats": STRIP_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_bit_sliced_search": TOP_SQL, "op13_importance_resample": RESAMPLE_SQL}
