"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op1_bpe_encoding
from .decontaminate import op3_benchmark_decontamination
from .divergence import op13_source_divergence
from .embeddings import op2_embedding_near_dedup
from .langid import op10_language_string_kernel
from .lexical import op11_lexical_treaps
from .phrases import op12_repeated_phrases
from .pii import op8_pii_disclosure
from .quality import op9_quality_nbsvm
from .sharding import op5_feistel_sharding
from .simhash import op7_simhash_near_dedup
from .toxicity import op4_toxicity_levenshtein
from .warc import op6_warc_archive


def queries() -> dict:
    return {
        "op1_bpe_encoding": op1_bpe_encoding,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_toxicity_levenshtein": op4_toxicity_levenshtein,
        "op5_feistel_sharding": op5_feistel_sharding,
        "op6_warc_archive": op6_warc_archive,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_pii_disclosure": op8_pii_disclosure,
        "op9_quality_nbsvm": op9_quality_nbsvm,
        "op10_language_string_kernel": op10_language_string_kernel,
        "op11_lexical_treaps": op11_lexical_treaps,
        "op12_repeated_phrases": op12_repeated_phrases,
        "op13_source_divergence": op13_source_divergence,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Cosines of all pairs of a label, and the least vec_id that links reach.
_OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS reached FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

#: Windows as lists of words, joined.
_OP3 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
p AS (SELECT DISTINCT item_id, m, ws[k : k + m - 1] AS window_words FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM b)),
d AS (SELECT doc_id, m, k, ws[k : k + m - 1] AS window_words FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, (SELECT DISTINCT m FROM p) WHERE len(ws) >= m)),
h AS (SELECT doc_id, item_id, k, m FROM d JOIN p USING (m, window_words)),
x AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN x USING (doc_id) LEFT JOIN i USING (doc_id)
"""

#: Base32 by five hex digits (20 bits, four letters) at a time.
_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM p
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Scores of all documents by every item's terms.
_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS nn, sum(len(ts))::BIGINT AS ll FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, nn),
i AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))) AS part FROM p JOIN w USING (t), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(part * times) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

#: Windows as joined words, counted.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, k, array_to_string(ws[k : k + 34], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS k FROM d WHERE len(ws) >= 35)),
h AS (SELECT r, k FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
c AS (SELECT r, list(DISTINCT place) AS places FROM (SELECT r, unnest(range(k, k + 35)) AS place FROM h) GROUP BY r),
e AS (SELECT doc_id, ws, places, CASE WHEN places IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(places, i)) END AS kept FROM d LEFT JOIN c USING (r))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM e
"""

#: Frequencies of every kept term in every group, all pairs.
_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM f),
o AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(lt) + 2 * any_value(v)) AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS lt FROM f) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN o USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms),
z AS (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express. The others run tokenizers, XXH64, keyed permutations or
    trained models; tests/llm holds each against a plain version or held-out labels."""
    return {"op2_embedding_near_dedup": _OP2, "op3_benchmark_decontamination": _OP3, "op6_warc_archive": _OP6, "op11_lexical_treaps": _OP11, "op12_repeated_phrases": _OP12, "op13_source_divergence": _OP13}
