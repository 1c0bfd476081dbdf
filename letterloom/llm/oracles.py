"""SQL of the queries of this folder that SQL can express."""

_MIX = """
WITH mass AS (
  SELECT source, sum(length(coalesce(text, '')) + 1) AS mass FROM documents GROUP BY source
), weighted AS (
  SELECT source, mass, pow(mass::DOUBLE, 0.7) AS weight FROM mass
), rates AS (
  SELECT source, weight / sum(weight) OVER () * (sum(mass) OVER ())::DOUBLE / mass AS rate FROM weighted
), means AS (
  SELECT source, greatest(ceil(rate / 8.0), 1)::INT AS draws, rate / greatest(ceil(rate / 8.0), 1) AS mean FROM rates
), terms AS (
  SELECT source, draws, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM means, range(0, 61) t(k)
), tables AS (
  SELECT source, any_value(draws) AS draws, list(cdf) AS cdf FROM terms GROUP BY source
), drawn AS (
  SELECT d.*, list_sum([len([c for c in cdf if c <=
      ('0x' || substr(md5('1|' || i || '|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0]) for i in range(1, draws + 1)]) AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM drawn
"""

_DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
        FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT p.doc_id, p.s, p.size, v.item_id FROM places p JOIN windows v ON p.words = v.words AND p.size = v.size
), words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_RANKED = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), corpus AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM b GROUP BY item_id, term
), counts AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM counts, corpus GROUP BY term, n_docs
), scores AS (
  SELECT item_id, doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), corpus GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

STATEMENTS = {"op1_mix_sources": _MIX, "op5_decontaminate": _DECONTAMINATE, "op12_ranked_search": _RANKED}
