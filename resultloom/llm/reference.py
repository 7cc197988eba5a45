"""DuckDB SQL for the rows of the bound queries, where SQL can say them.

SQL has no log-frequency filter, classifier, tiling, XXH64, page parser or eigenvectors: the queries of
operators 1, 2, 4, 6, 9, 10 and 11 are tested against brute force instead.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REFERENCE: dict[str, str] = {
    "op3_mixing": rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
         coalesce(greatest(0.1, 1 - CAST(length(text) - length(translate(text, '0123456789 ' || chr(10) || chr(9) || '#$%&*@_=+<>|~^{{}}[]\/', '')) AS DOUBLE)
                  / nullif(length(text), 0)), 0.1) AS quality,
         (CAST(('0x' || substr(md5('mix|' || doc_id), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0 AS u
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT a.source,
         ((SELECT sum(source_size) FROM sizes) * 1.5
          - coalesce((SELECT sum(2 * b.source_size) FROM sizes b WHERE 2 * b.source_size / b.weight < 2 * a.source_size / a.weight), 0))
         / (SELECT sum(b.weight) FROM sizes b WHERE b.source_size > 0 AND 2 * b.source_size / b.weight >= 2 * a.source_size / a.weight) AS level
  FROM sizes a WHERE a.source_size > 0),
target AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, coalesce(weight * (SELECT max(l.level) FROM levels l JOIN sizes s USING (source) WHERE l.level * s.weight < 2 * s.source_size), 2.0 * source_size)) END AS target
  FROM sizes),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target / nullif(source_size, 0)) AS epochs,
         target - floor(target / nullif(source_size, 0)) * source_size AS rest,
         sum(size) OVER (PARTITION BY docs.source ORDER BY -ln(u) / quality, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM docs JOIN target ON docs.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM placed""",
    "op5_substring_dedup": rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM docs WHERE len(words) >= 13),
windows AS (SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS passage FROM starts),
least_doc AS (SELECT passage, min(doc_id) AS first FROM windows GROUP BY passage),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM windows JOIN least_doc USING (passage) WHERE first < doc_id),
left_over AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS kept, count(*) AS n FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN left_over USING (doc_id)""",
    "op7_nearest": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
good AS (
  SELECT * FROM vectors WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 20""",
    "op8_suffix_dedup": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents),
blocks AS (SELECT doc_id, raw, unnest(range(0, length(raw) // 2, 200)) AS base FROM docs WHERE length(raw) >= 100),
cut AS (SELECT doc_id, base, substr(raw, 2 * base + 1, 498) AS part FROM blocks),
starts AS (SELECT doc_id, base, part, unnest(range(0, least(200, length(part) // 2 - 49))) AS step FROM cut WHERE length(part) >= 100),
strings AS (SELECT doc_id, base + step AS pos, substr(part, 2 * step + 1, 100) AS piece FROM starts),
least_doc AS (SELECT hash(piece) AS key, min(doc_id) AS first FROM strings GROUP BY 1),
hits AS (SELECT doc_id, pos FROM strings s JOIN least_doc l ON hash(s.piece) = l.key WHERE first < doc_id),
edges AS (
  SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM hits),
numbered AS (
  SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS span
  FROM edges),
spans AS (SELECT doc_id, span, min(pos) AS low, max(pos) + 50 AS high FROM numbered GROUP BY ALL),
gaps AS (
  SELECT doc_id, span, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY span), 0) AS low, low AS high FROM spans
  UNION ALL
  SELECT doc_id, 1 + max(span), max(high), max(length(raw)) // 2 FROM spans JOIN docs USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(raw, 2 * g.low + 1, 2 * (g.high - g.low)), '' ORDER BY span) AS raw FROM gaps g JOIN docs USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.raw) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.raw, d.raw))) AS kept_sha256
FROM docs d LEFT JOIN removed USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op12_exact_dedup": r"""
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal,
         row_number() OVER () AS line
  FROM documents),
placed AS (
  SELECT *, first_value(doc_id) OVER own AS keep_id, row_number() OVER own AS place, count(*) OVER (PARTITION BY normal) AS group_size
  FROM docs WINDOW own AS (PARTITION BY normal ORDER BY points DESC, doc_id NULLS LAST, line))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(normal) AS text_sha256 FROM placed""",
    "op13_hard_negatives": """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM good a JOIN good c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER own AS INT) AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW own AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER own <= 10""",
}
