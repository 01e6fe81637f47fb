"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM cut
), ruled AS (
  SELECT *, CASE
      WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP9 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, {_words('text')} AS words FROM documents
), items AS (
  SELECT item_id, {_words('text')} AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, words[k + 1:k + 10] AS terms
  FROM (SELECT *, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS k FROM items WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT len(terms) AS n FROM windows
), runs AS (
  SELECT place, k, n, words[k + 1:k + n] AS terms
  FROM (SELECT *, unnest(range(0, len(words) - n + 1)) AS k FROM docs, sizes WHERE len(words) >= n)
), hits AS (
  SELECT place, k, n, item_id FROM runs JOIN windows USING (terms)
), covered AS (
  SELECT place, count(DISTINCT p) AS n_hit FROM (SELECT place, unnest(range(k, k + n)) AS p FROM hits) GROUP BY place
), named AS (
  SELECT place, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
  FROM (SELECT DISTINCT place, item_id::VARCHAR AS item FROM hits) GROUP BY place
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (place) LEFT JOIN named USING (place)
"""

OP11 = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
         list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
  FROM clean a JOIN clean c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""

LLM_ORACLE: dict[str, str] = {"op2_url_filter": OP2, "op9_positional_index": OP9, "op11_four_russians": OP11}
