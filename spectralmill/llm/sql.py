"""ANSI SQL of the llm queries that SQL can express, over whole tables."""

from __future__ import annotations

from spectralmill.plans.sql import BLANKS, CELLS, VECTORS

MARGINS = f"""{CELLS}, by_label AS (
  SELECT label, CAST(sum(count) AS BIGINT) AS record_total FROM cells GROUP BY label
), by_kmer AS (
  SELECT kmer, CAST(sum(count) AS BIGINT) AS term_total, count(*) AS holders FROM cells GROUP BY kmer
), whole AS (
  SELECT CAST(sum(record_total) AS BIGINT) AS n, count(*) AS labels FROM by_label
)"""

MARKED = f"""WITH {MARGINS}, marked AS (
  SELECT kmer, holders AS non_zero, term_total AS sum,
         CASE WHEN holders < 3 OR term_total < 6 THEN 'rare' WHEN 10 * holders > 6 * labels THEN 'common' ELSE 'useful' END AS mark
  FROM by_kmer, whole
)"""


NEAREST = f"""WITH {VECTORS}, vectors AS (
  SELECT label, CAST(coords AS DOUBLE[32]) AS v FROM latest
), pairs AS (
  SELECT a.label AS label, b.label AS neighbour, round(array_distance(a.v, b.v), 6) AS distance FROM vectors a JOIN vectors b ON a.label <> b.label
), ranked AS (
  SELECT label, neighbour, distance, row_number() OVER (PARTITION BY label ORDER BY distance, neighbour) AS rank FROM pairs WHERE distance <= 1.5
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {MARGINS} SELECT label, kmer FROM cells JOIN by_label USING (label) JOIN by_kmer USING (kmer), whole WHERE 25 * count >= record_total AND holders >= 2 AND 50 * holders <= labels",
        "p1_scores": f"""WITH {MARGINS}, expect AS (
  SELECT label, kmer, count, record_total, term_total, n, record_total * (term_total / CAST(n AS DOUBLE)) AS e FROM cells JOIN by_label USING (label) JOIN by_kmer USING (kmer), whole
) SELECT label, kmer, count, round((count - e) / sqrt(e), 6) AS residual,
  round((count - e) / sqrt(e) / nullif(sqrt((1 - record_total / CAST(n AS DOUBLE)) * (1 - term_total / CAST(n AS DOUBLE))), 0), 6) AS adjusted_residual FROM expect""",
        "p2_found": f"{NEAREST} SELECT DISTINCT least(label, neighbour) AS label_a, greatest(label, neighbour) AS label_b FROM ranked WHERE rank <= 5",
        "p2_neighbours": f"{NEAREST} SELECT label, neighbour, CAST(rank AS INTEGER) AS rank, distance FROM ranked WHERE rank <= 5",
        "p2_search": f"{NEAREST} SELECT label, neighbour, CAST(rank AS INTEGER) AS rank, distance FROM ranked WHERE rank <= 5 AND TRY_CAST(regexp_extract(label, '([0-9]+)$', 1) AS BIGINT) % 50 = 0",
        "p3_found": f"""WITH {VECTORS}, vectors AS (
  SELECT label, CAST(coords AS DOUBLE[32]) AS v FROM latest
), around AS (
  SELECT a.label AS label, list(b.label ORDER BY b.label) AS near FROM vectors a JOIN vectors b ON array_distance(a.v, b.v) <= 1.5 GROUP BY a.label
), same AS (
  SELECT near, count(*) AS members FROM around GROUP BY near
) SELECT near[1] AS cluster_label, unnest(near) AS label FROM same WHERE members = len(near) AND members >= 5""",
        "p5_found": f"{MARKED} SELECT kmer, mark FROM marked WHERE mark <> 'useful'",
        "p5_ngrams": """WITH d AS (SELECT doc_id, lower(w) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS ws FROM documents))
), g AS (
  SELECT doc_id, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), n AS (
  SELECT doc_id, a AS ngram, 1 AS words FROM g UNION ALL SELECT doc_id, a || ' ' || b, 2 FROM g WHERE b IS NOT NULL UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c, 3 FROM g WHERE c IS NOT NULL
) SELECT ngram, CAST(words AS INTEGER) AS words, count(*) AS count, count(DISTINCT doc_id) AS records FROM n GROUP BY ngram, words""",
        "p6_found": """WITH item_words AS (SELECT item_id AS id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM eval_items),
 doc_words AS (SELECT doc_id AS id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents),
 item_runs AS (SELECT DISTINCT id AS item_id, lower(array_to_string(w[i : i + 19], ' ')) AS run FROM (SELECT id, w, unnest(range(1, len(w) - 18)) AS i FROM item_words)),
 doc_runs AS (SELECT DISTINCT id AS doc_id, lower(array_to_string(w[i : i + 19], ' ')) AS run FROM (SELECT id, w, unnest(range(1, len(w) - 18)) AS i FROM doc_words))
SELECT DISTINCT doc_id, item_id FROM doc_runs JOIN item_runs USING (run)""",
        "p7_sources": f"""WITH want AS (
  SELECT lower(trim(source, {BLANKS})) AS source, max(target_share) AS target_share, min(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats >= 1 GROUP BY 1
), have AS (
  SELECT lower(trim(source, {BLANKS})) AS source, count(*) AS documents FROM documents WHERE length(text) > 0 GROUP BY 1
), joined AS (
  SELECT want.source, target_share, max_repeats, coalesce(documents, 0) AS documents FROM want LEFT JOIN have USING (source)
) SELECT source, target_share, CAST(max_repeats AS INTEGER) AS max_repeats, documents, round(CASE WHEN documents > 0 THEN target_share ELSE 0 END / (SELECT sum(target_share) FROM joined WHERE documents > 0), 6) AS wanted_share,
  true AS share_met, true AS cap_met FROM joined""",
        "p5_terms": f"{MARKED} SELECT kmer, non_zero, sum, mark FROM marked",
    }
