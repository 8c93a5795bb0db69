"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

import string

from fieldglass.llm.mixing import BUDGET_SHARE, MAX_EPOCHS, MIN_QUALITY, WEIGHTS

WORD_LIST = r"coalesce(regexp_extract_all({t}, '[^\x20\x09-\x0D]+'), [])"

MIXING = f"""WITH d AS (SELECT doc_id, source, len({WORD_LIST.format(t='text')}) AS size, -ln((CAST(('0x' || substr(md5('mix:' || doc_id), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / CASE WHEN length(text) > 0 THEN greatest({MIN_QUALITY}::DOUBLE, 1.0::DOUBLE - length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::DOUBLE / length(text)::DOUBLE) ELSE 1.0::DOUBLE END AS key FROM documents),
 p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([{', '.join(map(str, WEIGHTS))}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT))::DOUBLE AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
 c AS (SELECT *, {MAX_EPOCHS}::DOUBLE * source_size AS cap FROM p),
 l AS (SELECT *, ({BUDGET_SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level, row_number() OVER (ORDER BY cap / weight, rank) AS k
  FROM c WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT arg_min(level, k) AS level FROM l WHERE cap / weight > level),
 t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM c),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
 r AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS share, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, epochs + CASE WHEN share > 0 AND middle <= share THEN 1 ELSE 0 END AS copies, (epochs + CASE WHEN share > 0 AND middle <= share THEN 1 ELSE 0 END) * size AS taken FROM r"""

LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORD_LIST.format(t=LOWER)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 c AS (SELECT doc_id AS node, doc_id AS component FROM documents UNION SELECT e.b, c.component FROM c JOIN e ON c.node = e.a WHERE c.component < e.b),
 m AS (SELECT node, min(component) AS component_id FROM c GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON node = documents.doc_id"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {WORD_LIST.format(t='text')} AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
 k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM s),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE k > 1),
 x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
 y AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN g USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"""

ORACLE_SQL = {"op6_mixing": MIXING, "op8_minhash_dedup": NEAR, "op10_substring_dedup": SUBSTRING}
