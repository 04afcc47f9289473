"""DuckDB SQL for the queries that SQL can express. Document ids are taken as distinct and not null."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return f"regexp_extract_all({_LOWER.format(text) if lower else text}, '{pattern}')"


DECONTAMINATION = f"""
WITH items AS (SELECT DISTINCT item_id, {_words(_WORD, True)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + 7], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
d AS (SELECT doc_id, {_words(_WORD, True)} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win USING (n, x)),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_words(_BLANK, False)} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: Equal sets are one class, so copies are compared once; the classes' links are followed to a fixed point.
NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(_BLANK, True)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS x FROM d),
named AS (SELECT doc_id, x, md5(array_to_string(x, chr(10))) AS f FROM s),
class AS (SELECT f, min(doc_id) AS node, any_value(x) AS x FROM named WHERE len(x) > 0 GROUP BY f),
one AS (SELECT node, len(x) AS n, unnest(x) AS g FROM class),
pairs AS (SELECT a.node AS a, b.node AS b FROM one a JOIN one b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT node AS a, node AS b FROM class UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)
SELECT named.doc_id, CAST(len(named.x) AS BIGINT) AS n_shingles, coalesce(low.component, named.doc_id) AS component_id, coalesce(low.component, named.doc_id) = named.doc_id AS kept
FROM named LEFT JOIN class ON named.f = class.f AND len(named.x) > 0 LEFT JOIN low ON class.node = low.node"""

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, line, {_LOWER.format(f"trim(line, {_WS})")} AS k FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d)),
common AS (SELECT k FROM (SELECT DISTINCT doc_id, k FROM l WHERE k <> '') GROUP BY k HAVING count(*) >= 10),
kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN common USING (k) GROUP BY doc_id)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

ORACLES: dict[str, str] = {"op3_decontamination": DECONTAMINATION, "op4_substring_dedup": SUBSTRING, "op5_minhash_dedup": NEAR, "op7_line_dedup": LINES}
