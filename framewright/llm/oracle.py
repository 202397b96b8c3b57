"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from .decontamination import NEAR, WINDOW
from .license_scan import COPYRIGHT_LINES, NAMES_LICENCE, SPELLINGS
from .license_texts import DIGESTS, known_notices, known_texts
from .ngram_join import PERCENT, SHINGLE_WORDS

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op2() -> str:
    n = SHINGLE_WORDS
    return f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex({LOW}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}])) END AS s FROM worded
), one AS (
  SELECT doc_id, hash(unnest(s)) AS h FROM shingled
), sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM one a JOIN one b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= {PERCENT} * (x.n + y.n - s.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.node
), component AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY 1),
classes AS (
  SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s), CASE WHEN len(s) = 0 THEN doc_id END) END AS class_id FROM shingled
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, class_id FROM sizes JOIN component USING (doc_id) JOIN classes USING (doc_id)
"""


def _canonical(text: str, lines: bool) -> str:
    out = f"regexp_replace({text}, '{COPYRIGHT_LINES}', ' ', 'g')" if lines else text
    out = f"trim(regexp_replace(lower({out}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    spelled = out
    for pattern, written in SPELLINGS:
        spelled = f"regexp_replace({spelled}, '{pattern}', '{written.replace('$', chr(92))}', 'g')"
    return f"CASE WHEN regexp_matches({out}, 'licen[cs]e|copyright|warrant') THEN {spelled} ELSE {out} END"


def _values(known: dict[str, Sequence[str]]) -> str:
    return "VALUES " + ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, texts in known.items() for t in texts)


def _op8() -> str:
    return f"""
WITH whole AS (SELECT digest, min(k) AS license_id FROM (
  SELECT sha256({_canonical('t', True)}) AS digest, k FROM ({_values(known_texts())}) AS v(k, t)
  UNION ALL SELECT digest, k FROM ({_values(DIGESTS)}) AS v(k, digest)) GROUP BY 1),
notice AS (SELECT sha256({_canonical('t', True)}) AS line_digest, min(k) AS name FROM ({_values(known_notices())}) AS v(k, t) GROUP BY 1),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
digests AS (SELECT doc_id, sha256({_canonical('text', True)}) AS digest FROM docs),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs WHERE regexp_matches(text, '{NAMES_LICENCE}')),
named AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ',') AS notices
  FROM (SELECT doc_id, sha256({_canonical('line', False)}) AS line_digest FROM lines WHERE regexp_matches(line, '{NAMES_LICENCE}')) JOIN notice USING (line_digest) GROUP BY 1)
SELECT doc_id, digest, license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(notices, '') AS notices
FROM digests LEFT JOIN whole USING (digest) LEFT JOIN named USING (doc_id)
"""


def _op9() -> str:
    split = f"list_filter(string_split_regex({LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH items AS (SELECT item_id, {split} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, i AS place, w[i:i + {WINDOW - 1}] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(x) AS n FROM windows),
docs AS (SELECT doc_id, {split} AS w FROM documents),
hits AS (
  SELECT DISTINCT d.doc_id, i, n, item_id FROM (
    SELECT doc_id, n, i, w[i:i + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
  ) d JOIN windows USING (x)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1),
texts AS (SELECT row_number() OVER () AS tid, item_id, w FROM (SELECT DISTINCT item_id, w FROM items WHERE len(w) > 0)),
blocks AS (
  SELECT tid, item_id, i, list_distinct(w[i:i + {WINDOW - 1}]) AS x
  FROM (SELECT tid, item_id, w, unnest(list_distinct(list_append(range(1, greatest(len(w) - {WINDOW - 1}, 1), {WINDOW}), greatest(len(w) - {WINDOW - 1}, 1)))) AS i FROM texts)
),
wanted AS (SELECT tid, item_id, i, len(x) AS m, unnest(x) AS word FROM blocks),
postings AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
stretches AS (
  SELECT doc_id, item_id, m, list(word) OVER (PARTITION BY doc_id, tid, i ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW + WINDOW // 4 - 1} FOLLOWING) AS held
  FROM postings JOIN wanted USING (word)
),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM stretches
  WHERE 100 * len(list_distinct(held)) >= {NEAR} * m AND (doc_id, item_id) NOT IN (SELECT (doc_id, item_id) FROM hits) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": _op2(), "op8_license_scan": _op8(), "op9_decontamination": _op9()}
