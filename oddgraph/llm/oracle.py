"""SQL twins of the operators that SQL can express, over the same tables."""

from __future__ import annotations

import math

from oddgraph.llm.licenses import BASE, LEAST_SHARE, TEMPLATES

_SPACE = r"'[\x20\x09-\x0D]+'"
_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str, split: str) -> str:
    return f"list_filter(string_split_regex({text}, {split}), lambda x: x <> '')"


def _parts(node: str, links: str) -> str:
    """Smallest reachable node by a recursive closure."""
    return f"reach AS (SELECT a, b FROM {links} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b), part AS (SELECT a AS {node}, min(b) AS low FROM reach GROUP BY 1)"


OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND list_count(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_count(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.93
), {_parts("vec_id", "links")}, degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(low, m.vec_id)) AS component_id, m.vec_id = least(m.vec_id, coalesce(low, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN part USING (vec_id) LEFT JOIN degree USING (vec_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')", _SPACE)} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN low USING (h), (SELECT unnest(range(50)) AS k) WHERE doc_id > low),
g AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), {_UP}, {_LOW})", _SPACE)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], chr(31)) AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), {_parts("doc_id", "links")}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN part USING (doc_id)
"""


def _license_starts(phrase: str, key: str, exact: bool) -> str:
    """Starts (from 0) of a template in the word list w, by the same rule over all places."""
    words, ks = phrase.split(), key.split()
    same = [f"CAST(coalesce(w[i + {k + 1}] = '{word}', false) AS INT)" for k, word in enumerate(words)]
    at = next(k for k in range(len(words)) if words[k : k + len(ks)] == ks)
    rule = " AND ".join(f"{s} = 1" for s in same[at : at + len(ks)])
    if not exact:
        rule += f" AND {' + '.join(same)} >= {math.ceil(LEAST_SHARE * len(same))}"
    return f"list_filter(range(len(w)), lambda i: {rule})"


def _license_sql() -> str:
    split = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    every = [(p, p, label, True) for p, label in BASE] + [(p, k, label, False) for p, k, label in TEMPLATES]
    maybe = " OR ".join(f"list_contains(w, '{word}')" for word in sorted({k.split()[0] for _, k, _, _ in every}))
    found = ", ".join(f"CASE WHEN m THEN {_license_starts(p, k, exact)} ELSE [] END AS t{n}" for n, (p, k, _, exact) in enumerate(every))
    base = range(len(BASE))
    starts = " || ".join(f"t{k}" for k in base)
    labels = lambda ks: "[" + ", ".join(f"CASE WHEN len(t{k}) > 0 THEN '{every[k][2]}' END" for k in ks) + "]"
    joined = lambda ks: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({labels(ks)}, lambda x: x IS NOT NULL))), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), {_UP}, {_LOW})", split)} AS w FROM documents),
e AS (SELECT *, {maybe} AS m FROM d), f AS (SELECT doc_id, w, {found} FROM e)
SELECT doc_id, len(w)::BIGINT AS n_words, len({starts})::BIGINT AS n_base, list_min({starts})::BIGINT AS first_word, list_max({starts})::BIGINT AS last_word,
  {joined(base)} AS base_labels, {joined(range(len(every)))} AS labels, CASE WHEN {" OR ".join(f"len(t{k}) > 0" for k in range(len(every)))} THEN 1.0 ELSE 0.0 END::DOUBLE AS score
FROM f
"""


_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), {_UP}, {_LOW}), {_TERM})"


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w)) AS terms FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY 1, 2, 3, 4),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest({_terms("text")}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
v AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, docs),
x AS (SELECT item_id, doc_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score FROM q JOIN v USING (t) JOIN p USING (t), s GROUP BY 1, 2, 3),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k, doc_id, score FROM x WHERE score > 0)
SELECT item_id, k::INT AS rank, doc_id, score FROM o WHERE k <= 20
"""

_UNITS = r"'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'"

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, {_UNITS}) AS u, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""

ORACLE = {"op3_embedding_dedup": OP3, "op5_substring_dedup": OP5, "op6_jaccard_join": OP6, "op9_license_scan": _license_sql(), "op11_ranked_search": OP11, "op12_fill_in_middle": OP12}
