"""SQL twins of the queries, for an independent engine over the same tables."""

from __future__ import annotations

# Named relations; a twin lists those it needs in order.
_REL = {
    "vec": "SELECT vec_id AS id, embedding::DOUBLE[] AS f, CAST(label = 0 AS INT) AS y, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings",
    "knn": "SELECT src, dst, w FROM (SELECT a.id AS src, b.id AS dst, round(list_inner_product(a.u, b.u), 12) AS w, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.u, b.u), 12) DESC, b.id) AS r FROM vec a, vec b WHERE a.id <> b.id) WHERE r <= 5",
    "und": "SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn) WHERE src <> dst",
    "unw": "SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM knn",
    "half": "SELECT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2",
    "ps": "SELECT * FROM half UNION ALL SELECT dst, src, w FROM half",
    "psn": "SELECT 2 * p_partkey AS id, [p_retailprice / 997.3::DOUBLE, p_size / 7.123::DOUBLE] AS f, CAST((2 * p_partkey) % 10 = 0 AS INT) AS y FROM part UNION ALL SELECT 2 * s_suppkey + 1, [s_acctbal / 997.3::DOUBLE, 1 / 7.123::DOUBLE], CAST((2 * s_suppkey + 1) % 10 = 0 AS INT) FROM supplier",
    "psl": "SELECT * FROM ps UNION ALL SELECT id, id, 2.0 FROM psn WHERE id % 3 = 0",
    "pb": "SELECT DISTINCT src, dst, 1.0::DOUBLE AS w FROM ps WHERE w <> 0",
    "doc": "SELECT d.doc_id AS id, d.n_chars::DOUBLE AS n_chars, l.y, l.y IS NOT NULL AS mark FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS y FROM labels GROUP BY 1) l USING (doc_id)",
    "tree": "SELECT n_regionkey + 1000000::BIGINT AS src, n_nationkey + 2000000::BIGINT AS dst FROM nation UNION ALL SELECT c_nationkey + 2000000::BIGINT, c_custkey + 3000000::BIGINT FROM customer",
    "aff": "SELECT v.id, round(coalesce(s, 0) / coalesce(nullif(d, 0), 1), 6) AS m, v.y FROM vec v LEFT JOIN (SELECT src, sum(w * list_inner_product(a.u, b.u)) AS s FROM und JOIN vec a ON a.id = src JOIN vec b ON b.id = dst GROUP BY 1) x ON x.src = v.id LEFT JOIN (SELECT dst, sum(w) AS d FROM und GROUP BY 1) c ON c.dst = v.id",
    "sc": "SELECT id, y, round(1 - (m - lo) / (hi - lo), 6) AS score FROM aff, (SELECT min(m) AS lo, max(m) AS hi FROM aff)",
    "cnt": "SELECT score, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY 1",
    "res": "SELECT event_type AS method, 't' || (user_id % 6) AS target, CASE WHEN event_id % 2 = 0 THEN 'single' ELSE 'multi' END AS mode, event_id % 5 AS seed, avg(1 / (1 + exp(-value / 100))) AS auroc FROM events GROUP BY 1, 2, 3, 4",
    "det": "SELECT method, 'real' AS src_type, 'real' AS tgt_type, target, mode, round(avg(auroc), 4) AS auroc_mean, round(stddev_pop(auroc), 4) AS auroc_std, count(auroc) AS n FROM res GROUP BY 1, 4, 5",
    "delta": "SELECT method, src_type, tgt_type, target, max(CASE WHEN mode = 'single' THEN auroc_mean END) AS single_auroc, max(CASE WHEN mode = 'multi' THEN auroc_mean END) AS multi_auroc, round(max(CASE WHEN mode = 'multi' THEN auroc_mean END) - max(CASE WHEN mode = 'single' THEN auroc_mean END), 4) AS delta FROM det WHERE NOT (target = 't3' AND mode = 'multi') GROUP BY 1, 2, 3, 4",
    "sweep": "SELECT event_type AS context_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 5 END AS shot, event_id % 3 AS seed, 't' || (user_id % 6) AS target, min(CASE WHEN user_id % 6 = 4 AND event_id % 2 = 1 THEN 'skipped' WHEN user_id % 6 = 5 AND event_id % 3 = 0 THEN 'failed' ELSE 'ok' END) AS status, avg(1 / (1 + exp(-value / 100))) AS auroc FROM events GROUP BY 1, 2, 3, 4",
    "sup": "SELECT * FROM (SELECT * FROM vec WHERE y = 0 ORDER BY id LIMIT 10) UNION ALL SELECT * FROM (SELECT * FROM vec WHERE y = 1 ORDER BY id LIMIT 10)",
    "ctr": "SELECT k.j, c.y, avg(s.f[k.j]) AS c FROM (SELECT unnest(range(1, 65)) AS j) k, (VALUES (0), (1)) c(y) LEFT JOIN sup s ON s.y = c.y GROUP BY 1, 2",
    "cc": "SELECT list(coalesce(a.c, 0) ORDER BY a.j) AS c0, list(coalesce(b.c, 0) ORDER BY a.j) AS c1 FROM ctr a JOIN ctr b USING (j) WHERE a.y = 0 AND b.y = 1",
}
_NEED = {"knn": ["vec"], "und": ["knn"], "unw": ["knn"], "ps": ["half"], "psl": ["ps", "psn"], "pb": ["ps"], "aff": ["und"], "sc": ["aff"], "cnt": ["sc"], "det": ["res"], "delta": ["det"], "sup": ["vec"], "ctr": ["sup"], "cc": ["ctr"]}


def _with(need: str, body: str, **more: str) -> str:
    """A query over the named relations and what they rest on, then further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEED.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in need.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({_REL[n]})" for n in order] + [f"{n} AS MATERIALIZED ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}"


def _long(rel: str, *cols: str) -> str:
    """(id, hop, j, v) of array columns."""
    return " UNION ALL ".join(f"SELECT id, {k}::INT AS hop, (j - 1)::INT AS j, round({c}[j], 6) AS v FROM {rel}, LATERAL (SELECT unnest(range(1, len({c}) + 1)) AS j)" for k, c in enumerate(cols))


def _sum2(end: str, other: str, edge: str, x: str, weight: str = "e.w") -> str:
    """Vectors of two entries summed over edges: rows at ``end`` from features at ``other``."""
    return f"SELECT x.id, [coalesce(g.a, 0), coalesce(g.b, 0)] AS f FROM {x} x LEFT JOIN (SELECT e.{end} AS id, sum({weight} * x.f[1]) AS a, sum({weight} * x.f[2]) AS b FROM {edge} e JOIN {x} x ON x.id = e.{other} GROUP BY 1) g USING (id)"


def _sumw(end: str, other: str, edge: str, x: str) -> str:
    """The same for whole vectors."""
    one = f"SELECT e.{end} AS id, k.j, sum(e.w * x.f[k.j]) AS c FROM {edge} e JOIN {x} x ON x.id = e.{other}, (SELECT unnest(range(1, 65)) AS j) k GROUP BY 1, 2"
    return f"SELECT x.id, coalesce(g.f, list_transform(x.f, lambda v: 0.0)) AS f FROM {x} x LEFT JOIN (SELECT id, list(c ORDER BY j) AS f FROM ({one}) GROUP BY 1) g USING (id)"


def _summed(edges: str) -> str:
    return f"SELECT src, count(*) AS n, round(sum(w), 6) AS w, sum(dst)::BIGINT AS dsts FROM ({edges}) GROUP BY 1"


_KEY = "md5('42:' || id)"
_U = "(('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0)"
_OUT, _IN = "(SELECT src AS id, sum(w) AS d FROM {e} GROUP BY 1)", "(SELECT dst AS id, sum(w) AS d, count(*) AS k FROM {e} GROUP BY 1)"


def _p(x: str, p: str = "-0.5") -> str:
    return f"CASE WHEN {x} > 0 THEN pow({x}, {p}) ELSE 0 END"


def _sym_t(e: str) -> str:
    return f"SELECT e.dst AS src, e.src AS dst, e.w * {_p('coalesce(a.d, 0)')} * {_p('coalesce(b.d, 0)')} AS w FROM {e} e LEFT JOIN {_OUT.format(e=e)} a ON a.id = e.src LEFT JOIN {_OUT.format(e=e)} b ON b.id = e.dst"


def _rank(pool: str, name: str = "r", key: str = _KEY, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT *, row_number() OVER ({part}ORDER BY {key}, id) AS {name} FROM {pool}"


def _per_class(pool: str, k: int) -> str:
    return (
        f"SELECT s.y, s.slot::INT AS slot, p.id FROM (SELECT y, n, unnest(range({k})) AS slot FROM (SELECT y, count(*) AS n FROM {pool} GROUP BY 1)) s"
        f" JOIN ({_rank(pool, by='y')}) p ON p.y = s.y AND p.r = s.slot % s.n + 1"
    )


def _ends(e: str, x: str = "vec") -> str:
    return f"{e} e JOIN {x} a ON a.id = e.src JOIN {x} b ON b.id = e.dst"


_L2 = "sqrt(list_sum(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_L1 = "list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))"
_COS = "list_inner_product(a.f, b.f) / (sqrt(list_inner_product(a.f, a.f)) * sqrt(list_inner_product(b.f, b.f)))"


def _dist(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _cos(a: str, b: str) -> str:
    return f"(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))"


_MM = "SELECT v.id, k.j, CASE WHEN b.hi > b.lo THEN (v.f[k.j] - b.lo) / (b.hi - b.lo) ELSE 0 END AS x FROM vec v, (SELECT unnest(range(1, 65)) AS j) k JOIN (SELECT j, min(f[j]) AS lo, max(f[j]) AS hi FROM vec, (SELECT unnest(range(1, 65)) AS j) GROUP BY 1) b USING (j)"
_SMOOTH = "SELECT (a.j - 1)::INT AS j, avg((a.x - b.x) * (a.x - b.x)) AS smooth FROM und e JOIN mm a ON a.id = e.src JOIN mm b ON b.id = e.dst AND b.j = a.j GROUP BY 1"
_LOOPED = "SELECT src, dst, w FROM psl WHERE src <> dst UNION ALL SELECT id, id, 1.0 FROM psn"
_RAWLOOP = "SELECT src, dst, sum(w) AS w FROM (SELECT * FROM psl UNION ALL SELECT id, id, 1.0 FROM psn) GROUP BY 1, 2"
_PROP = {  # two hops with the added loop on the binary supply graph
    "dg": "SELECT id, 1 + coalesce(d, 0) AS d FROM psn LEFT JOIN (SELECT src AS id, sum(w) AS d FROM pb GROUP BY 1) USING (id)",
    "an": "SELECT e.src, e.dst, e.w * pow(a.d, -0.5) * pow(b.d, -0.5) AS w FROM pb e JOIN dg a ON a.id = e.src JOIN dg b ON b.id = e.dst UNION ALL SELECT id, id, 1 / d FROM dg",
    "x1": _sum2("dst", "src", "an", "psn"),
    "x2": _sum2("dst", "src", "an", "x1"),
    "hops": "SELECT a.id, a.f AS h0, b.f AS h1, c.f AS h2 FROM psn a JOIN x1 b USING (id) JOIN x2 c USING (id)",
}
_LAP = {
    "pw": "SELECT id, pow(greatest(coalesce(k, 0), 1), -0.5) AS p FROM psn LEFT JOIN (SELECT dst AS id, count(*) AS k FROM ps GROUP BY 1) USING (id)",
    "an": "SELECT e.src, e.dst, a.p * b.p AS w FROM ps e JOIN pw a ON a.id = e.src JOIN pw b ON b.id = e.dst",
    "m1": _sum2("dst", "src", "an", "psn"),
    "x1": "SELECT a.id, [a.f[1] - b.f[1], a.f[2] - b.f[2]] AS f FROM psn a JOIN m1 b USING (id)",
    "m2": _sum2("dst", "src", "an", "x1"),
    "x2": "SELECT a.id, [a.f[1] - b.f[1], a.f[2] - b.f[2]] AS f FROM x1 a JOIN m2 b USING (id)",
    "hops": "SELECT a.id, a.f AS h0, b.f AS h1, c.f AS h2 FROM psn a JOIN x1 b USING (id) JOIN x2 c USING (id)",
}
_TRI = {
    "deg": "SELECT src AS id, count(*) AS k FROM und GROUP BY 1",
    "loc": "SELECT v.id, coalesce(k, 0) / (SELECT max(k) FROM deg)::DOUBLE AS degree, CASE WHEN k > 1 THEN coalesce(t, 0)::DOUBLE / (k * (k - 1)) ELSE 0 END AS clustering FROM vec v LEFT JOIN deg USING (id) LEFT JOIN (SELECT a.src AS id, count(*) AS t FROM und a JOIN und b ON b.src = a.src AND b.dst <> a.dst JOIN und c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1) USING (id)",
}
_MEANDIFF = {
    "nb": "SELECT e.src AS id, list(m ORDER BY j) AS m FROM (SELECT e.src, k.j, avg(b.f[k.j]) AS m FROM knn e JOIN vec b ON b.id = e.dst, (SELECT unnest(range(1, 65)) AS j) k GROUP BY 1, 2) e GROUP BY 1",
    "df": f"SELECT v.id, v.y, CASE WHEN nb.m IS NULL THEN 0 ELSE {_cos('v.f', 'nb.m')} END AS c FROM vec v LEFT JOIN nb USING (id)",
}
_BETA = [[3, -3, 0.75], [0, 3, -1.5], [0, 0, 0.75]]
_HOPB = "SELECT id, " + ", ".join(f"[{', '.join(f'{t[0]} * h0[{i}] + {t[1]} * h1[{i}] + {t[2]} * h2[{i}]' for i in (1, 2))}] AS b{k}" for k, t in enumerate(_BETA)) + " FROM hops"
_NBR = {
    how: f"SELECT x.id, [coalesce(g.a, 0), coalesce(g.b, 0)] AS f FROM psn x LEFT JOIN (SELECT e.dst AS id, {fn}(x.f[1]) AS a, {fn}(x.f[2]) AS b FROM ps e JOIN psn x ON x.id = e.src GROUP BY 1) g USING (id)"
    for how, fn in (("sum", "sum"), ("mean", "avg"), ("max", "max"))
}
_MOM = "SELECT avg(f[1]) AS m1, avg(f[2]) AS m2, stddev_pop(f[1]) AS s1, stddev_pop(f[2]) AS s2, min(f[1]) AS a1, max(f[1]) AS b1, min(f[2]) AS a2, max(f[2]) AS b2 FROM psn"
_RECALL = "CASE WHEN max(k) > 0 THEN sum(CASE WHEN r <= k THEN y ELSE 0 END) / max(k)::DOUBLE ELSE 'nan'::DOUBLE END"


def _auc(rel: str) -> str:
    return f"SELECT sum(p * (below + 0.5 * n)) / (sum(p) * sum(n)) AS auroc FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {rel})"


def _ap(rel: str) -> str:
    return f"SELECT sum(p * tp / k::DOUBLE) / sum(p) AS auprc FROM (SELECT p, sum(p) OVER w AS tp, sum(p + n) OVER w AS k FROM {rel} WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


def _rec(rel: str) -> str:
    return f"SELECT {_RECALL} AS recall_at_k FROM (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS r, sum(y) OVER () AS k FROM {rel})"


_ALL3 = "SELECT round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(recall_at_k, 6) AS recall_at_k FROM ({a}), ({b}), ({c})"
_MARKED = {"md": "SELECT id, y, n_chars AS score FROM doc WHERE mark", "mc": "SELECT score, sum(y) AS p, sum(1 - y) AS n FROM md GROUP BY 1"}
_PAGE = {"nr": "SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM unw", "p0": "SELECT id, 1.0::DOUBLE / count(*) OVER () AS p, count(*) OVER () AS n FROM vec"}
for _i in range(1, 6):
    _PAGE[f"g{_i}"] = f"SELECT v.id, v.n, coalesce(g, 0) AS g FROM p{_i - 1} v LEFT JOIN (SELECT dst AS id, sum(w * p) AS g FROM nr JOIN p{_i - 1} q ON q.id = nr.src GROUP BY 1) USING (id)"
    _PAGE[f"p{_i}"] = f"SELECT id, n, 0.15 / n + 0.85 * (g + (SELECT 1 - sum(g) FROM g{_i}) / n) AS p FROM g{_i}"
_POOL = "(SELECT id, y FROM doc WHERE mark)"
_DIV = {
    "pc": "SELECT a.src AS id, list_inner_product(x.u, z.u) AS c FROM knn a JOIN knn b ON b.src = a.src AND a.dst < b.dst JOIN vec x ON x.id = a.dst JOIN vec z ON z.id = b.dst",
}
_TPCA = {
    "cp": f"SELECT e.src AS id, exp(-pow({_L2}, 2)) AS c, b.f FROM {_ends('knn', 'vec')}",
    "ag": "SELECT id, [" + ", ".join(f"sum(c * f[{i}]) / sum(c)" for i in range(1, 65)) + "] AS m, avg(c) AS c FROM cp GROUP BY 1",
    "ts": f"SELECT v.id, 1 - a.c AS topology, {_dist('v.f', 'a.m')} AS drift FROM vec v JOIN ag a USING (id)",
}
_CODES = {"codes": "SELECT id AS code, f AS c FROM vec WHERE id < 20"}
_NEAR = "SELECT id, code, c, s FROM (SELECT v.id, k.code, k.c, list_inner_product(v.f, k.c) AS s, row_number() OVER (PARTITION BY v.id ORDER BY round(list_inner_product(v.f, k.c), 12) DESC, k.code) AS r FROM {x} v, codes k) WHERE r = 1"
_TRUNC = {
    "ed": f"SELECT e.src, e.dst, {_L2} AS dist FROM {_ends('und')}",
    "cut": f"SELECT src AS id, CASE WHEN max(dist) > (SELECT avg(dist) FROM ed WHERE dist <> 0) THEN (SELECT avg(dist) FROM ed WHERE dist <> 0) + {_U.format(k=chr(39) + '42:' + chr(39) + ' || src')} * (max(dist) - (SELECT avg(dist) FROM ed WHERE dist <> 0)) ELSE max(dist) END AS t FROM ed GROUP BY 1",
    "kept": "SELECT ed.src, ed.dst FROM ed JOIN cut ON cut.id = ed.src WHERE dist <= t",
}


def _core(k: int, rounds: int) -> str:
    more = {"c0": "SELECT src, dst FROM und"}
    for i in range(1, rounds + 1):
        strong = f"(SELECT src FROM c{i - 1} GROUP BY 1 HAVING count(*) >= {k})"
        more[f"c{i}"] = f"SELECT src, dst FROM c{i - 1} WHERE src IN {strong} AND dst IN {strong}"
    return _with("und", f"SELECT DISTINCT src AS id FROM c{rounds}", **more)


def _cores(edges: str, rounds: int) -> dict[str, str]:
    """cn(id, core) by so many rounds of h-indexes of the neighbours' values."""
    more = {"h0": f"SELECT src AS id, count(*) AS c FROM {edges} GROUP BY 1"}
    for i in range(1, rounds + 1):
        seen = f"SELECT e.src, h.c, count(*) OVER (PARTITION BY e.src ORDER BY h.c DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {edges} e JOIN h{i - 1} h ON h.id = e.dst"
        more[f"h{i}"] = f"SELECT src AS id, max(least(c, n)) AS c FROM ({seen}) GROUP BY 1"
    return more | {"cn": f"SELECT id, c AS core FROM h{rounds}"}


def _ranks(rounds: int, tolerance: str) -> dict[str, str]:
    """pr(id, p, rounds): the first of so many rounds of PageRank whose summed change is below the tolerance times the nodes."""
    more = {k: _PAGE[k] for k in ("nr", "p0")}
    for i in range(1, rounds + 1):
        more[f"g{i}"] = _PAGE["g1"].replace("p0", f"p{i - 1}")
        more[f"p{i}"] = _PAGE["p1"].replace("g1", f"g{i}")
    every = " UNION ALL ".join(f"SELECT {i} AS i, a.id, a.n, a.p, abs(a.p - b.p) AS d FROM p{i} a JOIN p{i - 1} b USING (id)" for i in range(1, rounds + 1))
    more["ap"] = every
    return more | {"pr": f"SELECT id, p, i AS rounds FROM ap WHERE i = (SELECT min(i) FROM (SELECT i FROM ap GROUP BY i HAVING sum(d) < {tolerance} * max(n)))"}


def _u(*keys: str, seed: int = 42) -> str:
    return _U.format(k=f"'{seed}:' || " + " || ':' || ".join(keys))


def _tam(cuttings: int) -> dict[str, str]:
    """mn(id, m): mean affinity over so many cuttings of the graph und."""
    more = {"lo": "SELECT * FROM und UNION ALL SELECT id, id, 1.0 FROM vec", "e0": "SELECT src, dst FROM und"}
    for i in range(1, cuttings + 1):
        more[f"d{i}"] = f"SELECT e.src, e.dst, {_L2} AS dist FROM {_ends(f'e{i - 1}')}"
        mu = f"(SELECT avg(dist) FROM d{i} WHERE dist <> 0)"
        more[f"t{i}"] = f"SELECT src AS id, CASE WHEN max(dist) > {mu} THEN {mu} + {_u('src', seed=41 + i)} * (max(dist) - {mu}) ELSE max(dist) END AS t FROM d{i} GROUP BY 1"
        kept = f"SELECT d.src, d.dst FROM d{i} d JOIN t{i} t ON t.id = d.src WHERE d.dist <= t.t"
        more[f"e{i}"] = f"SELECT src, dst FROM ({kept}) UNION SELECT dst, src FROM ({kept})"
        more[f"l{i}"] = f"SELECT src, dst, 1.0::DOUBLE AS w FROM e{i} UNION ALL SELECT id, id, 1.0 FROM vec"
        more[f"c{i}"] = f"SELECT dst AS id, sum(w) AS c FROM l{i} GROUP BY 1"
        more[f"n{i}"] = f"SELECT e.src, e.dst, e.w / sqrt(a.c * b.c) AS w FROM l{i} e JOIN c{i} a ON a.id = e.src JOIN c{i} b ON b.id = e.dst"
        more[f"x{i}"] = _sumw("src", "dst", f"n{i}", "vec")
        more[f"m{i}"] = f"SELECT e.src AS id, sum({_cos('a.f', 'b.f')}) AS s FROM lo e JOIN x{i} a ON a.id = e.src JOIN x{i} b ON b.id = e.dst GROUP BY 1"
    sums = " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(1, cuttings + 1))
    more["mn"] = f"SELECT a.id, avg(s / d) AS m FROM ({sums}) a JOIN (SELECT dst AS id, sum(w) AS d FROM lo GROUP BY 1) c USING (id) GROUP BY 1"
    return more


_TRIPLETS = {
    "circle": f"SELECT id AS cand, row_number() OVER (ORDER BY {_KEY}, id) - 1 AS place FROM vec",
    "chosen": "SELECT * FROM (SELECT DISTINCT src, dst FROM knn WHERE src <> dst) ORDER BY md5('42:' || src || ':' || dst), src || ':' || dst LIMIT 200",
    "walk": f"SELECT src, dst, i, (floor({_u('src', 'dst', seed=43)} * (SELECT count(*) FROM vec))::BIGINT + i) % (SELECT count(*) FROM vec) AS place FROM chosen, (SELECT unnest(range((SELECT count(*) FROM vec))) AS i)",
    "tri": "SELECT * FROM (SELECT w.src AS anchor, w.dst AS positive, row_number() OVER (PARTITION BY w.src, w.dst ORDER BY w.i) AS slot, c.cand AS negative FROM walk w JOIN circle c USING (place) LEFT JOIN (SELECT DISTINCT src, dst FROM knn) e ON e.src = w.src AND e.dst = c.cand WHERE e.src IS NULL AND c.cand <> w.src) WHERE slot <= 4",
}

ORACLE: dict[str, str] = {
    "auroc_affinity_vec": _with("cnt", f"SELECT round(auroc, 6) AS auroc FROM ({_auc('cnt')})"),
    "auprc_affinity_vec": _with("cnt", f"SELECT round(auprc, 6) AS auprc FROM ({_ap('cnt')})"),
    "recall_at_k_vec": _with("sc", f"SELECT round(recall_at_k, 6) AS recall_at_k FROM ({_rec('sc')})"),
    "flagship_report": _with("cnt", _ALL3.format(a=_auc("cnt"), b=_ap("cnt"), c=_rec("sc"))),
    "auroc_marked_doc": _with("doc", _ALL3.format(a=_auc("mc"), b=_ap("mc"), c=_rec("md")), **_MARKED),
    "knn_exact": _with("knn", "SELECT src, dst, round(w, 6) AS w FROM knn"),
    "undirect_binary": _with("und", "SELECT * FROM und"),
    "bin_directed": _with("unw", "SELECT * FROM unw WHERE src <> dst"),
    "drop_self_loops": _with("psl", _summed("SELECT * FROM psl WHERE src <> dst")),
    "unit_self_loops": _with("psl", _summed(_LOOPED)),
    "add_loops_raw": _with("psl", _summed(_RAWLOOP)),
    "conditional_loops": _with("psl", f"SELECT a.src, a.w AS with_loops, b.w AS without FROM ({_summed(_RAWLOOP)}) a LEFT JOIN ({_summed('SELECT * FROM psl')}) b USING (src)"),
    "dedup_sum": _with("half", _summed("SELECT * FROM half")),
    "max_symmetrise": _with("ps psn", _summed("SELECT src, dst, max(w) AS w FROM (SELECT * FROM ps WHERE src % 4 < 2 AND dst % 4 < 2 AND src IN (SELECT id FROM psn) AND dst IN (SELECT id FROM psn) UNION ALL SELECT id, id, 1.0 FROM psn WHERE id % 4 < 2) GROUP BY 1, 2")),
    "validate_edges": _with("psl", "SELECT count(*) AS n_edges, count(*) FILTER (isnan(w) OR isinf(w) OR w < 0) AS bad_weights, count(*) FILTER (src = dst) AS n_loops, (SELECT count(*) FROM (SELECT src FROM psl UNION SELECT dst FROM psl) x(id) WHERE id NOT IN (SELECT id FROM psn WHERE id % 7 <> 0)) AS unknown_ids FROM psl"),
    "not_evaluable": _with("doc", "SELECT count(*) FILTER (y NOT IN (0, 1)) AS bad_labels, count(*) FILTER (id % 5 = 0) AS bad_scores FROM doc WHERE mark"),
    "degree_in_out": _with("knn", f"SELECT v.id, round(coalesce(o.d, 0), 6) AS out_w, round(coalesce(i.d, 0), 6) AS in_w, coalesce(i.k, 0) AS in_count FROM vec v LEFT JOIN {_OUT.format(e='knn')} o USING (id) LEFT JOIN {_IN.format(e='knn')} i USING (id)"),
    "degree_tree": _with("tree", "SELECT x.id, coalesce(o.d, 0)::DOUBLE AS out_w, coalesce(i.d, 0)::DOUBLE AS in_w, coalesce(i.d, 0) AS in_count FROM (SELECT src AS id FROM tree UNION SELECT dst FROM tree) x LEFT JOIN (SELECT src AS id, count(*) AS d FROM tree GROUP BY 1) o USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS d FROM tree GROUP BY 1) i USING (id)"),
    "norm_sym_transposed": _with("knn", f"SELECT src, dst, round(w, 6) AS w FROM ({_sym_t('knn')})"),
    "norm_sym_plus_i": _with("knn", f"SELECT src, dst, round(sum(w), 6) AS w FROM ({_sym_t('knn')} UNION ALL SELECT id, id, 1.0 FROM vec) GROUP BY 1, 2"),
    "norm_sym_column": _with("knn", f"SELECT e.src, e.dst, round(e.w * {_p('coalesce(a.d, 0)')} * {_p('coalesce(b.d, 0)')}, 6) AS w FROM knn e LEFT JOIN {_IN.format(e='knn')} a ON a.id = e.src LEFT JOIN {_IN.format(e='knn')} b ON b.id = e.dst"),
    "norm_column": _with("knn", f"SELECT e.src, e.dst, round(CASE WHEN coalesce(a.d, 0) > 0 THEN e.w / a.d ELSE 0 END, 6) AS w FROM knn e LEFT JOIN {_IN.format(e='knn')} a ON a.id = e.src"),
    "norm_sym_directed": _with("knn", f"SELECT dst AS src, src AS dst, round(w, 6) AS w FROM ({_sym_t('looped')})", looped="SELECT src, dst, sum(w) AS w FROM (SELECT * FROM knn UNION ALL SELECT id, id, 1.0 FROM vec) GROUP BY 1, 2"),
    "norm_gcn": _with("knn", f"SELECT e.dst AS src, e.src AS dst, round({_p('coalesce(a.k, 0)')} * {_p('coalesce(b.k, 0)')}, 6) AS w FROM knn e LEFT JOIN {_IN.format(e='knn')} a ON a.id = e.src LEFT JOIN {_IN.format(e='knn')} b ON b.id = e.dst"),
    "norm_binary_sym": _with("und", f"SELECT src, dst, round(w, 6) AS w FROM ({_sym_t('looped')})", looped="SELECT * FROM und UNION ALL SELECT id, id, 1.0 FROM vec"),
    "norm_row": _with("ps", "SELECT src, round(sum(w / t), 6) AS total, round(max(w / t), 6) AS top, round(sum(1.0::DOUBLE / k), 6) AS walk FROM (SELECT src, w, sum(w) OVER (PARTITION BY src) AS t, count(*) OVER (PARTITION BY dst) AS k FROM ps) GROUP BY 1"),
    "norm_both": _with("knn", f"SELECT e.dst AS src, e.src AS dst, round(e.w * {_p('coalesce(a.d, 0)')} * {_p('coalesce(b.d, 0)')}, 6) AS w FROM knn e LEFT JOIN {_OUT.format(e='knn')} a ON a.id = e.src LEFT JOIN {_IN.format(e='knn')} b ON b.id = e.dst"),
    "norm_residual_pair": _with(
        "knn", f"SELECT a.src, a.dst, round(a.w, 6) AS w, round(b.w, 6) AS residual FROM ({_sym_t('raw')}) a LEFT JOIN (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM base WHERE src <> dst) b USING (src, dst)",
        base="SELECT src, dst, w FROM knn UNION ALL SELECT id, id, 1.0 FROM vec WHERE id % 3 = 0", raw="SELECT src, dst, sum(w) AS w FROM (SELECT * FROM base UNION ALL SELECT id, id, 1.0 FROM vec) GROUP BY 1, 2",
    ),
    "norm_difference": _with("knn", f"SELECT src, dst, round(w, 6) AS w FROM ({_sym_t('knn')})"),
    "spmm": _with("ps psn", _long("y", "f"), y=_sum2("src", "dst", "ps", "psn")),
    "spmm_transpose": _with("knn", _long("y", "f"), y=_sumw("dst", "src", "knn", "vec")),
    "propagate_2hop": _with("pb psn", _long("hops", "h0", "h1", "h2"), **_PROP),
    "propagate_no_loop": _with(
        "und", _long("hops", "h0", "h1", "h2"), dg="SELECT src AS id, sum(w) AS d FROM und GROUP BY 1",
        an="SELECT e.src, e.dst, e.w * pow(a.d, -0.5) * pow(b.d, -0.5) AS w FROM und e JOIN dg a ON a.id = e.src JOIN dg b ON b.id = e.dst", x1=_sumw("dst", "src", "an", "vec"), x2=_sumw("dst", "src", "an", "x1"),
        hops="SELECT a.id, a.f AS h0, b.f AS h1, c.f AS h2 FROM vec a JOIN x1 b USING (id) JOIN x2 c USING (id)",
    ),
    "laplacian_powers": _with("ps psn", _long("hops", "h0", "h1", "h2"), **_LAP),
    "beta_wavelet": _with("ps psn", _long("wv", "b0", "b1", "b2"), **_LAP, wv=_HOPB),
    **{f"neighbor_{how}": _with("ps psn", _long("y", "f"), y=q) for how, q in _NBR.items()},
    "gin_noparam": _with("ps psn", _long("y", "f"), x1=_NBR["mean"], x2=_NBR["mean"].replace("psn", "x1"), y="SELECT a.id, a.f || b.f || c.f AS f FROM psn a JOIN x1 b USING (id) JOIN x2 c USING (id)"),
    "ego_neighbor_residual": _with("pb psn", _long("y", "f"), **_PROP, y="SELECT id, [h1[1] - h0[1], h1[2] - h0[2], h2[1] - h0[1], h2[2] - h0[2]] AS f FROM hops"),
    "affinity_col": _with("knn", f"SELECT v.id, round(coalesce(s / d, 0), 6) AS m FROM vec v LEFT JOIN (SELECT e.src AS id, sum(e.w * list_inner_product(a.u, b.u)) AS s FROM {_ends('knn')} GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, sum(w) AS d FROM knn GROUP BY 1) USING (id)"),
    "affinity_row": _with("knn", f"SELECT v.id, round(coalesce(s / (d + 1e-9), 0), 6) AS m FROM vec v LEFT JOIN (SELECT e.src AS id, sum(e.w * list_inner_product(a.u, b.u)) AS s, sum(e.w) AS d FROM {_ends('knn')} GROUP BY 1) USING (id)"),
    "affinity_with_loops": _with(
        "und", "SELECT id, round(1 - (m - lo) / (hi - lo), 6) AS score FROM af, (SELECT min(m) AS lo, max(m) AS hi FROM af)", lo="SELECT * FROM und UNION ALL SELECT id, id, 1.0 FROM vec",
        af=f"SELECT e.src AS id, sum(e.w * list_inner_product(a.u, b.u)) / max(d) AS m FROM {_ends('lo')} JOIN (SELECT dst AS id, sum(w) AS d FROM lo GROUP BY 1) c ON c.id = e.src GROUP BY 1",
    ),
    "nonedge_reg": _with("und", "SELECT a.id, round(sum(CASE WHEN e.src IS NULL THEN list_inner_product(a.u, b.u) ELSE 0 END) / max(n - coalesce(r, 0)), 6) AS m FROM vec a CROSS JOIN vec b CROSS JOIN (SELECT count(*) AS n FROM vec) LEFT JOIN und e ON e.src = a.id AND e.dst = b.id LEFT JOIN (SELECT src AS id, sum(w) AS r FROM und GROUP BY 1) d ON d.id = a.id GROUP BY 1"),
    "neighbor_scores": _with(
        "knn", "SELECT id, round(l2, 6) AS l2, round(l1, 6) AS l1, round(cos, 6) AS cos, round(1 - (t - (SELECT min(t) FROM sc3)) / (SELECT max(t) - min(t) FROM sc3), 6) AS inverse FROM sc3",
        raw=f"SELECT e.src AS id, avg({_L2}) AS l2, avg({_L1}) AS l1, avg({_COS}) AS cos FROM {_ends('knn')} GROUP BY 1",
        sc2="SELECT id, " + ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-8) AS {c}" for c in ("l2", "l1", "cos")) + " FROM raw", sc3="SELECT *, l2 + l1 + cos AS t FROM sc2",
    ),
    "smoothness_order": _with("und", "SELECT j, round(smooth, 6) AS smooth, (row_number() OVER (ORDER BY round(smooth, 9), j) - 1)::INT AS place FROM sm", mm=_MM, sm=_SMOOTH),
    "smoothness_composite": _with("und", "SELECT j, round(0.5 * smooth + 0.5 * v, 6) AS score FROM sm JOIN (SELECT (j - 1)::INT AS j, var_pop(x) AS v FROM mm GROUP BY 1) USING (j)", mm=_MM, sm=_SMOOTH),
    "edge_distance": _with("knn", "SELECT src, dst, round(dist, 6) AS dist, round((SELECT avg(dist) FROM ed WHERE dist <> 0), 6) AS mean_dist FROM ed", ed=f"SELECT e.src, e.dst, {_L2} AS dist FROM {_ends('knn')}"),
    "lookup_edges": _with("knn", "SELECT p.src, p.dst, round(coalesce(k.w, 0), 6) AS w FROM (SELECT id AS src, (id * 7 + 3) % 50 AS dst FROM vec UNION SELECT src, dst FROM knn WHERE src % 10 = 0) p LEFT JOIN knn k USING (src, dst)"),
    "clustering_coeff": _with("und", "SELECT id, round(degree, 6) AS degree, round(clustering, 6) AS clustering FROM loc", **_TRI),
    "struct_fingerprint": _with(
        "und", "SELECT l.id, " + ", ".join(f"round(l.{c}, 6) AS {c}, round(coalesce(p.{c}, 0), 6) AS pooled_{c}" for c in ("degree", "clustering", "core")) + " FROM lc l LEFT JOIN (SELECT e.src AS id, avg(degree) AS degree, avg(clustering) AS clustering, avg(core) AS core FROM und e JOIN lc ON lc.id = e.dst GROUP BY 1) p USING (id)",
        **_TRI, **_cores("und", 30), lc="SELECT loc.*, coalesce(cn.core, 0) / (SELECT max(core) FROM cn)::DOUBLE AS core FROM loc LEFT JOIN cn USING (id)",
    ),
    "core_numbers": _with("und", "SELECT v.id, coalesce(core, 0)::BIGINT AS core FROM vec v LEFT JOIN cn USING (id)", **_cores("und", 30)),
    "core_numbers_supply": _with("ps psn", "SELECT core, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT v.id, coalesce(core, 0)::BIGINT AS core FROM psn v LEFT JOIN cn USING (id)) GROUP BY 1", pu="SELECT DISTINCT src, dst FROM ps WHERE src <> dst AND w <> 0", **_cores("pu", 30)),
    "pagerank_converged": _with("unw", "SELECT id, round(ln(p), 6) AS p, rounds FROM pr", **_ranks(60, "1e-6")),
    "triplet_sample": _with("knn", "SELECT anchor, positive, slot::INT AS slot, negative FROM tri", **_TRIPLETS),
    "kcore_fixed_k": _core(5, 40),
    "pagerank_fixed": _with("unw", "SELECT id, round(p, 6) AS p FROM p5", **_PAGE),
    "neighbor_diversity": _with("knn", "SELECT v.id, round(coalesce(var_pop(c), 0), 6) AS m FROM vec v LEFT JOIN pc USING (id) GROUP BY 1", **_DIV),
    "global_similarity": _with("knn", f"SELECT round(s, 6) AS similarity, n AS n_edges, CASE WHEN s > 0 THEN 4.0 ELSE 0.5 END::DOUBLE AS beta FROM (SELECT avg({_COS}) AS s, count(*) AS n FROM {_ends('knn')})"),
    "tpca_aggregate": _with("knn", "SELECT id, round(topology, 6) AS topology, round(drift, 6) AS drift, round(0.5 * drift + 0.5 * topology, 6) AS score FROM ts", **_TPCA),
    "ego_neighbor_diff": _with("knn", "SELECT id, round(-c, 6) AS diff, round(1 - (c - lo) / (hi - lo), 6) AS scaled FROM df, (SELECT min(c) AS lo, max(c) AS hi FROM df)", **_MEANDIFF),
    "zscore": _with("psn", _long("y", "f"), y=f"SELECT id, [(f[1] - m1) / s1, (f[2] - m2) / s2] AS f FROM psn, ({_MOM})"),
    "batch_norm": _with("psn", _long("y", "f"), y=f"SELECT id, [(f[1] - m1) / sqrt(s1 * s1 + 1e-5), (f[2] - m2) / sqrt(s2 * s2 + 1e-5)] AS f FROM psn, ({_MOM})"),
    "center": _with("psn", _long("y", "f"), y=f"SELECT id, [f[1] - m1, f[2] - m2] AS f FROM psn, ({_MOM})"),
    "minmax": _with("psn", _long("y", "f"), y=f"SELECT id, [(f[1] - a1) / (b1 - a1), (f[2] - a2) / (b2 - a2)] AS f FROM psn, ({_MOM})"),
    "row_normalize": _with("vec", _long("y", "f", "g"), y="SELECT id, list_transform(a, lambda x: x / list_sum(a)) AS f, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS g FROM (SELECT id, list_transform(f, lambda x: abs(x)) AS a FROM vec)"),
    "gram_matrix": _with("vec", "SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, round(sum(f[i] * f[j]), 6) AS v FROM vec, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) WHERE i <= j GROUP BY 1, 2"),
    "sign_rule": _with("vec", "SELECT v.id, 0::INT AS hop, (k.j - 1)::INT AS j, round(CASE WHEN t.s < 0 THEN -v.f[k.j] ELSE v.f[k.j] END, 6) AS v FROM vec v, (SELECT unnest(range(1, 65)) AS j) k JOIN (SELECT j, first(f[j] ORDER BY abs(f[j]) DESC, id) AS s FROM vec, (SELECT unnest(range(1, 65)) AS j) GROUP BY 1) t USING (j)"),
    "svd_gram_energy": _with("vec", "SELECT round(sum(list_inner_product(f, f)), 6) AS energy, count(*) AS n, 0.0::DOUBLE AS off_diagonal FROM vec"),
    "class_weight": _with("doc", "SELECT count(*) FILTER (y = 0) AS normal, count(*) FILTER (y = 1) AS anomaly, round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1)::DOUBLE, 6) AS weight FROM doc WHERE mark"),
    "prototypes": _with("ctr", "SELECT y AS id, 0::INT AS hop, (j - 1)::INT AS j, round(coalesce(c, 0), 6) AS v FROM ctr"),
    "prototype_softmax": _with("cc", f"SELECT id, round(1 / (1 + exp({_cos('f', 'c0')} - {_cos('f', 'c1')})), 6) AS score, round({_cos('f', 'c1')} - {_cos('f', 'c0')}, 6) AS log_odds FROM vec, cc"),
    "centroid_distance": _with("cc", f"SELECT id, round(1 / (1 + exp((b - a) / sqrt(a * a + b * b))), 6) AS score FROM (SELECT id, pow({_dist('f', 'c0')}, 2) AS a, pow({_dist('f', 'c1')}, 2) AS b FROM vec, cc)"),
    "support_attention": _with(
        "sup", f"SELECT v.id, round({_dist('v.f', 'a.m')}, 6) AS score FROM vec v JOIN at2 a USING (id)", at1="SELECT v.id, s.f, exp(list_inner_product(v.f, s.f) / 8) AS e FROM vec v, sup s WHERE s.y = 0",
        at2="SELECT id, [" + ", ".join(f"sum(e * f[{i}]) / sum(e)" for i in range(1, 65)) + "] AS m FROM at1 GROUP BY 1",
    ),
    "nearest_code": _with("vec", f"SELECT id, code, round(s, 6) AS sim FROM ({_NEAR.format(x='vec')})", **_CODES),
    "support_codes_fusion": _with(
        "sup sc", f"SELECT v.id, round(0.25 * ({_dist('v.f', 'm')} + {_dist('v.f', 'k')}) + 0.5 * a.score, 6) AS score FROM vec v, mm, mk, sraw a WHERE a.id = v.id", **_CODES, s0="SELECT * FROM sup WHERE y = 0",
        mm="SELECT [" + ", ".join(f"avg(f[{i}])" for i in range(1, 65)) + "] AS m FROM s0", mk="SELECT [" + ", ".join(f"avg(c[{i}])" for i in range(1, 65)) + f"] AS k FROM ({_NEAR.format(x='s0')})",
        araw=f"SELECT e.src AS id, sum(e.w * list_inner_product(a.u, b.u)) / max(d) AS m FROM {_ends('und')} JOIN (SELECT dst AS id, sum(w) AS d FROM und GROUP BY 1) c ON c.id = e.src GROUP BY 1",
        sraw="SELECT id, 1 - (m - (SELECT min(m) FROM araw)) / (SELECT max(m) - min(m) FROM araw) AS score FROM araw",
    ),
    "kde_js": _with(
        "vec", "SELECT round(sqrt(greatest(sum(CASE WHEN a.p > 0 THEN a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN b.p > 0 THEN b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END) / 2, 0)), 6) AS js FROM dn a JOIN dn b USING (g) WHERE a.y = 0 AND b.y = 1",
        dn="SELECT y, g, p / sum(p) OVER (PARTITION BY y) AS p FROM (SELECT y, g, sum(exp(-pow((-1.0 + 2.0 * g / 499 - list_sum(f) / 8) / 0.1, 2) / 2)) AS p FROM vec, (SELECT unnest(range(500)) AS g) GROUP BY 1, 2)",
    ),
    "dominant_row_error": _with("unw vec", "SELECT a.id, round(sqrt(sum(pow(list_inner_product(a.f, b.f) - coalesce(e.w, 0), 2))), 6) AS structure FROM vec a CROSS JOIN vec b LEFT JOIN unw e ON e.src = a.id AND e.dst = b.id GROUP BY 1"),
    "structure_bce": _with("unw vec", "SELECT round(avg(greatest(l, 0) + ln(1 + exp(-abs(l))) - w * l), 6) AS loss FROM (SELECT list_inner_product(a.f, b.f) AS l, coalesce(e.w, 0) AS w FROM vec a CROSS JOIN vec b LEFT JOIN unw e ON e.src = a.id AND e.dst = b.id)"),
    "link_loss": _with("knn", f"SELECT round(avg(l - s), 6) AS loss FROM (SELECT anchor, positive, max({_cos('a.f', 'p.f')} / 0.5) AS s, ln(sum(exp({_cos('a.f', 'n.f')} / 0.5))) AS l FROM tri JOIN vec a ON a.id = anchor JOIN vec p ON p.id = positive JOIN vec n ON n.id = negative GROUP BY 1, 2)", **_TRIPLETS),
    "margin_loss": _with("knn", f"SELECT round(avg(CASE WHEN a.y = 0 THEN 1 - list_inner_product(a.u, b.u) ELSE greatest(0, list_inner_product(a.u, b.u) - 0.2) END), 6) AS loss FROM {_ends('knn')}"),
    "weighted_ce": _with("doc", "SELECT round(sum(-c * CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) / sum(c), 6) AS loss FROM (SELECT y, 1 / (1 + exp(-(n_chars / 1000 - 2))) AS p, CASE WHEN y = 1 THEN (SELECT count(*) FILTER (y = 0) / count(*) FILTER (y = 1)::DOUBLE FROM doc WHERE mark) ELSE 1 END AS c FROM doc WHERE mark)"),
    "contrast_loss": _with("knn", "SELECT round(avg(l), 6) AS loss FROM (SELECT b, avg(-ln(greatest(p, 1e-8) / greatest(t, 1e-8))) AS l FROM (SELECT a.id // 1000 AS b, a.id, sum(CASE WHEN e.src IS NULL THEN 0 ELSE exp(list_inner_product(a.u, z.u)) END) AS p, sum(exp(list_inner_product(a.u, z.u))) AS t FROM vec a CROSS JOIN vec z LEFT JOIN knn e ON e.src = a.id AND e.dst = z.id GROUP BY 1, 2) GROUP BY 1)"),
    "difference_loss": _with("knn", "SELECT round(avg(CASE WHEN y = 0 THEN -c ELSE c END), 6) AS loss FROM df", **_MEANDIFF),
    "prune_bottom_edges": _with(
        "pb psn", _summed("SELECT * FROM fu WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = fu.src AND g.dst = fu.dst)"), fu="SELECT * FROM pb UNION ALL SELECT id, id, 1.0 FROM psn", an=_sym_t("fu"),
        lv="SELECT x.id, x.y - coalesce(g, 0) AS l FROM psn x LEFT JOIN (SELECT e.src AS id, sum(e.w * z.y) AS g FROM an e JOIN psn z ON z.id = e.dst GROUP BY 1) USING (id)",
        gone="SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (ORDER BY round(a.l * b.l, 12), e.src, e.dst) AS r FROM fu e JOIN lv a ON a.id = e.src JOIN lv b ON b.id = e.dst) WHERE r <= (SELECT floor(0.015 * count(*)) FROM fu) AND src <> dst",
    ),
    "support_holdout": _with("doc", f"SELECT id, y, CASE WHEN r <= 10 THEN 'support' ELSE 'query' END AS role FROM ({_rank(_POOL)})"),
    "support_per_class": _with("doc", _per_class(_POOL, 60)),
    "support_reserve": _with("doc", _per_class("rest", 60), rest="SELECT id, y FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5('43:' || id), id) AS q, count(*) OVER (PARTITION BY y) AS n FROM doc WHERE mark) WHERE n >= 2 AND NOT (n <= 60 AND q = 1)"),
    "support_normal_only": _with("doc", f"SELECT id, y, CASE WHEN y = 0 AND r <= 10 THEN 'context' ELSE 'query' END AS role FROM ({_rank(_POOL, by='y')})"),
    "random_context": _with("doc", f"SELECT id, y FROM ({_rank(_POOL)}) WHERE r <= 10"),
    "episode_sample": _with("doc", f"SELECT id, y, CASE WHEN r <= 10 THEN 'support' ELSE 'query' END AS role FROM ({_rank(_POOL, by='y')}) WHERE r <= 10 + CASE WHEN y = 0 THEN 50 ELSE 20 END"),
    "stratified_split": _with("doc", f"SELECT id, y, CASE WHEN r <= floor(0.3 * n) THEN 'train' WHEN r <= floor(0.4 * n) THEN 'valid' ELSE 'test' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY y) AS n FROM ({_rank(_POOL, by='y')}))"),
    "train_rate_sample": _with("doc", f"SELECT id FROM ({_rank('doc')}) WHERE r <= floor(0.3 * (SELECT count(*) FROM doc))"),
    "balanced_query": _with(
        "doc", "SELECT id, y, CASE WHEN y = 0 AND r <= 10 THEN 'context' ELSE 'query' END AS role FROM rk, mm WHERE r <= (CASE WHEN y = 0 THEN 10 ELSE 0 END) + m",
        rk=_rank("(SELECT id, y FROM doc WHERE mark AND y IN (0, 1))", by="y"), mm="SELECT greatest(0, least(20, count(*) FILTER (y = 0) - 10, count(*) FILTER (y = 1))) AS m FROM rk",
    ),
    "source_batches": _with(
        "", "SELECT t.step, t.graph, p.id, t.y, CASE WHEN t.y = 0 AND j <= 2 THEN 'context' ELSE 'query' END AS role FROM tk t JOIN pool p ON p.graph = t.graph AND p.y = t.y AND p.r = t.r",
        pool=f"SELECT *, row_number() OVER (PARTITION BY graph, y ORDER BY {_KEY}, id) AS r FROM (SELECT d.doc_id AS id, d.source AS graph, l.y FROM documents d JOIN (SELECT doc_id, max(toxic) AS y FROM labels GROUP BY 1) l USING (doc_id) WHERE l.y IN (0, 1))",
        sizes="SELECT *, row_number() OVER (ORDER BY graph) - 1 AS g FROM (SELECT graph, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1 FROM pool GROUP BY 1) WHERE n0 > 2 AND n1 > 0",
        st=f"SELECT step, floor({_u('step')} * (SELECT count(*) FROM sizes))::INT AS g FROM (SELECT unnest(range(40)) AS step)",
        ty="SELECT st.step, s.graph, y, CASE WHEN y = 0 THEN n0 ELSE n1 END AS n, least(3, n0 - 2, n1) + CASE WHEN y = 0 THEN 2 ELSE 0 END AS most FROM st JOIN sizes s USING (g), (VALUES (0), (1)) c(y)",
        tk=f"SELECT step, graph, y, j, (floor({_u('step', 'y', seed=43)} * n)::BIGINT + j - 1) % n + 1 AS r FROM (SELECT *, unnest(range(1, most + 1)) AS j FROM ty)",
    ),
    "query_antijoin": _with("doc", f"SELECT count(*) AS n, sum(id)::BIGINT AS ids, 0::BIGINT AS overlap FROM ({_rank(_POOL)}) WHERE r > 10"),
    "edge_dropout": _with("psl", _summed(f"SELECT * FROM psl WHERE src = dst OR {_u('src', 'dst')} >= 0.2")),
    "tam_truncate": _with("und", "SELECT src, dst FROM kept UNION SELECT dst, src FROM kept", **_TRUNC),
    "tam_scores": _with("und", "SELECT id, round(1 - (m - lo) / (hi - lo), 6) AS score FROM mn, (SELECT min(m) AS lo, max(m) AS hi FROM mn)", **_tam(2)),
    "dominant_scores": _with(
        "und", f"SELECT a.id, round(0.8 * a.attribute + 0.2 * s.structure, 6) AS score FROM (SELECT v.id, {_dist('v.f', 'b.f')} AS attribute FROM vec v JOIN bk b USING (id)) a JOIN st s USING (id)",
        lo="SELECT * FROM und UNION ALL SELECT id, id, 1.0 FROM vec", de="SELECT src AS id, sum(w) AS d FROM lo GROUP BY 1", na="SELECT e.dst AS src, e.src AS dst, e.w / sqrt(a.d * b.d) AS w FROM lo e JOIN de a ON a.id = e.src JOIN de b ON b.id = e.dst",
        z=_sumw("src", "dst", "na", "vec"), bk=_sumw("src", "dst", "na", "z"),
        st="SELECT a.id, sqrt(sum(pow(list_inner_product(a.f, b.f) - coalesce(e.w, 0), 2))) AS structure FROM z a CROSS JOIN z b LEFT JOIN lo e ON e.src = a.id AND e.dst = b.id GROUP BY 1",
    ),
    "rwr_sample": _with("knn", f"SELECT d.id, d.slot::INT AS slot, coalesce(e.dst, d.id) AS node FROM (SELECT id, slot, CASE WHEN slot > 0 AND k > 0 THEN floor({_u('id', 'slot')} * k)::INT + 1 ELSE 0 END AS r FROM (SELECT v.id, coalesce(k, 0) AS k, unnest(range(4)) AS slot FROM vec v LEFT JOIN (SELECT src AS id, count(*) AS k FROM knn GROUP BY 1) USING (id))) d LEFT JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM knn) e ON e.src = d.id AND e.r = d.r"),
    "nonneighbor_sample": _with(
        "und", "SELECT id, slot::INT AS slot, cand FROM (SELECT w.id, c.cand, row_number() OVER (PARTITION BY w.id ORDER BY w.i) AS slot FROM walk w JOIN circle c ON c.place = w.place LEFT JOIN und e ON e.src = w.id AND e.dst = c.cand WHERE e.src IS NULL AND c.cand <> w.id) WHERE slot <= 3",
        circle=f"SELECT id AS cand, row_number() OVER (ORDER BY {_KEY}, id) - 1 AS place FROM vec",
        walk=f"SELECT id, i, (floor({_u('id', seed=43)} * (SELECT count(*) FROM vec))::BIGINT + i) % (SELECT count(*) FROM vec) AS place FROM vec, (SELECT unnest(range((SELECT count(*) FROM vec))) AS i)",
    ),
    "pair_sample": f"SELECT pair, floor({_u('pair')} * n)::BIGINT AS a, floor({_u('pair', seed=43)} * n)::BIGINT AS b FROM (SELECT unnest(range(1000)) AS pair), (SELECT count(*) AS n FROM embeddings)",
    "column_sample": f"SELECT slot, floor({_u('slot')} * 64)::BIGINT AS j, 4.0::DOUBLE AS scale FROM (SELECT unnest(range(16)) AS slot)",
    "l_hop_closure": _with("tree", "SELECT id FROM s UNION SELECT dst FROM tree WHERE src IN (SELECT id FROM s) UNION SELECT b.dst FROM tree a JOIN tree b ON b.src = a.dst WHERE a.src IN (SELECT id FROM s)", s="SELECT unnest([1000000, 2000003])::BIGINT AS id"),
    "closure_induced": _with("knn", "SELECT src, dst, round(w, 6) AS w FROM knn WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)", s="SELECT id FROM vec WHERE id < 3", ids="SELECT id FROM s UNION SELECT dst FROM knn WHERE src IN (SELECT id FROM s) UNION SELECT b.dst FROM knn a JOIN knn b ON b.src = a.dst WHERE a.src IN (SELECT id FROM s)"),
    "group_lag_negative": _with("vec", "SELECT id, coalesce(lag(id) OVER (PARTITION BY id // 64 ORDER BY id), nth_value(id, CASE WHEN n > 1 THEN n - 1 ELSE 1 END) OVER (PARTITION BY id // 64 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS negative FROM (SELECT id, count(*) OVER (PARTITION BY id // 64) AS n FROM vec)"),
    "block_diag_union": _with("knn tree", "SELECT src, dst, round(w, 6) AS w FROM knn UNION ALL SELECT src + 10000000, dst + 10000000, 1.0 FROM tree"),
    "seed_mean_std": _with("det", "SELECT * FROM det"),
    "result_upsert": _with("det", "SELECT * FROM det WHERE target NOT IN ('t1', 't2') UNION ALL SELECT method, src_type, tgt_type, target, mode, 1.0, auroc_std, 1 FROM det WHERE target IN ('t1', 't2')"),
    "mode_delta": _with("delta", "SELECT * FROM delta"),
    "pair_macro": _with("delta", "SELECT method, round(avg(single_auroc), 6) AS single, round(avg(multi_auroc), 6) AS multi, count(*) AS n FROM delta WHERE delta IS NOT NULL GROUP BY 1"),
    "result_rollup": _with("res", "SELECT method, target, round(avg(auroc), 6) AS auroc, count(*) AS n FROM res GROUP BY ROLLUP (method, target)"),
    "label_counts": _with("doc", "SELECT count(*) FILTER (y = 0) AS normal, count(*) FILTER (y = 1) AS anomaly FROM doc WHERE mark"),
    "shot_budget": _with(
        "doc", "SELECT *, CASE WHEN query_normal < 1 THEN 'no normal left' WHEN query_anomaly < 1 THEN 'no anomaly left' ELSE 'ok' END AS reason FROM b",
        c="SELECT count(*) FILTER (y = 0) AS normal, count(*) FILTER (y = 1) AS anomaly FROM doc WHERE mark",
        b="SELECT normal, anomaly, shot, policy, shot AS support_normal, sa AS support_anomaly, normal - shot AS query_normal, anomaly - sa AS query_anomaly FROM (SELECT *, (CASE WHEN policy = 'per_class' THEN shot ELSE 0 END)::INT AS sa FROM c, (SELECT unnest([1, 3, 5, 10, 20, 50])::INT AS shot), (SELECT unnest(['per_class', 'normal_only']) AS policy))",
    ),
    "random_budget": _with("doc", "SELECT shot, seed, count(*) FILTER (r <= shot AND y = 0) AS support_normal, count(*) FILTER (r <= shot AND y = 1) AS support_anomaly, count(*) FILTER (r > shot AND y = 0) AS query_normal, count(*) FILTER (r > shot AND y = 1) AS query_anomaly FROM (SELECT y, s.seed::INT AS seed, row_number() OVER (PARTITION BY s.seed ORDER BY md5(s.seed || ':' || id), id) AS r FROM doc, (VALUES (0), (1)) s(seed) WHERE mark), (SELECT unnest([1, 5, 20])::INT AS shot) GROUP BY 1, 2"),
    "shot_detail": _with("sweep", "SELECT context_id, shot, target, count(*) FILTER (status = 'ok') AS n, 3::INT AS expected_n, count(*) FILTER (status = 'ok') = 3 AS complete, CASE WHEN count(*) FILTER (status = 'ok') = 3 THEN 'ok' WHEN count(*) FILTER (status = 'skipped') > 0 AND count(*) FILTER (status = 'ok') = 0 THEN 'skipped' ELSE 'incomplete' END AS status FROM sweep GROUP BY 1, 2, 3"),
    "macro_cohort": _with(
        "sweep", "SELECT context_id, shot, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, max(k) AS targets FROM ps1 GROUP BY 1, 2", co="SELECT context_id, target FROM sweep WHERE status = 'ok' GROUP BY 1, 2 HAVING count(*) = 6",
        ps1="SELECT context_id, shot, seed, avg(auroc) AS m, count(*) AS k FROM sweep JOIN co USING (context_id, target) WHERE status = 'ok' GROUP BY 1, 2, 3",
    ),
    "fingerprint_md5": _with("knn", "SELECT count(*) AS n, sum(('0x' || substr(md5(src || ':' || dst), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM knn"),
    "csv_trio_files": "WITH m AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_size, p_retailprice FROM part) SELECT a.id AS src, b.id::BIGINT AS dsts, round(a.p_retailprice::DOUBLE, 6) AS price, a.p_size::BIGINT AS size, CAST(a.p_size < 10 AS INT) AS y, a.p_size < 40 AS mark FROM m a JOIN m b ON b.k = a.k % 100 + 1",
    "stored_features": _with("vec", _long("y", "f"), y="SELECT id, list_transform(a, lambda x: x / list_sum(a)) AS f FROM (SELECT id, list_transform(f, lambda x: abs(x)) AS a FROM vec)"),
    "csv_ids_map": "WITH m AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_size FROM part) SELECT a.id AS src, b.id::BIGINT AS dsts, CAST(a.p_size < 10 AS INT) AS y, a.p_size < 40 AS mark FROM m a JOIN m b ON b.k = a.k % 100 + 1",
    "marks_union": "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 3 = 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0)",
    "event_graph": "SELECT user_id AS src, event_type AS dst, count(*) AS w, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "hop_attention": _with(
        "und", _long("y", "f"), dg="SELECT src AS id, sum(w) AS d FROM und GROUP BY 1",
        an="SELECT e.src, e.dst, e.w * pow(a.d, -0.5) * pow(b.d, -0.5) AS w FROM und e JOIN dg a ON a.id = e.src JOIN dg b ON b.id = e.dst", x1=_sumw("dst", "src", "an", "vec"), x2=_sumw("dst", "src", "an", "x1"),
        rs="SELECT a.id, a.f AS h, list_transform(list_zip(b.f, a.f), lambda z: z[1] - z[2]) AS r1, list_transform(list_zip(c.f, a.f), lambda z: z[1] - z[2]) AS r2 FROM vec a JOIN x1 b USING (id) JOIN x2 c USING (id)",
        ex="SELECT id, r1, r2, exp(CASE WHEN a > 0 THEN a ELSE 0.2 * a END) AS e1, exp(CASE WHEN b > 0 THEN b ELSE 0.2 * b END) AS e2 FROM (SELECT *, list_inner_product(h, r1) / 8 AS a, list_inner_product(h, r2) / 8 AS b FROM rs)",
        y="SELECT id, list_transform(list_zip(r1, r2), lambda z: (z[1] * e1 + z[2] * e2) / (e1 + e2)) AS f FROM ex",
    ),
    "query_affinity_fusion": _with(
        "knn", "SELECT id, round(0.9 * q + 0.1 * (1 - (t - (SELECT min(t) FROM sc3)) / (SELECT max(t) - min(t) FROM sc3)), 6) AS score FROM sc3 JOIN (SELECT id, list_sum(list_transform(f, lambda x: abs(x))) / 64 AS q FROM vec) USING (id)",
        raw=f"SELECT e.src AS id, avg({_L2}) AS l2, avg({_L1}) AS l1, avg({_COS}) AS cos FROM {_ends('knn')} GROUP BY 1",
        sc2="SELECT id, " + ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-8) AS {c}" for c in ("l2", "l1", "cos")) + " FROM raw", sc3="SELECT id, l2 + l1 + cos AS t FROM sc2",
    ),
    "context_contrast": _with(
        "knn vec", "SELECT x.id, round(avg(1 / (1 + exp(-list_inner_product(x.f, b.c))) - 1 / (1 + exp(-list_inner_product(x.f, a.c)))), 6) AS score FROM vec x JOIN ctx a ON a.id = x.id JOIN ng ON ng.id = x.id JOIN ctx b ON b.id = ng.negative AND b.seed = a.seed GROUP BY 1",
        rk="SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r, count(*) OVER (PARTITION BY src) AS k FROM knn",
        dr=f"SELECT n.seed, e.src AS id, e.dst AS node FROM (SELECT DISTINCT src, k, s.seed FROM rk, (SELECT unnest(range(256)) AS seed) s) n, (SELECT unnest(range(1, 4)) AS slot) t JOIN rk e ON e.src = n.src AND e.r = floor({_U.format(k="n.seed || ':' || n.src || ':' || t.slot")} * n.k)::INT + 1",
        ctx="SELECT seed, dr.id, [" + ", ".join(f"avg(v.f[{i}])" for i in range(1, 65)) + "] AS c FROM dr JOIN vec v ON v.id = dr.node GROUP BY 1, 2",
        ng="SELECT id, coalesce(lag(id) OVER (PARTITION BY id // 64 ORDER BY id), nth_value(id, CASE WHEN n > 1 THEN n - 1 ELSE 1 END) OVER (PARTITION BY id // 64 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS negative FROM (SELECT id, count(*) OVER (PARTITION BY id // 64) AS n FROM vec)",
    ),
    "alignment_loss": _with(
        "knn", "SELECT round((a + b + c + d) / 2, 6) AS loss FROM (SELECT avg(zi - s) FILTER (i = j) AS a, avg(zj - s) FILTER (i = j) AS b FROM zz), (SELECT avg(v) AS c FROM (SELECT i, sum(w * (zi - s)) / sum(w) AS v FROM zz JOIN knn ON src = i AND dst = j GROUP BY 1)), (SELECT avg(v) AS d FROM (SELECT j, sum(w * (zj - s)) / sum(w) AS v FROM zz JOIN knn ON src = i AND dst = j GROUP BY 1))",
        pr=f"SELECT a.id AS i, b.id AS j, {_cos('a.f[1:32]', 'b.f[33:64]')} AS s FROM vec a CROSS JOIN vec b", zz="SELECT *, ln(sum(exp(s)) OVER (PARTITION BY i)) AS zi, ln(sum(exp(s)) OVER (PARTITION BY j)) AS zj FROM pr",
    ),
    "prompt_entropy": _with("vec", "SELECT round(avg(h), 6) AS entropy FROM (SELECT id, sum(-p * ln(p)) AS h FROM (SELECT id, abs(f[j]) / list_sum(list_transform(f, lambda x: abs(x))) AS p FROM vec, (SELECT unnest(range(1, 65)) AS j)) GROUP BY 1)"),
    "pca_energy": _with("vec", "SELECT round(sum(v), 6) AS energy, max(n) AS n, 0.0::DOUBLE AS off_diagonal FROM (SELECT j, var_pop(f[j]) * count(*) AS v, count(*) AS n FROM vec, (SELECT unnest(range(1, 65)) AS j) GROUP BY 1)"),
}
