"""The queries of ``partita.queries`` in SQL, written independently of the operators."""

from __future__ import annotations

from . import queries as Q

X = """x AS MATERIALIZED (
  SELECT o_custkey AS row_id, l_partkey AS col_id, CAST(SUM(l_quantity) AS DOUBLE) AS val
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING SUM(l_quantity) <> 0),
dims AS MATERIALIZED (SELECT (SELECT COUNT(*) FROM customer) AS n, (SELECT COUNT(*) FROM part) AS f),
q AS MATERIALIZED (SELECT row_id AS query_id, col_id, val FROM x WHERE row_id % 97 = 0),
qid AS MATERIALIZED (SELECT DISTINCT query_id FROM q)"""


def uniform(a: str, b: str, seed: int = 0) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}|' || CAST({a} AS BIGINT) || '|' || CAST({b} AS BIGINT)), 1, 13) AS BIGINT) + 1 AS DOUBLE) / 4503599627370496.0::DOUBLE)"


def ctes(k: int = Q.K, iterations: int = 0, p: str = "", x: str = "x", rows: str = "SELECT c_custkey AS row_id FROM customer") -> str:
    """Initial factors and updates: {p}w0, {p}h0, {p}w1, {p}h1, ..."""
    scale = f"(SELECT sqrt(greatest((SELECT SUM(val) FROM {x}) / greatest(1, (SELECT COUNT(*) FROM ({rows})) * f), 1e-12) / {k}) FROM dims)"
    out = [
        f"{p}w0 AS MATERIALIZED (SELECT row_id, comp, {uniform('row_id', 'comp')} * (2 * {scale}) AS val FROM ({rows}) r, (SELECT unnest(range({k})) AS comp) c)",
        f"{p}h0 AS MATERIALIZED (SELECT comp, p_partkey AS col_id, {uniform('p_partkey', 'comp', 1)} * (2 * {scale}) AS val FROM part, (SELECT unnest(range({k})) AS comp) c)",
    ]
    for i in range(iterations):
        w, h, w1, h1 = f"{p}w{i}", f"{p}h{i}", f"{p}w{i + 1}", f"{p}h{i + 1}"
        out += [
            f"{w1} AS MATERIALIZED ({mu_w(x, w, h)})",
            f"{h1} AS MATERIALIZED ({mu_h(x, w1, h)})",
        ]
    return ",\n".join(out)


def mu_w(x: str, w: str, h: str) -> str:
    return f"""SELECT w.row_id, w.comp, greatest(w.val * coalesce(t.val, 0) / greatest(coalesce(l.val, 0), 1e-10), 0) AS val
  FROM {w} w
  LEFT JOIN (SELECT row_id, comp, SUM(a.val * b.val) AS val FROM {x} a JOIN {h} b USING (col_id) GROUP BY 1, 2) t USING (row_id, comp)
  LEFT JOIN (SELECT c.row_id, g.b AS comp, SUM(c.val * g.val) AS val FROM {w} c JOIN
    (SELECT m.comp AS a, o.comp AS b, SUM(m.val * o.val) AS val FROM {h} m JOIN {h} o USING (col_id) GROUP BY 1, 2) g ON g.a = c.comp GROUP BY 1, 2) l USING (row_id, comp)
  WHERE w.val * coalesce(t.val, 0) > 0"""


def mu_h(x: str, w: str, h: str) -> str:
    return f"""SELECT h.comp, h.col_id, greatest(h.val * coalesce(t.val, 0) / greatest(coalesce(l.val, 0), 1e-10), 0) AS val
  FROM {h} h
  LEFT JOIN (SELECT col_id, comp, SUM(a.val * b.val) AS val FROM {x} a JOIN {w} b USING (row_id) GROUP BY 1, 2) t USING (col_id, comp)
  LEFT JOIN (SELECT c.col_id, g.b AS comp, SUM(c.val * g.val) AS val FROM {h} c JOIN
    (SELECT m.comp AS a, o.comp AS b, SUM(m.val * o.val) AS val FROM {w} m JOIN {w} o USING (row_id) GROUP BY 1, 2) g ON g.a = c.comp GROUP BY 1, 2) l USING (col_id, comp)
  WHERE h.val * coalesce(t.val, 0) > 0"""


def cap_of(k: int, overlap: float = Q.OVERLAP) -> str:
    return f"(SELECT greatest(1, CAST(ceil(n / {k} * {overlap}) AS BIGINT)) FROM dims)"


def heap(scores: str, cap: str, p: str = "") -> str:
    """What a bounded heap fed in id order keeps, as {p}lists; see the fixtures for its tie rule."""
    return f"""{p}kept AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY comp ORDER BY affinity DESC) AS r FROM {scores} WHERE affinity > 0) WHERE r <= {cap}),
{p}cut AS (SELECT comp, MIN(affinity) AS t FROM {p}kept GROUP BY 1),
{p}above AS (SELECT comp, SUM(CASE WHEN affinity > t THEN 1 ELSE 0 END) AS a FROM {p}kept JOIN {p}cut USING (comp) GROUP BY 1),
{p}arrived AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY doc_id) AS arrival FROM {p}kept),
{p}tied AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY doc_id DESC) AS from_last FROM {p}arrived JOIN {p}cut USING (comp) WHERE affinity = t AND arrival <= {cap}),
{p}lists AS MATERIALIZED (SELECT comp, CAST(row_number() OVER (PARTITION BY comp ORDER BY affinity DESC, doc_id DESC) - 1 AS INTEGER) AS pos, doc_id, affinity FROM (
  SELECT comp, doc_id, affinity FROM {p}kept JOIN {p}cut USING (comp) WHERE affinity > t
  UNION ALL SELECT comp, doc_id, affinity FROM {p}tied JOIN {p}above USING (comp) WHERE from_last <= {cap} - a))"""


def index(k: int = Q.K, iterations: int = Q.ITERATIONS, p: str = "", x: str = "x", rows: str = "SELECT c_custkey AS row_id FROM customer") -> str:
    """Factors, {p}lists and the ranked components {p}ranked."""
    h = f"{p}h{iterations}"
    return f"""{ctes(k, iterations, p, x, rows)},
{p}scores AS (SELECT comp, row_id AS doc_id, SUM(a.val * b.val) AS affinity FROM x a JOIN {h} b USING (col_id) GROUP BY 1, 2),
{heap(f"{p}scores", cap_of(k), p)},
{p}projected AS (SELECT query_id, comp, SUM(a.val * b.val) AS q_score FROM q a JOIN {h} b USING (col_id) GROUP BY 1, 2),
{p}ranked AS MATERIALIZED (SELECT query_id, CAST(comp AS INTEGER) AS comp, q_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY q_score DESC, comp) AS INTEGER) AS rank FROM (
  SELECT i.query_id, c.comp, coalesce(p.q_score, 0.0) AS q_score FROM qid i CROSS JOIN (SELECT unnest(range({k})) AS comp) c LEFT JOIN {p}projected p ON p.query_id = i.query_id AND p.comp = c.comp))"""


TRUTH = f"""dots AS MATERIALIZED (SELECT q.query_id, x.row_id AS doc_id, SUM(q.val * x.val) AS score FROM q JOIN x USING (col_id) GROUP BY 1, 2),
truth AS MATERIALIZED (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM dots) WHERE rank <= {Q.TOP})"""


def naive(params, name: str = "found", p: str = "", k: int = Q.K, top: int = Q.TOP) -> str:
    depth = f"greatest(1, least(CAST(floor({cap_of(k)} * {params.list_factor} + 0.5) AS BIGINT), {cap_of(k)}))"
    return f"""{name}_cand AS MATERIALIZED (SELECT DISTINCT r.query_id, l.doc_id FROM {p}ranked r JOIN {p}lists l USING (comp) WHERE r.rank <= {params.nprobe} AND l.pos < {depth}),
{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM (
  SELECT c.query_id, c.doc_id, coalesce(d.score, 0.0) AS score FROM {name}_cand c LEFT JOIN dots d USING (query_id, doc_id))) WHERE rank <= {top})"""


def adaptive(params, top: int = Q.TOP, p: str = "") -> str:
    """A recursive walk: one visited entry of every query per step."""
    return f"""{p}bests AS (SELECT query_id, MAX(q_score) AS best FROM ranked GROUP BY 1),
{p}seq AS MATERIALIZED (SELECT r.query_id, r.rank AS lst, l.doc_id, coalesce(d.score, 0.0) AS score, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank, l.pos) AS i
  FROM ranked r JOIN {p}bests USING (query_id) JOIN lists l USING (comp) LEFT JOIN dots d ON d.query_id = r.query_id AND d.doc_id = l.doc_id
  WHERE r.q_score > 0 AND r.q_score >= best * {params.drop_ratio}),
{p}walk AS (
  SELECT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s DOUBLE, o BIGINT, d BIGINT)[]) AS heap, CAST([] AS BIGINT[]) AS seen, CAST(-1 AS INTEGER) AS lst, CAST(0 AS INTEGER) AS misses
  FROM (SELECT DISTINCT query_id FROM {p}seq)
  UNION ALL
  SELECT query_id, i,
    CASE WHEN enters THEN list_slice(list_sort(list_append(heap, {{'s': -score, 'o': CAST(len(seen) + 1 AS BIGINT), 'd': doc_id}})), 1, {top}) ELSE heap END,
    CASE WHEN skipped THEN seen ELSE list_append(seen, doc_id) END, lst,
    CASE WHEN skipped THEN m WHEN enters THEN CASE WHEN {params.max_misses} <= 0 THEN -1 ELSE 0 END WHEN m + 1 >= {params.max_misses} THEN -1 ELSE m + 1 END
  FROM (SELECT *, NOT skipped AND (len(heap) < {top} OR score > -heap[len(heap)].s) AS enters FROM (
    SELECT *, m < 0 OR list_contains(seen, doc_id) AS skipped FROM (
      SELECT w.query_id, s.i, w.heap, w.seen, s.lst, s.doc_id, s.score, CASE WHEN s.lst <> w.lst THEN 0 ELSE w.misses END AS m
      FROM {p}walk w JOIN {p}seq s ON s.query_id = w.query_id AND s.i = w.i + 1)))),
{p}ended AS (SELECT query_id, arg_max(heap, i) AS heap, arg_max(seen, i) AS seen FROM {p}walk GROUP BY 1)"""


def hals(target: str, factor: str, gram: str, ids: str, k: int, sweeps: int, key: str) -> str:
    """Cyclic coordinate steps for all rows at once, one component of every row per recursion."""
    return f"""g AS MATERIALIZED (SELECT a, list(val ORDER BY b) AS g FROM ({gram}) GROUP BY 1),
vec AS MATERIALIZED (SELECT i.{key}, list(coalesce(t.val, 0.0) ORDER BY j.comp) AS c, list(coalesce(f.val, 0.0) ORDER BY j.comp) AS w
  FROM ({ids}) i CROSS JOIN (SELECT unnest(range({k})) AS comp) j LEFT JOIN ({target}) t ON t.{key} = i.{key} AND t.comp = j.comp
  LEFT JOIN {factor} f ON f.{key} = i.{key} AND f.comp = j.comp GROUP BY 1),
steps AS (
  SELECT 0 AS s, {key}, c, w FROM vec
  UNION ALL
  SELECT s + 1, {key}, c, list_concat(list_concat(list_slice(w, 1, s % {k}), [greatest(0.0, (c[s % {k} + 1] - list_inner_product(g.g, w) + g.g[s % {k} + 1] * w[s % {k} + 1]) / (g.g[s % {k} + 1] + 1e-10))]), list_slice(w, s % {k} + 2, {k}))
  FROM steps JOIN g ON g.a = s % {k} WHERE s < {k * sweeps}),
done AS (SELECT {key}, unnest(range({k})) AS comp, unnest(w) AS val FROM steps WHERE s = {k * sweeps})"""


def q(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{X},\n" + ",\n".join(p for p in parts if p) + ("\n" if any(parts) else "") + select


def _matrix(select: str) -> str:
    return f"WITH {X}\n{select}"


def recall(name: str = "found", out: str = "recall", ats: tuple = Q.ATS) -> str:
    return f"""{out} AS (SELECT i.query_id, k.recall_at, CASE WHEN MAX(z.size) IS NULL THEN 0.0 ELSE COUNT(f.doc_id) / CAST(least(k.recall_at, MAX(z.size)) AS DOUBLE) END AS recall
  FROM qid i CROSS JOIN (SELECT unnest([{", ".join(map(str, ats))}]) AS recall_at) k
  LEFT JOIN (SELECT query_id, COUNT(DISTINCT doc_id) AS size FROM truth GROUP BY 1) z ON z.query_id = i.query_id
  LEFT JOIN (SELECT * FROM {name} WHERE EXISTS (SELECT 1 FROM truth t WHERE t.query_id = {name}.query_id AND t.doc_id = {name}.doc_id)) f ON f.query_id = i.query_id AND f.rank <= k.recall_at
  GROUP BY 1, 2)"""


def runs(p: str = "", k: int = Q.K) -> list[str]:
    """The sweep's searches, recalls and {p}runs."""
    parts, union = [], []
    for seq, params in enumerate(Q.SWEEP):
        name = f"{p}found{seq}"
        parts += [naive(params, name, p, k), recall(name, f"{p}recall{seq}")]
        union.append(
            f"SELECT '{params.label()}' AS config, CAST({seq} AS INTEGER) AS seq, CAST(recall_at AS INTEGER) AS recall_at, round(AVG(recall), 6) AS mean_recall, "
            f"round((SELECT COUNT(*) FROM {name}_cand) / (SELECT COUNT(*) FROM qid), 6) AS cost FROM {p}recall{seq} GROUP BY recall_at"
        )
    return [*parts, f"{p}runs AS MATERIALIZED (" + "\nUNION ALL ".join(union) + ")"]


def optimal(targets: tuple, p: str = "", where: str = "TRUE") -> str:
    return f"""(SELECT recall_at, target, b.config AS config, b.mean_recall AS mean_recall, b.cost AS cost FROM (
  SELECT w.recall_at, w.target, arg_min({{'config': r.config, 'mean_recall': r.mean_recall, 'cost': r.cost}}, {{'cost': r.cost, 'seq': r.seq}}) FILTER (WHERE r.config IS NOT NULL) AS b
  FROM (SELECT DISTINCT recall_at, target FROM (SELECT recall_at FROM {p}runs WHERE {where}) CROSS JOIN (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in targets)}]) AS target)) w
  LEFT JOIN {p}runs r ON r.recall_at = w.recall_at AND r.mean_recall >= w.target GROUP BY 1, 2))"""


COVER = f"""hits AS MATERIALIZED (SELECT t.query_id, t.doc_id, MIN({{'list_rank': r.rank, 'pos': l.pos, 'size': z.size}}) AS f
  FROM truth t JOIN lists l USING (doc_id) JOIN ranked r ON r.query_id = t.query_id AND r.comp = l.comp AND r.rank <= {Q.K}
  JOIN (SELECT comp, COUNT(*) AS size FROM lists GROUP BY 1) z ON z.comp = l.comp GROUP BY 1, 2),
hit AS MATERIALIZED (SELECT f.list_rank AS list_rank, f.pos / CAST(f.size AS DOUBLE) AS rel_pos FROM hits)"""

N_QUERIES = "(SELECT COUNT(*) FROM qid)"
SAMPLE = "(SELECT row_id FROM (SELECT DISTINCT row_id FROM x) ORDER BY {u}, row_id LIMIT {size})"
FACTORS = "SELECT 'w' AS factor, row_id AS id, CAST(comp AS INTEGER) AS comp, round(val, 6) + 0.0 AS val FROM {w} UNION ALL SELECT 'h', col_id, CAST(comp AS INTEGER), round(val, 6) + 0.0 FROM {h}"
XHT = "SELECT row_id, comp, SUM(a.val * b.val) AS val FROM x a JOIN h0 b USING (col_id) GROUP BY 1, 2"
XTW = "SELECT comp, col_id, SUM(a.val * b.val) AS val FROM x a JOIN w0 b USING (row_id) GROUP BY 1, 2"
GRAM_H = "SELECT m.comp AS a, o.comp AS b, SUM(m.val * o.val) AS val FROM h0 m JOIN h0 o USING (col_id) GROUP BY 1, 2"
GRAM_W = "SELECT m.comp AS a, o.comp AS b, SUM(m.val * o.val) AS val FROM w0 m JOIN w0 o USING (row_id) GROUP BY 1, 2"


def _errors() -> str:
    parts = []
    for i in (1, 2, 3):
        parts.append(f"""SELECT {i} AS iter, sqrt(greatest(0, (SELECT SUM(val * val) FROM x) - 2 * (SELECT SUM(a.val * w.val * h.val) FROM x a JOIN w{i} w USING (row_id) JOIN h{i} h ON h.col_id = a.col_id AND h.comp = w.comp)
  + (SELECT SUM(g.val * e.val) FROM (SELECT m.comp AS a, o.comp AS b, SUM(m.val * o.val) AS val FROM w{i} m JOIN w{i} o USING (row_id) GROUP BY 1, 2) g
     JOIN (SELECT m.comp AS a, o.comp AS b, SUM(m.val * o.val) AS val FROM h{i} m JOIN h{i} o USING (col_id) GROUP BY 1, 2) e USING (a, b)))) AS err""")
    return "errs AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


def _sampling() -> str:
    parts, union = [], []
    for size in (60, 120):
        p = f"s{size}_"
        chosen = SAMPLE.format(u=uniform("row_id", "0"), size=size)
        parts += [
            f"{p}ids AS MATERIALIZED {chosen}",
            f"{p}x AS MATERIALIZED (SELECT * FROM x WHERE row_id IN (SELECT row_id FROM {p}ids))",
            index(Q.K, 1, p, f"{p}x", f"SELECT row_id FROM {p}ids"),
            naive(Q.NAIVE, f"{p}found", p),
            recall(f"{p}found", f"{p}recall"),
        ]
        union.append(f"SELECT CAST({size} AS INTEGER) AS sample_size, CAST(recall_at AS INTEGER) AS recall_at, round(AVG(recall), 6) AS mean_recall FROM {p}recall GROUP BY recall_at")
    return q(TRUTH, *parts, select="\nUNION ALL ".join(union))


def _k_sweep() -> str:
    parts = [TRUTH]
    for k in (4, 6):
        parts += [index(k, Q.ITERATIONS, f"k{k}_"), *runs(f"k{k}_", k)]
    return q(*parts, select="\nUNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS k, config, mean_recall, cost FROM {optimal((0.6,), f'k{k}_', 'recall_at = 5')}" for k in (4, 6)))


def _adaptive_sweep() -> str:
    parts, union = [], []
    for seq, params in enumerate(Q.ADAPTIVE_SWEEP):
        name = f"found{seq}"
        parts += [
            adaptive(params, p=f"a{seq}_"),
            f"{name} AS MATERIALIZED (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h.s, h.d) AS INTEGER) AS rank, h.d AS doc_id FROM (SELECT query_id, unnest(heap) AS h FROM a{seq}_ended))",
            recall(name, f"recall{seq}"),
        ]
        union.append(
            f"SELECT '{params.label()}' AS config, CAST({seq} AS INTEGER) AS seq, CAST(recall_at AS INTEGER) AS recall_at, round(AVG(recall), 6) AS mean_recall, "
            f"round((SELECT SUM(len(seen)) FROM a{seq}_ended) / (SELECT COUNT(*) FROM qid), 6) AS cost FROM recall{seq} GROUP BY recall_at"
        )
    return q(TRUTH, index(), *parts, select="\nUNION ALL ".join(union), recursive=True)


def whole(text: str) -> str:
    """The same over lists of the reference's overlap."""
    return text.replace(cap_of(Q.K), cap_of(Q.K, Q.WHOLE))


ORACLES = {
    "coo_from_csr": _matrix("SELECT row_id, col_id, val FROM x"),
    "dense_explode": "SELECT vec_id AS row_id, CAST(i - 1 AS INTEGER) AS col_id, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS val FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] > 0",
    "gt_one_based_to_zero": "SELECT query_id, CAST(rank AS INTEGER) AS rank, d - 1 AS doc_id FROM (SELECT vec_id AS query_id, 1 AS rank, CAST(label AS BIGINT) AS d FROM embeddings UNION ALL SELECT vec_id, 2, 0 FROM embeddings UNION ALL SELECT vec_id, 3, vec_id + 1 FROM embeddings) WHERE d - 1 >= 0",
    "matrix_stats": _matrix("SELECT n AS n_rows, f AS n_cols, COUNT(*) AS nnz, round(SUM(val), 6) AS total, round(SUM(val) / (n * f), 6) AS cell_mean FROM x, dims GROUP BY n, f"),
    "spmm_xht": q(ctes(), select=f"SELECT row_id, CAST(comp AS INTEGER) AS comp, round(val, 6) + 0.0 AS val FROM ({XHT})"),
    "spmm_xtw": q(ctes(), select=f"SELECT CAST(comp AS INTEGER) AS comp, col_id, round(val, 6) + 0.0 AS val FROM ({XTW})"),
    "gram_hht": q(ctes(), select=f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(val, 6) + 0.0 AS val FROM ({GRAM_H})"),
    "gram_wtw": q(ctes(), select=f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(val, 6) + 0.0 AS val FROM ({GRAM_W})"),
    "row_dots": _matrix("SELECT i.query_id, c.c_custkey AS doc_id, round(coalesce(SUM(a.val * b.val), 0.0), 6) + 0.0 AS score FROM qid i CROSS JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0) c LEFT JOIN q a ON a.query_id = i.query_id LEFT JOIN x b ON b.row_id = c.c_custkey AND b.col_id = a.col_id GROUP BY 1, 2"),
    "row_dots_whole": _matrix("SELECT i.query_id, c.c_custkey AS doc_id, round(coalesce(s.score, 0.0), 6) + 0.0 AS score FROM (SELECT DISTINCT row_id AS query_id FROM x WHERE row_id % 100 = 0) i CROSS JOIN customer c LEFT JOIN (SELECT a.row_id AS query_id, b.row_id AS doc_id, SUM(a.val * b.val) AS score FROM x a JOIN x b USING (col_id) WHERE a.row_id % 100 = 0 GROUP BY 1, 2) s ON s.query_id = i.query_id AND s.doc_id = c.c_custkey"),
    "row_sample_exact": _matrix(f"SELECT p.place AS row_id, col_id, val FROM x JOIN (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM {SAMPLE.format(u=uniform('row_id', '0'), size=100)}) p USING (row_id)"),
    "random_init": q(ctes(), select=FACTORS.format(w="w0", h="h0")),
    "acol_init": q(
        f"draw AS MATERIALIZED (SELECT comp, d, least(CAST(floor({uniform('comp', 'd')} * n) AS BIGINT), n - 1) AS place FROM (SELECT unnest(range({Q.K})) AS comp) CROSS JOIN (SELECT unnest(range(5)) AS d), dims)",
        "placed AS (SELECT c_custkey AS row_id, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer)",
        "ah AS (SELECT draw.comp, col_id, SUM(val) / 5.0 AS val FROM draw JOIN placed USING (place) JOIN x USING (row_id) GROUP BY 1, 2)",
        f"aw AS (SELECT c_custkey AS row_id, comp, {uniform('c_custkey', 'comp')} * (SELECT sqrt(greatest((SELECT SUM(val) FROM x) / greatest(1, n * f), 1e-12) / {Q.K}) FROM dims) AS val FROM customer, (SELECT unnest(range({Q.K})) AS comp) c)",
        select=FACTORS.format(w="aw", h="ah"),
    ),
    "mu_update_w": q(ctes(iterations=1), select="SELECT row_id, CAST(comp AS INTEGER) AS comp, round(val, 6) + 0.0 AS val FROM w1"),
    "mu_update_h": q(ctes(iterations=1), select="SELECT CAST(comp AS INTEGER) AS comp, col_id, round(val, 6) + 0.0 AS val FROM h1"),
    "mu_fit_error_history": q(ctes(iterations=3), _errors(), select="SELECT CAST(iter AS INTEGER) AS iter, round(err, 4) AS err, round(lag(err) OVER (ORDER BY iter) - err, 4) AS improvement, round(abs(lag(err) OVER (ORDER BY iter) - err) / greatest(lag(err) OVER (ORDER BY iter), 1e-12), 6) AS relative FROM errs"),
    "hals_update_w": q(ctes(Q.HALS_K), hals(XHT, "w0", GRAM_H, "SELECT c_custkey AS row_id FROM customer", Q.HALS_K, 2, "row_id"), select="SELECT row_id, CAST(comp AS INTEGER) AS comp, round(val, 6) + 0.0 AS val FROM done WHERE val > 0", recursive=True),
    "hals_update_h": q(ctes(Q.HALS_K), hals(XTW, "h0", GRAM_W, "SELECT p_partkey AS col_id FROM part", Q.HALS_K, 1, "col_id"), select="SELECT CAST(comp AS INTEGER) AS comp, col_id, round(val, 6) + 0.0 AS val FROM done WHERE val > 0", recursive=True),
    "list_cap": _matrix(f"SELECT CAST(k AS INTEGER) AS k, CAST(greatest(1, ceil(n / k * o)) AS INTEGER) AS cap, o AS overlap FROM (SELECT unnest([1, {Q.K}, 7, 100]) AS k) CROSS JOIN (SELECT unnest([0.5::DOUBLE, 10.0::DOUBLE]) AS o), dims"),
    "build_lists": q(index(), select="SELECT CAST(comp AS INTEGER) AS comp, pos, doc_id, round(affinity, 6) + 0.0 AS affinity FROM lists"),
    "list_ties": "WITH s AS (SELECT l_linenumber AS comp, l_partkey AS doc_id, CAST(SUM(l_quantity % 3 - 1) AS DOUBLE) AS affinity FROM lineitem GROUP BY 1, 2),\n" + heap("s", "40") + "\nSELECT comp, pos, doc_id, affinity FROM lists",
    "list_sizes": q(index(), select=f"SELECT CAST(c.comp AS INTEGER) AS comp, COUNT(l.doc_id) AS size FROM (SELECT unnest(range({Q.K})) AS comp) c LEFT JOIN lists l USING (comp) GROUP BY 1"),
    "index_roundtrip": q(index(), select=f"SELECT (SELECT COUNT(*) FROM h{Q.ITERATIONS}) AS n_components, round((SELECT SUM(val) FROM h{Q.ITERATIONS}), 3) AS sum_components, (SELECT COUNT(*) FROM lists) AS n_lists, round((SELECT SUM(affinity) FROM lists), 3) AS sum_lists, 'nmf-lists' AS algo, CAST({Q.K} AS INTEGER) AS k, CAST({cap_of(Q.K)} AS INTEGER) AS cap"),
    "project_queries": q(index(), select="SELECT query_id, CAST(comp AS INTEGER) AS comp, round(q_score, 6) + 0.0 AS q_score FROM projected"),
    "rank_components": q(index(), select="SELECT query_id, comp, round(q_score, 6) + 0.0 AS q_score, rank FROM ranked"),
    "exact_topk": q(TRUTH, select="SELECT query_id, rank, doc_id, score FROM truth"),
    "naive_search": q(TRUTH, index(), naive(Q.NAIVE), select="SELECT query_id, rank, doc_id, score FROM found"),
    "naive_search_whole": whole(q(TRUTH, index(), naive(Q.NAIVE), select="SELECT query_id, rank, doc_id, score FROM found")),
    "naive_search_half_lists": q(TRUTH, index(), naive(Q.HALF), select="SELECT query_id, rank, doc_id, score FROM found"),
    "adaptive_search": q(TRUTH, index(), adaptive(Q.ADAPTIVE), select="SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h.s, h.d) AS INTEGER) AS rank, h.d AS doc_id, -h.s AS score FROM (SELECT query_id, unnest(heap) AS h FROM ended)", recursive=True),
    "adaptive_docs_processed": q(TRUTH, index(), adaptive(Q.ADAPTIVE), select="SELECT query_id, CAST(len(seen) AS BIGINT) AS processed FROM ended", recursive=True),
    "results_padded": q(TRUTH, index(), naive(Q.NAIVE), select=f"SELECT i.query_id, CAST(p.place AS INTEGER) AS place, coalesce(f.doc_id + 1, 0) AS knn, f.score AS dist FROM qid i CROSS JOIN (SELECT unnest(range({Q.TOP + 2})) AS place) p LEFT JOIN found f ON f.query_id = i.query_id AND f.rank = p.place + 1"),
    "results_roundtrip": q(TRUTH, index(), naive(Q.NAIVE), select=f"SELECT query_id, rank, doc_id, score, 'n_components={Q.K};max_iter={Q.ITERATIONS};nprobe=2;list_search_factor=1' AS params FROM found WHERE rank <= 5"),
    "params_string": "SELECT unnest(['n_components=3000;max_iter=25;max_misses=80;dr=0.2', 'n_components=512;max_iter=50;nprobe=16;list_search_factor=1', 'n_components=8;max_iter=2;']) AS params",
    "recall_at_k_normalized": q(TRUTH, index(), naive(Q.NAIVE), recall(), select="SELECT query_id, CAST(recall_at AS INTEGER) AS recall_at, round(recall, 6) AS recall FROM recall"),
    "recall_at_k_fixed": q(TRUTH, index(), naive(Q.NAIVE), select="SELECT i.query_id, CAST(5 AS INTEGER) AS recall_at, round((SELECT COUNT(*) FROM found f JOIN truth t ON t.query_id = f.query_id AND t.doc_id = f.doc_id WHERE f.query_id = i.query_id AND f.rank <= 5 AND t.rank <= 5) / 5.0::DOUBLE, 6) AS recall FROM qid i"),
    "recall_mean_std": q(TRUTH, index(), naive(Q.NAIVE), recall(), select="SELECT CAST(recall_at AS INTEGER) AS recall_at, round(AVG(recall), 6) AS mean_recall, round(stddev_pop(recall), 6) AS std_recall FROM recall GROUP BY recall_at"),
    "recall_whole": whole(q(TRUTH, index(), naive(Q.NAIVE), recall(), select="SELECT CAST(recall_at AS INTEGER) AS recall_at, round(AVG(recall), 6) AS mean_recall, round(stddev_pop(recall), 6) AS std_recall FROM recall GROUP BY recall_at")),
    "param_sweep_recall": q(TRUTH, index(), *runs(), select="SELECT config, seq, recall_at, mean_recall, cost FROM runs"),
    "optimal_per_target": q(TRUTH, index(), *runs(), select=f"SELECT recall_at, target, config, mean_recall, cost FROM {optimal((0.3, 0.5, 0.7, 0.9, 0.99))}"),
    "k_sweep_best": _k_sweep(),
    "sampling_recall": _sampling(),
    "param_sweep_adaptive": _adaptive_sweep(),
    "spmm_xht_blocks": q(ctes(Q.MANY), select=f"SELECT row_id, CAST(comp AS INTEGER) AS comp, round(val, 6) + 0.0 AS val FROM ({XHT})"),
    "spmm_xtw_blocks": q(ctes(Q.MANY), select=f"SELECT CAST(comp AS INTEGER) AS comp, col_id, round(val, 6) + 0.0 AS val FROM ({XTW})"),
    "gram_hht_blocks": q(ctes(Q.MANY), select=f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(val, 6) + 0.0 AS val FROM ({GRAM_H})"),
    "gram_wtw_blocks": q(ctes(Q.MANY), select=f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(val, 6) + 0.0 AS val FROM ({GRAM_W})"),
    "mu_update_blocks": q(ctes(Q.MANY, 1), select=FACTORS.format(w="w1", h="h1")),
    "hals_update_w_blocks": q(ctes(Q.MANY), hals(XHT, "w0", GRAM_H, "SELECT c_custkey AS row_id FROM customer", Q.MANY, 1, "row_id"), select="SELECT row_id, CAST(comp AS INTEGER) AS comp, round(val, 6) + 0.0 AS val FROM done WHERE val > 0", recursive=True),
    "build_lists_blocks": q(index(Q.MANY), select="SELECT CAST(comp AS INTEGER) AS comp, pos, doc_id, round(affinity, 6) + 0.0 AS affinity FROM lists").replace(cap_of(Q.MANY), cap_of(Q.MANY, 2.0)),
    "naive_search_blocks": q(TRUTH, index(Q.MANY), naive(Q.S.NaiveParams(4, 1.0), k=Q.MANY), select="SELECT query_id, rank, doc_id, score FROM found").replace(cap_of(Q.MANY), cap_of(Q.MANY, Q.WHOLE)),
    "coverage_by_rank": q(TRUTH, index(), COVER, select=f"SELECT CAST(r.list_rank AS INTEGER) AS list_rank, round(COUNT(h.rel_pos) / {N_QUERIES}, 6) AS avg_found, round(SUM(COUNT(h.rel_pos)) OVER (ORDER BY r.list_rank) / {N_QUERIES} / {Q.TOP}, 6) AS cumul_recall, round(coalesce(AVG(h.rel_pos), 0.0), 6) AS mean_rel_pos, round(coalesce(stddev_pop(h.rel_pos), 0.0), 6) AS std_rel_pos FROM (SELECT unnest(range(1, {Q.K + 1})) AS list_rank) r LEFT JOIN hit h USING (list_rank) GROUP BY r.list_rank"),
    "coverage_histogram": q(TRUTH, index(), COVER, "tenth AS (SELECT list_rank, least(CAST(floor(rel_pos * 10) AS INTEGER), 9) AS bin, COUNT(*) AS n FROM hit GROUP BY 1, 2)", select=f"SELECT CAST(r.list_rank AS INTEGER) AS list_rank, CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(t.n, 0) AS BIGINT) AS n, round(coalesce(t.n / CAST(SUM(t.n) OVER (PARTITION BY r.list_rank) AS DOUBLE), 0.0), 6) AS share FROM (SELECT unnest(range(1, {Q.K + 1})) AS list_rank) r CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN tenth t USING (list_rank, bin)"),
    "coverage_overall": q(TRUTH, index(), COVER, select=f"SELECT round(COUNT(*) / CAST({N_QUERIES} * {Q.TOP} AS DOUBLE), 6) AS overall_recall FROM hit"),
}
