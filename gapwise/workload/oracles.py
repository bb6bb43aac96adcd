"""Reference SQL for the registered queries, for an independent engine on the same Parquet tables."""

from __future__ import annotations

SEED = 7
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(LINE_KEY)


def word(parts: list[str], salt: str, seed: int | str, start: int = 1) -> str:
    text = ", ".join(f"{p}::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5(concat_ws(':', {text}, '{salt}', '{seed}')), {start}, 8))::BIGINT)::DOUBLE"


def uniform(parts: list[str], salt: str, seed: int = SEED) -> str:
    return f"({word(parts, salt, seed)} / 4294967296.0)"


def normal(parts: list[str], salt: str, seed: int = SEED) -> str:
    u1 = f"(({word(parts, salt, seed)} + 0.5) / 4294967296.0)"
    u2 = f"(({word(parts, salt, seed, 9)} + 0.5) / 4294967296.0)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {u2}))"


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


ORDERS = f"""
o AS (SELECT o_orderkey, o_custkey, o_totalprice AS truth, {uniform(['o_orderkey'], 'o_totalprice')} < 0.3 AS mask
      FROM orders),
m AS (SELECT o_orderkey, o_custkey, truth, mask, CASE WHEN NOT mask THEN truth END AS o_totalprice FROM o)"""
LABELLED = """
dl AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
EVENTS = f"""
e AS (SELECT event_id,
             CASE WHEN NOT ({uniform(['event_id'], 'user_id')} < 0.2) THEN user_id END AS user_id,
             CASE WHEN NOT ({uniform(['event_id'], 'event_type')} < 0.25) THEN event_type END AS event_type,
             CASE WHEN NOT event_type = 'error' THEN value END AS value,
             (props::JSON ->> '$.k')::BIGINT AS k
      FROM events)"""
PRICES = f"""
p AS (SELECT {KEYS}, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net,
             l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity AS qty FROM lineitem)"""
PRICES_MCAR = PRICES + f""",
x AS (SELECT {KEYS}, price, qty, net AS truth, {uniform(LINE_KEY, 'net')} < 0.3 AS mask,
             CASE WHEN NOT ({uniform(LINE_KEY, 'net')} < 0.3) THEN net END AS net FROM p)"""
PRICES_GAPS = PRICES + f""",
x AS (SELECT {KEYS}, price, qty, CASE WHEN NOT ({uniform(LINE_KEY, 'net')} < 0.25) THEN net END AS net,
             CASE WHEN NOT ({uniform(LINE_KEY, 'charge')} < 0.25) THEN charge END AS charge FROM p)"""
SIZES = f"""
w AS (SELECT doc_id, n_chars::DOUBLE AS n_chars,
             (length(text) - length(replace(text, ' ', '')) + 1)::DOUBLE AS truth,
             {uniform(['doc_id'], 'n_words')} < 0.3 AS mask FROM documents),
x AS (SELECT doc_id, n_chars, CASE WHEN NOT mask THEN truth END AS n_words FROM w)"""


def bisection(driver: str) -> str:
    return f"""
z AS (SELECT o_orderkey, o_custkey, o_totalprice,
             ({driver} - avg({driver}) OVER ()) / stddev_pop({driver}) OVER () AS z FROM orders),
b(i, lo, hi) AS (
  SELECT 0, -30.0::DOUBLE, 30.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN mean < 0.3 THEN mid ELSE lo END, CASE WHEN mean < 0.3 THEN hi ELSE mid END
  FROM (SELECT b.i, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid, avg(1 / (1 + exp(-((b.lo + b.hi) / 2 + 2.5 * z.z)))) AS mean
        FROM b, z WHERE b.i < 60 GROUP BY b.i, b.lo, b.hi)),
a AS (SELECT (lo + hi) / 2 AS a FROM b WHERE i = 60),
o AS (SELECT o_orderkey, o_custkey, o_totalprice AS truth,
             {uniform(['o_orderkey'], 'o_totalprice')} < 1 / (1 + exp(-(a.a + 2.5 * z.z))) AS mask FROM z, a),
m AS (SELECT o_orderkey, o_custkey, truth, mask, CASE WHEN NOT mask THEN truth END AS o_totalprice FROM o)"""


INJECTED = "SELECT o_orderkey, o_totalprice, truth, mask FROM m"


def ridge(y: str, x: str) -> str:
    """Bayesian ridge with one predictor as a recursion over scalars; tables t (rows), s (sums), f (result)."""
    return f"""
s AS (SELECT count(*)::DOUBLE AS n, avg({x}) AS xm, avg({y}) AS ym, var_pop({x}) * count(*) AS xx,
             covar_pop({x}, {y}) * count(*) AS xy, var_pop({y}) * count(*) AS yy FROM x WHERE {y} IS NOT NULL),
it(i, alpha, lam, slope, stop) AS (
  SELECT 0, 1 / (yy / n + 2.220446049250313e-16), 1.0::DOUBLE, NULL::DOUBLE, FALSE FROM s
  UNION ALL
  SELECT i + 1, (n - used + 2e-6) / (greatest(yy - 2 * b * xy + b * b * xx, 0) + 2e-6), (used + 2e-6) / (b * b + 2e-6), b,
         coalesce(abs(slope - b) < 1e-3, FALSE)
  FROM (SELECT it.i, it.slope, s.*, s.xy / (s.xx + it.lam / it.alpha) AS b,
               it.alpha * s.xx / (it.lam + it.alpha * s.xx) AS used
        FROM it, s WHERE NOT it.stop AND it.i < 300)),
f AS (SELECT s.xm, s.ym, xy / (xx + lam / alpha) AS slope, 1 / alpha AS noise, 1 / (alpha * xx + lam) AS cov
      FROM it, s ORDER BY i DESC LIMIT 1)"""


def _corr(a: str, b: str, source: str, where: str = "") -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"(SELECT CASE WHEN count(*) > 1 THEN corr({a}::DOUBLE, {b}::DOUBLE) END FROM {source} WHERE {both})"


def _matrix(kind: str, cols: list[str], source: str, where: str = "") -> list[str]:
    out = []
    for a in cols:
        for b in cols:
            value = _corr(a, b, source, where)
            out.append(f"SELECT '{kind}' AS kind, '{a}' AS col_a, '{b}' AS col_b, {r(value)} AS value")
    return out


def _pairwise() -> str:
    cols = ["user_id", "value", "k"]
    parts = _matrix("corr_pairwise", cols, "e")
    parts += _matrix("corr_listwise", cols, "e", " AND ".join(f"{n} IS NOT NULL" for n in cols))
    parts += [f"SELECT 'n_pairwise', '{a}', '{b}', (SELECT count(*) FROM e WHERE {a} IS NOT NULL AND {b} IS NOT NULL)::DOUBLE"
              for a in cols for b in cols]
    return f"WITH {EVENTS}\n" + "\nUNION ALL\n".join(parts)


def _correlations() -> str:
    cols = ["price", "net", "charge", "qty"]
    mean = ("f AS (SELECT price, qty, coalesce(net, (SELECT avg(net) FROM x)) AS net, "
            "coalesce(charge, (SELECT avg(charge) FROM x)) AS charge FROM x)")
    parts = []
    for side, source in (("before", "x"), ("after", "f"), ("truth", "p")):
        for a in cols:
            for b in cols:
                both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
                parts.append(f"SELECT '{side}' AS side, '{a}' AS col_a, '{b}' AS col_b, "
                             f"(SELECT count(*) FROM {source} WHERE {both}) AS n, {r(_corr(a, b, source))} AS value")
    return f"WITH {PRICES_GAPS},\n{mean}\n" + "\nUNION ALL\n".join(parts)


def _describe(side: str, source: str, column: str, name: str) -> str:
    return (f"SELECT '{side}' AS side, '{name}' AS \"column\", count({column}) AS n, {r(f'avg({column})', 4)} AS mean, "
            f"{r(f'stddev_samp({column})', 4)} AS std, {r(f'min({column})::DOUBLE', 4)} AS min, "
            f"{r(f'max({column})::DOUBLE', 4)} AS max FROM {source}")


MEAN_FILL = "f AS (SELECT *, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM m)) AS filled FROM m)"
MEDIAN_FILL = "f AS (SELECT *, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM m)) AS filled FROM m)"


def _describe_all() -> str:
    parts = []
    for side, source, column in (("before", "m", "o_totalprice"), ("after", "f", "filled"), ("truth", "m", "truth")):
        parts += [_describe(side, source, "o_custkey", "o_custkey"), _describe(side, source, column, "o_totalprice")]
    return f"WITH {ORDERS}, {MEAN_FILL}\n" + "\nUNION ALL\n".join(parts)


HISTOGRAM = f"""WITH {ORDERS}, {MEDIAN_FILL},
v AS (SELECT 'before' AS series, o_totalprice AS v FROM m WHERE o_totalprice IS NOT NULL
      UNION ALL SELECT 'after', filled FROM f UNION ALL SELECT 'truth', truth FROM m),
l AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 20 AS st FROM v),
g AS (SELECT series, v, lo, hi, st, least(floor((v - lo) / (hi - lo) * 20.0), 19)::INTEGER AS b FROM v, l),
c AS (SELECT series, b - (v < lo + b * st)::INTEGER + (v >= lo + (b + 1) * st AND b <> 19)::INTEGER AS bin,
             count(*) AS n FROM g GROUP BY 1, 2),
grid AS (SELECT s.series, k.bin::INTEGER AS bin FROM (SELECT DISTINCT series FROM v) s, range(20) k(bin))
SELECT grid.series, grid.bin, {r('lo + grid.bin * st', 4)} AS low,
       {r('CASE WHEN grid.bin = 19 THEN hi ELSE lo + (grid.bin + 1) * st END', 4)} AS high, coalesce(c.n, 0) AS n
FROM grid CROSS JOIN l LEFT JOIN c ON c.series = grid.series AND c.bin = grid.bin"""


def _knn(table: str, key: str, x: str, y: str, weights: str, digits: int) -> str:
    mask = f"{uniform([key], y)} < 0.3"
    mean = "avg(v)"
    if weights == "distance":
        mean = "coalesce(avg(v) FILTER (d2 = 0), sum(v / nullif(sqrt(d2), 0)) / sum(1 / nullif(sqrt(d2), 0)))"
    return f"""WITH
m AS (SELECT {key}, {x}, {y}::DOUBLE AS truth, {mask} AS mask FROM {table}),
s AS (SELECT avg({x}) AS xm, stddev_pop({x}) AS xs FROM m),
q AS (SELECT {key} AS key, ({x} - xm) / xs AS z, truth AS v, mask FROM m, s),
n AS (SELECT r.key, unnest(min_by(struct_pack(v := d.v, d2 := 2.0 * (r.z - d.z) * (r.z - d.z)),
                                  row(round(2.0 * (r.z - d.z) * (r.z - d.z), 9), d.key), 5)) AS c
      FROM q r, q d WHERE r.mask AND NOT d.mask GROUP BY r.key),
t AS (SELECT key, {mean} AS fill FROM (SELECT key, c.v AS v, c.d2 AS d2 FROM n) GROUP BY key)
SELECT m.{key}, {r(f'CASE WHEN m.mask THEN t.fill ELSE m.truth END', digits)} AS {y}
FROM m LEFT JOIN t ON m.{key} = t.key"""


def _knn_gaps() -> str:
    cols = ["user_id", "value", "k"]
    scores = ", ".join(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () AS z_{n}" for n in cols)
    parts = []
    for target in ("user_id", "value"):
        others = [n for n in cols if n != target]
        common = " + ".join(f"(r.z_{n} IS NOT NULL AND d.z_{n} IS NOT NULL)::INTEGER" for n in others)
        total = " + ".join(f"coalesce((r.z_{n} - d.z_{n}) * (r.z_{n} - d.z_{n}), 0)" for n in others)
        parts.append(f"""
t_{target} AS (SELECT event_id, list_avg(near) AS fill FROM (
    SELECT event_id, min_by(v, row(round(d2, 9), donor), 5) AS near FROM (
        SELECT r.event_id, d.{target} AS v, d.event_id AS donor, ({total}) * (3.0 / nullif({common}, 0)) AS d2
        FROM z r, z d WHERE r.{target} IS NULL AND d.{target} IS NOT NULL) WHERE d2 IS NOT NULL GROUP BY event_id))""")
    filled = ", ".join(r(f"coalesce(e.{n}, t_{n}.fill, (SELECT avg({n}) FROM e))", 4) + f" AS {n}"
                       for n in ("user_id", "value"))
    return (f"WITH {EVENTS},\nz AS (SELECT event_id, user_id, value, k, {scores} FROM e),{','.join(parts)}\n"
            f"SELECT e.event_id, {filled}, e.k FROM e LEFT JOIN t_user_id ON e.event_id = t_user_id.event_id "
            "LEFT JOIN t_value ON e.event_id = t_value.event_id")


PATTERNS = f"""WITH {PRICES_GAPS},
a AS (SELECT avg(price) AS pm, avg(net) AS nm, avg(charge) AS cm FROM x),
z AS (SELECT (net IS NULL)::INTEGER || '' || (charge IS NULL)::INTEGER AS pattern, coalesce(price - pm, 0) AS z0,
             coalesce(net - nm, 0) AS z1, coalesce(charge - cm, 0) AS z2 FROM x, a)
SELECT pattern, count(*) AS n, """ + ", ".join(
    [f"{r(f'sum(z{i}) / count(*) / 1e4')} AS s_{i}" for i in range(3)]
    + [f"{r(f'sum(z{i} * z{j}) / count(*) / 1e8')} AS q_{i}_{j}" for i in range(3) for j in range(i, 3)]
) + " FROM z GROUP BY pattern"

REGRESSION_2 = f"""WITH {PRICES_MCAR},
s AS (SELECT avg(price) AS am, avg(qty) AS bm, avg(net) AS ym, covar_pop(price, price) AS aa, covar_pop(qty, qty) AS bb,
             covar_pop(price, qty) AS ab, covar_pop(price, net) AS ay, covar_pop(qty, net) AS bt
      FROM x WHERE net IS NOT NULL),
f AS (SELECT am, bm, ym, (bb * ay - ab * bt) / (aa * bb - ab * ab) AS u, (aa * bt - ab * ay) / (aa * bb - ab * ab) AS v FROM s)
SELECT {KEYS}, coalesce(net, {r('ym + u * (price - am) + v * (qty - bm)', 1)}) AS net FROM x, f"""

REGRESSION_GAPS = f"""WITH {PRICES_GAPS},
h AS (SELECT *, coalesce(net, (SELECT avg(net) FROM x)) AS hn, coalesce(charge, (SELECT avg(charge) FROM x)) AS hc FROM x),
f AS (SELECT regr_slope(net, hc) AS n1, regr_intercept(net, hc) AS n0, regr_slope(charge, hn) AS c1,
             regr_intercept(charge, hn) AS c0 FROM h)
SELECT {KEYS}, coalesce(net, {r('n0 + n1 * hc', 1)}) AS net, coalesce(charge, {r('c0 + c1 * hn', 1)}) AS charge FROM h, f"""

EM = f"""WITH RECURSIVE {PRICES_MCAR},
c AS (SELECT avg(price) AS pm, avg(net) AS nm FROM x),
y AS (SELECT price - pm AS a, net - nm AS b FROM x, c),
s AS (SELECT count(*)::DOUBLE AS n, sum(a) AS sa, sum(a * a) AS saa,
             count(b)::DOUBLE AS no, sum(a) FILTER (b IS NOT NULL) AS oa, sum(b) AS ob, sum(b * b) AS obb, sum(a * b) AS oab,
             coalesce(sum(a) FILTER (b IS NULL), 0) AS ma, coalesce(sum(a * a) FILTER (b IS NULL), 0) AS maa FROM y),
em(i, m1, m2, v1, v12, v2, stop, f0, f1) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, saa / n + 1e-8, oab / n, obb / n + 1e-8, FALSE, NULL::DOUBLE, NULL::DOUBLE FROM s
  UNION ALL
  SELECT i + 1, w1, w2, u1, u12, u2,
         greatest(abs(w1 - m1), abs(w2 - m2), abs(u1 - v1), abs(u12 - v12), abs(u2 - v2)) / greatest(1, v1, abs(v12), v2) < 1e-6,
         k0, k1
  FROM (SELECT *, saa / n - w1 * w1 AS u1, (oab + k0 * ma + k1 * maa) / n - w1 * w2 AS u12,
               (obb + k0 * k0 * (n - no) + 2 * k0 * k1 * ma + k1 * k1 * maa + (n - no) * (v2 - k1 * v12)) / n - w2 * w2 AS u2
        FROM (SELECT *, sa / n AS w1, (ob + k0 * (n - no) + k1 * ma) / n AS w2
              FROM (SELECT em.i, em.m1, em.m2, em.v1, em.v12, em.v2, s.*, em.v12 / em.v1 AS k1,
                           em.m2 - em.v12 / em.v1 * em.m1 AS k0
                    FROM em, s WHERE NOT em.stop AND em.i < 100)))),
f AS (SELECT f0, f1 FROM em ORDER BY i DESC LIMIT 1)
SELECT {KEYS}, coalesce(net, {r('nm + f0 + f1 * (price - pm)', 1)}) AS net FROM x, f, c"""


def _em_gaps(cols: list[str]) -> str:
    """EM for net and charge (gaps) among ``cols`` (the others complete), from sums per missing pattern.

    The regressions of a round come from sweeping the covariance matrix: first on the complete columns (pattern d, both
    missing), then on charge (pattern b, net missing) or on net (pattern c, charge missing).
    """
    p, net, charge = len(cols), cols.index("net"), cols.index("charge")
    complete = [i for i in range(p) if i not in (net, charge)]
    key = lambda i, j: f"{min(i, j)}{max(i, j)}"
    pairs = [key(i, j) for i in range(p) for j in range(i, p)]
    gaps = {"a": [], "b": [net], "c": [charge], "d": [net, charge]}
    where = {"a": "NOT g1 AND NOT g2", "b": "g1 AND NOT g2", "c": "NOT g1 AND g2", "d": "g1 AND g2"}
    seen = {k: [i for i in range(p) if i not in g] for k, g in gaps.items()}

    def sweep(old: str, new: str, at: int) -> str:
        pivot, out = f"{old}{key(at, at)}", []
        for i in range(p):
            for j in range(i, p):
                a = f"{old}{key(i, j)}"
                value = (f"-1 / {pivot}" if i == j == at else f"{a} / {pivot}" if at in (i, j)
                         else f"{a} - {old}{key(i, at)} * {old}{key(at, j)} / {pivot}")
                out.append(f"{value} AS {new}{key(i, j)}")
        return ", ".join(out)

    levels, at = [], "v"
    for step, column in enumerate(complete):
        name = "rd" if column == complete[-1] else f"r{step}_"
        levels.append(sweep(at, name, column))
        at = name
    levels.append(sweep("rd", "rb", charge) + ", " + sweep("rd", "rc", net))
    sums, starts, first, second, fit = [], [], [], [], []
    for k, g in gaps.items():
        sums.append(f"count(*) FILTER ({where[k]})::DOUBLE AS {k}n")
        sums += [f"coalesce(sum(x{i}) FILTER ({where[k]}), 0) AS {k}s{i}" for i in range(p)]
        sums += [f"coalesce(sum(x{q[0]} * x{q[1]}) FILTER ({where[k]}), 0) AS {k}q{q}" for q in pairs]
        for m in g:
            slope = {o: f"r{k}{key(m, o)}" for o in seen[k]}
            fit += [f"{k}i{m}", *slope.values()]
            starts.append(f"m{m} - " + " - ".join(f"{w} * m{o}" for o, w in slope.items()) + f" AS {k}i{m}")
            first.append(" + ".join([f"{k}i{m} * {k}n", *(f"{w} * {k}s{o}" for o, w in slope.items())]) + f" AS {k}f{m}")
            first += [" + ".join([f"{k}i{m} * {k}s{j}", *(f"{w} * {k}q{key(o, j)}" for o, w in slope.items())]) + f" AS {k}f{m}_{j}" for j in seen[k]]
            second += [" + ".join([f"{k}i{m} * {k}f{l}", *(f"{w} * {k}f{l}_{o}" for o, w in slope.items()), f"{k}n * r{k}{key(m, l)}"])
                       + f" AS {k}e{key(m, l)}" for l in g if l >= m]
    single = lambda i: " + ".join(f"{k}s{i}" if i in seen[k] else f"{k}f{i}" for k in gaps)

    def product(i: int, j: int) -> str:
        parts = []
        for k, g in gaps.items():
            missing = [x for x in (i, j) if x in g]
            parts.append(f"{k}q{key(i, j)}" if not missing else f"{k}e{key(i, j)}" if len(missing) == 2 or i == j
                         else f"{k}f{missing[0]}_{j if missing[0] == i else i}")
        return " + ".join(parts)

    means = ", ".join(f"({single(i)}) / n AS w{i}" for i in range(p))
    spread = ", ".join(f"({product(i, j)}) / n - w{i} * w{j} AS u{key(i, j)}" for i in range(p) for j in range(i, p))
    levels += [", ".join(x) for x in (starts, first, second)] + [means, spread]
    state, following = [f"m{i}" for i in range(p)] + [f"v{q}" for q in pairs], [f"w{i}" for i in range(p)] + [f"u{q}" for q in pairs]
    fit = list(dict.fromkeys(fit))
    moved = ", ".join(f"abs({x} - {y})" for x, y in zip(following, state))
    size = ", ".join(f"abs({v})" for v in state[p:])
    begin = ", ".join(f"(aq{q} + bq{q} + cq{q} + dq{q}) / n{' + 1e-8' if q[0] == q[1] else ''}" for q in pairs)
    work = f"SELECT em.i, {', '.join('em.' + v for v in state)}, s.* FROM em, s WHERE NOT em.stop AND em.i < 100"
    for level in levels:
        work = f"SELECT *, {level} FROM ({work})"

    def filled(m: int, k: str) -> str:
        return " + ".join([f"k_{k}i{m}", *(f"k_r{k}{key(m, o)} * ({cols[o]} - h{o})" for o in seen[k])])

    return f"""WITH RECURSIVE {PRICES_GAPS},
h AS (SELECT {', '.join(f'avg({n}) AS h{i}' for i, n in enumerate(cols))} FROM x),
y AS (SELECT net IS NULL AS g1, charge IS NULL AS g2, {', '.join(f'coalesce({n} - h{i}, 0) AS x{i}' for i, n in enumerate(cols))} FROM x, h),
s AS (SELECT count(*)::DOUBLE AS n, {', '.join(sums)} FROM y),
em(i, stop, {', '.join(state)}, {', '.join(f'k_{f}' for f in fit)}) AS (
  SELECT 0, FALSE, {', '.join(['0.0::DOUBLE'] * p)}, {begin}, {', '.join(['NULL::DOUBLE'] * len(fit))} FROM s
  UNION ALL
  SELECT i + 1, greatest({moved}) / greatest(1, {size}) < 1e-6, {', '.join(following)}, {', '.join(fit)} FROM ({work})),
f AS (SELECT * FROM em ORDER BY i DESC LIMIT 1)
SELECT {KEYS},
       coalesce(net, {r(f'h{net} + CASE WHEN charge IS NULL THEN {filled(net, "d")} ELSE {filled(net, "b")} END', 1)}) AS net,
       coalesce(charge, {r(f'h{charge} + CASE WHEN net IS NULL THEN {filled(charge, "d")} ELSE {filled(charge, "c")} END', 1)}) AS charge
FROM x, f, h"""


def _draws() -> str:
    runs = ", ".join(
        f"mu + sqrt(var) * {normal(['doc_id'], 'n_words:draw:9', SEED + i)} AS d{i}" for i in range(5))
    return f"""WITH RECURSIVE {SIZES}, {ridge('n_words', 'n_chars')},
g AS (SELECT x.doc_id, x.n_chars, x.n_words, ym + slope * (n_chars - xm) AS mu,
             noise + cov * (n_chars - xm) * (n_chars - xm) AS var FROM x, f),
d AS (SELECT *, {runs} FROM g)"""


_MEAN_RUNS = "(d0 + d1 + d2 + d3 + d4) / 5"
_SD_RUNS = "sqrt((" + " + ".join(f"(d{i} - {_MEAN_RUNS}) ** 2" for i in range(5)) + ") / 5)"
MULTIPLE = f"""{_draws()}
SELECT doc_id, {r('coalesce(n_words, d0)', 3)} AS n_words,
       {r(f'CASE WHEN n_words IS NULL THEN {_SD_RUNS} ELSE 0.0 END', 3)} AS sd FROM d"""
POOLED = f"""{_draws()},
k AS (""" + " UNION ALL ".join(
    f"SELECT avg(coalesce(n_words, d{i})) AS a, avg(n_chars) AS b FROM d" for i in range(5)) + f""")
SELECT 'n_words' AS "column", {r('avg(a)', 4)} AS pooled_mean, {r('stddev_samp(a)', 4)} AS between_sd FROM k
UNION ALL SELECT 'n_chars', {r('avg(b)', 4)}, {r('stddev_samp(b)', 4)} FROM k"""

COMPARISON = f"""WITH {PRICES_MCAR},
a AS (SELECT avg(net) AS am, median(net) AS md, regr_slope(net, price) AS b1, regr_intercept(net, price) AS b0 FROM x),
t AS (SELECT 'mean' AS label, truth, mask, coalesce(net, am) AS v FROM x, a
      UNION ALL SELECT 'median', truth, mask, coalesce(net, md) FROM x, a
      UNION ALL SELECT 'regression', truth, mask, coalesce(net, b0 + b1 * price) FROM x, a
      UNION ALL SELECT 'constant', truth, mask, coalesce(net, 0) FROM x, a
      UNION ALL SELECT 'none', truth, mask, net FROM x)
SELECT label, {r('CASE WHEN count(*) FILTER (mask AND v IS NULL) = 0 THEN sqrt(avg((v - truth) ** 2) FILTER (mask)) END', 4)} AS rmse,
       {r('avg(v)', 4)} AS mean, {r('stddev_samp(v)', 4)} AS std FROM t GROUP BY label"""


def _report() -> str:
    def block(column: str, before: str, after: str, truth: str, error: str) -> str:
        stats = []
        for side, x in (("before", before), ("after", after), ("truth", truth)):
            stats.append(f"count({x}) AS {side}_n")
            for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                stats.append(f"{r(f'{agg}({x})::DOUBLE', 4)} AS {side}_{name}")
        return (f"SELECT '{column}' AS \"column\", count(*) - count({before}) AS missing, {', '.join(stats)}, "
                f"{error} AS rmse, {r(f'(avg({after}) - avg({truth})) / abs(avg({truth})) * 100.0', 4)} AS deviation_pct FROM f")

    price_error = r("sqrt(avg((filled - truth) ** 2) FILTER (mask))", 4)
    return (f"WITH RECURSIVE {bisection('o_totalprice')}, {MEAN_FILL}\n"
            + block("o_custkey", "o_custkey", "o_custkey", "o_custkey", "NULL::DOUBLE") + "\nUNION ALL\n"
            + block("o_totalprice", "o_totalprice", "filled", "truth", price_error))


DEVIATION = f"""WITH {ORDERS}, {MEDIAN_FILL}
SELECT 'o_totalprice' AS "column", """ + ", ".join(
    r(f"({agg}(filled) - {agg}(truth)) / abs({agg}(truth)) * 100.0", 4) + f" AS {name}"
    for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM f"


def _orders_fill(value: str) -> str:
    return (f"WITH {ORDERS} SELECT o_orderkey, {r(f'coalesce(o_totalprice, {value})', 4)} AS o_totalprice FROM m")


def _mode(column: str) -> str:
    return (f"(SELECT {column} FROM e WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} ASC LIMIT 1)")


ORACLES: dict[str, str] = {
    "missing_profile": f"WITH {LABELLED}\n" + " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing, count(*) AS rows FROM dl"
        for n in ("lang", "source", "n_chars", "quality", "toxic")),
    "usable_columns": f"WITH {LABELLED} SELECT 'n_chars' AS \"column\", count(n_chars) AS n, count(n_chars) > 0 AS usable FROM dl "
                      "UNION ALL SELECT 'quality', count(quality), count(quality) > 0 FROM dl UNION ALL SELECT 'toxic', 0, FALSE",
    "table_shapes": f"WITH {LABELLED} SELECT 'before' AS side, count(*) AS n_rows, 5::BIGINT AS n_columns FROM dl "
                    "UNION ALL SELECT 'listwise', count(*), 5 FROM dl WHERE quality IS NOT NULL AND toxic IS NOT NULL "
                    "UNION ALL SELECT 'drop_columns', count(*), 3 FROM dl",
    "csv_tokens": "SELECT event_id, user_id, CASE WHEN event_type <> 'click' THEN event_type END AS event_type, "
                  "CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS value FROM events",
    "csv_texts": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "mask_by_rule": "SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events",
    "inject_mcar": f"WITH {ORDERS} {INJECTED}",
    "inject_mar": f"WITH RECURSIVE {bisection('o_custkey')} {INJECTED}",
    "inject_mnar": f"WITH RECURSIVE {bisection('o_totalprice')} {INJECTED}",
    "keep_one": "SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN c_acctbal END AS c_acctbal, "
                "c_acctbal AS truth, c_custkey <> (SELECT min(c_custkey) FROM customer) AS mask FROM customer",
    "default_spec": "SELECT 'MCAR' AS mechanism, 0.3::DOUBLE AS rate, 'l_tax' AS target, driver FROM ("
                    + " UNION ALL ".join(f"SELECT '{n}' AS driver, {i} AS i, abs(corr({n}, l_tax)) AS v FROM lineitem"
                                         for i, n in enumerate(("l_quantity", "l_extendedprice", "l_discount")))
                    + ") ORDER BY v DESC, i LIMIT 1",
    "listwise": f"WITH {LABELLED} SELECT * FROM dl WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL "
                "AND quality IS NOT NULL AND toxic IS NOT NULL",
    "drop_columns": f"WITH {LABELLED} SELECT doc_id, lang, source, n_chars FROM dl",
    "pairwise_corr": _pairwise(),
    "no_method": f"WITH {ORDERS} SELECT o_orderkey, o_totalprice FROM m",
    "impute_mean": _orders_fill("(SELECT avg(o_totalprice) FROM m)"),
    "impute_median": _orders_fill("(SELECT median(o_totalprice) FROM m)"),
    "impute_constant": _orders_fill("-1.5"),
    "impute_mode": f"WITH {EVENTS} SELECT event_id, coalesce(event_type, {_mode('event_type')}) AS event_type, "
                   f"coalesce(user_id, {_mode('user_id')}) AS user_id, coalesce(value, {_mode('value')}) AS value FROM e",
    "indicator": f"WITH {LABELLED} SELECT doc_id, n_chars, {r('coalesce(quality, (SELECT avg(quality) FROM dl))')} AS quality, "
                 f"{r('coalesce(toxic, (SELECT avg(toxic) FROM dl))')} AS toxic, (quality IS NULL)::INTEGER AS quality_missing, "
                 "(toxic IS NULL)::INTEGER AS toxic_missing FROM dl",
    "standardize": "SELECT c_custkey, " + ", ".join(
        r(f"({n} - (SELECT avg({n}) FROM customer)) / (SELECT stddev_pop({n}) FROM customer)") + f" AS {n}"
        for n in ("c_nationkey", "c_acctbal")) + " FROM customer",
    "impute_knn_uniform": _knn("customer", "c_custkey", "c_nationkey", "c_acctbal", "uniform", 4),
    "impute_knn_distance": _knn("part", "p_partkey", "p_retailprice", "p_size", "distance", 4),
    "impute_knn_gaps": _knn_gaps(),
    "impute_knn_orders": _knn("orders", "o_orderkey", "o_custkey", "o_totalprice", "uniform", 2),
    "pattern_statistics": PATTERNS,
    "impute_regression_1": f"WITH {PRICES_MCAR}, f AS (SELECT regr_slope(net, price) AS b1, regr_intercept(net, price) AS b0 FROM x) "
                           f"SELECT {KEYS}, coalesce(net, {r('b0 + b1 * price', 1)}) AS net FROM x, f",
    "impute_regression_2": REGRESSION_2,
    "impute_regression_gaps": REGRESSION_GAPS,
    "impute_regression_noise":
        f"WITH {PRICES_MCAR}, f AS (SELECT regr_slope(net, price) AS b1, regr_intercept(net, price) AS b0 FROM x), "
        "g AS (SELECT sqrt(avg((net - b0 - b1 * price) ** 2)) AS sd FROM x, f WHERE net IS NOT NULL) "
        f"SELECT {KEYS}, coalesce(net, {r('b0 + b1 * price + sd * ' + normal(LINE_KEY, 'net:noise'), 1)}) AS net FROM x, f, g",
    "impute_iterative": f"WITH RECURSIVE {PRICES_MCAR}, {ridge('net', 'price')} "
                        f"SELECT {KEYS}, coalesce(net, {r('ym + slope * (price - xm)', 1)}) AS net FROM x, f",
    "impute_em": EM,
    "impute_em_three": _em_gaps(["price", "net", "charge"]),
    "impute_em_gaps": _em_gaps(["price", "net", "charge", "qty"]),
    "error_codes": "SELECT * FROM (VALUES ('header twice', 'duplicate_columns'), ('header blank', 'missing_header'), ('no rows', 'empty_table'), "
                   "('row limit', 'too_many_rows'), ('column limit', 'too_many_columns'), ('texts only', 'no_numeric_column'), "
                   "('kind of source', 'unknown_dataset'), ('name of source', 'unknown_dataset'), ('mechanism', 'bad_mechanism'), "
                   "('rate', 'bad_rate'), ('gaps before', 'not_complete'), ('target', 'bad_target'), "
                   "('driver', 'bad_driver'), ('method', 'unknown_method'), ('fill value', 'bad_param'), "
                   "('neighbours', 'bad_param'), ('weights', 'bad_param'), ('no key', 'bad_param'), "
                   "('nothing left', 'no_columns_left'), ('model on texts', 'no_numeric_column'), ('rounds below one', '1 note')"
                   ") t(request, code) WHERE (SELECT count(*) FROM orders) > 10",
    "forest_squares": f"SELECT p_partkey, p_size, (p_size * p_size)::DOUBLE AS area, {uniform(['p_partkey'], 'area')} < 0.3 AS mask FROM part",
    "boosting_groups": f"WITH m AS (SELECT p_partkey, p_size % 5 AS level, p_partkey::DOUBLE AS truth, "
                       f"{uniform(['p_partkey'], 'number')} < 0.3 AS mask FROM part) SELECT p_partkey, level, "
                       f"{r('CASE WHEN mask THEN avg(truth) FILTER (NOT mask) OVER (PARTITION BY level) ELSE truth END', 4)} AS number FROM m",
    **{f"{method}_two_gaps": "SELECT count(*) AS n_rows, 0::BIGINT AS gaps_left, 0::BIGINT AS changed, TRUE AS better_than_mean FROM lineitem"
       for method in ("forest", "chain")},
    "spread_two_gaps": "SELECT count(*) AS n_rows, 0::BIGINT AS spread_on_observed, 0::BIGINT AS gaps_without_spread FROM lineitem",
    "impute_multiple": MULTIPLE,
    "pooled": POOLED,
    "report_cells": f"{_draws()} SELECT doc_id, 'n_words' AS \"column\", {r('d0', 3)} AS value, {r('truth', 3)} AS truth, "
                    f"{r(_SD_RUNS, 3)} AS sd FROM d JOIN w USING (doc_id) WHERE mask",
    "report_notes": f"WITH {EVENTS} SELECT 'focus' AS part, CASE WHEN count(user_id) < count(*) THEN 'user_id' "
                    "WHEN count(value) < count(*) THEN 'value' WHEN count(k) < count(*) THEN 'k' ELSE 'user_id' END AS text FROM e "
                    "UNION ALL SELECT 'note', 'No values were removed, because the table has gaps of its own.' UNION ALL SELECT 'note', "
                    "'This method works on numeric columns only; gaps in ''event_type'' remain.' FROM e HAVING count(event_type) < count(*)",
    "describe_before_after": _describe_all(),
    "histogram_shared": HISTOGRAM,
    "rmse_truth": f"WITH {ORDERS}, a AS (SELECT avg(o_totalprice) AS am, median(o_totalprice) AS md FROM m) "
                  f"SELECT 'mean' AS method, {r('sqrt(avg((am - truth) ** 2))', 4)} AS rmse FROM m, a WHERE mask "
                  f"UNION ALL SELECT 'median', {r('sqrt(avg((md - truth) ** 2))', 4)} FROM m, a WHERE mask "
                  "UNION ALL SELECT 'none', NULL UNION ALL SELECT 'listwise', NULL",
    "deviation": DEVIATION,
    "correlation_before_after": _correlations(),
    "dropped_documents": f"WITH {LABELLED} SELECT doc_id FROM dl WHERE quality IS NULL OR toxic IS NULL",
    "dropped_shown": f"WITH {LABELLED} SELECT doc_id FROM (SELECT * FROM dl ORDER BY doc_id LIMIT 200) "
                     "WHERE quality IS NULL OR toxic IS NULL",
    "surviving_gaps": f"WITH {EVENTS} SELECT event_id FROM e WHERE value IS NULL AND event_type IS NOT NULL",
    "imputed_values": f"WITH {ORDERS} SELECT o_orderkey, 'o_totalprice' AS \"column\", "
                      f"{r('(SELECT avg(o_totalprice) FROM m)', 4)} AS value, {r('truth', 4)} AS truth FROM m WHERE mask",
    "first_rows": f"WITH {ORDERS} SELECT o_orderkey, o_custkey, o_totalprice FROM m ORDER BY o_orderkey LIMIT 200",
    "gaps_on_top": f"WITH {ORDERS} SELECT (row_number() OVER (ORDER BY (o_totalprice IS NULL) DESC, o_orderkey))::INTEGER AS position, "
                   "o_orderkey, o_totalprice FROM (SELECT * FROM m ORDER BY o_orderkey LIMIT 200)",
    "method_comparison": COMPARISON,
    "full_report": _report(),
}
