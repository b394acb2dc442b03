"""DuckDB twins of the registered queries.

Written from the tokeniser rules (plain window functions, ``quantile_cont``,
``generate_series``), not from the Spark code, so the two sides check each
other.  The tables ``events``, ``orders``, ``lineitem`` ... are views.
"""

from __future__ import annotations

from eventide.functions.hashing import uniform_sql

# fixed values shared with the Spark side (see eventide.operators.tokens)
BLOCK = 256
H_CUT = 240
LOS_MIN_DAYS = 29
HORIZON_HOURS = 12

RAW = """
raw AS (
  SELECT user_id AS stay_id, ts AS charttime, event_id AS row_id, event_type AS item,
         CAST(value AS DOUBLE) AS value, CAST(props->>'$.k' AS INTEGER) AS k
  FROM events),
splits AS (SELECT DISTINCT stay_id, (stay_id % 10 = 0) AS testset FROM raw),
rawt AS (SELECT r.*, s.testset FROM raw r JOIN splits s USING (stay_id)),
edges AS (
  SELECT item, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
  FROM rawt WHERE NOT testset GROUP BY item),
mag AS (
  SELECT r.*, len(list_filter(d.e, lambda x: x < r.value)) AS mag
  FROM rawt r LEFT JOIN edges d USING (item)),
emitted AS (
  SELECT *, CASE
      WHEN item IN ('view', 'click') THEN ['lab.' || item, 'magnitude.' || mag]
      WHEN item = 'purchase' THEN ['med.' || item, 'unit.' || (k // 25), 'magnitude.' || mag]
      WHEN item = 'error' THEN ['culture.' || item, CASE WHEN k >= 50 THEN 'Growth' ELSE 'No Growth' END]
      ELSE ['event.' || item] END AS toks
  FROM mag),
evtok AS (
  SELECT stay_id, charttime, 1 AS kind, row_id, testset,
         unnest(toks) AS token, unnest(generate_series(0, len(toks) - 1)) AS sub
  FROM emitted),
bounds AS (
  SELECT stay_id, any_value(testset) AS testset,
         date_trunc('hour', min(charttime)) AS h0, date_trunc('hour', max(charttime)) AS h1
  FROM rawt GROUP BY stay_id),
hourtok AS (
  SELECT stay_id, b AS charttime, 0 AS kind, CAST(NULL AS BIGINT) AS row_id, testset,
         'hour.' || hour(b) AS token, 0 AS sub
  FROM (SELECT stay_id, testset, unnest(generate_series(h0 + INTERVAL 1 HOUR, h1, INTERVAL 1 HOUR)) AS b
        FROM bounds)),
stream0 AS (
  SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY charttime, kind, row_id, sub) - 1 AS pos,
         sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stay_id ORDER BY charttime, kind, row_id, sub
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hour_no
  FROM (SELECT * FROM evtok UNION ALL SELECT * FROM hourtok)),
vocab AS (
  SELECT 'Null event' AS token, 0 AS token_id
  UNION ALL
  SELECT token, CAST(row_number() OVER (ORDER BY token) AS INTEGER) AS token_id
  FROM (SELECT DISTINCT token FROM stream0 WHERE NOT testset AND token IS NOT NULL)),
stream AS (SELECT s.*, v.token_id FROM stream0 s LEFT JOIN vocab v USING (token))
"""


def with_base(body: str, *extra: str) -> str:
    parts = [RAW] + [e for e in extra if e]
    return "WITH " + ",\n".join(parts) + "\n" + body


def model_ctes(pre: str, train_filter: str) -> str:
    """Counts of the order 0-2 model over ``ctx`` rows passing the filter."""
    return f"""
{pre}tr AS (SELECT token_id, c1, c2 FROM ctx WHERE {train_filter}),
{pre}m0 AS (SELECT token_id, count(*) AS n0 FROM {pre}tr GROUP BY token_id),
{pre}m1 AS (SELECT c1, token_id, count(*) AS n1 FROM {pre}tr WHERE c1 IS NOT NULL GROUP BY c1, token_id),
{pre}m2 AS (SELECT c2, c1, token_id, count(*) AS n2 FROM {pre}tr
            WHERE c1 IS NOT NULL AND c2 IS NOT NULL GROUP BY c2, c1, token_id),
{pre}t1 AS (SELECT c1, sum(n1) AS n1c FROM {pre}m1 GROUP BY c1),
{pre}t2 AS (SELECT c2, c1, sum(n2) AS n2c FROM {pre}m2 GROUP BY c2, c1),
{pre}kn AS (SELECT (SELECT count(*) FROM {pre}tr) AS N,
                   (SELECT count(*) FROM vocab WHERE token_id > 0) AS V)"""


CTX = """
ctx AS (
  SELECT stay_id, pos, testset, coalesce(token_id, -1) AS token_id,
         lag(coalesce(token_id, -1), 1) OVER (PARTITION BY stay_id ORDER BY pos) AS c1,
         lag(coalesce(token_id, -1), 2) OVER (PARTITION BY stay_id ORDER BY pos) AS c2
  FROM stream)"""

MODEL = CTX + "," + model_ctes("", "NOT testset")


def p_expr(pre: str = "", l0=0.1, l1=0.3, l2=0.6, alpha=1.0) -> str:
    p0 = f"((coalesce({pre}m0.n0, 0) + {alpha}) / ({pre}kn.N + {alpha} * {pre}kn.V))"
    return (f"({l2} * CASE WHEN {pre}t2.n2c > 0 THEN coalesce({pre}m2.n2, 0) / {pre}t2.n2c ELSE {p0} END"
            f" + {l1} * CASE WHEN {pre}t1.n1c > 0 THEN coalesce({pre}m1.n1, 0) / {pre}t1.n1c ELSE {p0} END"
            f" + {l0} * {p0})")


def score_from(rel: str, pre: str = "") -> str:
    """FROM clause joining a request relation R(c2, c1, target_id) to the model."""
    return f"""FROM {rel} R CROSS JOIN {pre}kn
  LEFT JOIN {pre}m0 ON {pre}m0.token_id = R.target_id
  LEFT JOIN {pre}t1 ON {pre}t1.c1 = R.c1
  LEFT JOIN {pre}m1 ON {pre}m1.c1 = R.c1 AND {pre}m1.token_id = R.target_id
  LEFT JOIN {pre}t2 ON {pre}t2.c2 = R.c2 AND {pre}t2.c1 = R.c1
  LEFT JOIN {pre}m2 ON {pre}m2.c2 = R.c2 AND {pre}m2.c1 = R.c1 AND {pre}m2.token_id = R.target_id"""


def metric_ctes(rel: str, grp: list[str], pre: str) -> str:
    """AUROC by average ranks (Mann-Whitney) and AP by a descending threshold
    sweep, over a relation ``rel(grp..., s, y)``."""
    g = ", ".join(grp)
    return f"""
{pre}rk AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY s)
              + (count(*) OVER (PARTITION BY {g}, s) - 1) / 2.0 AS r FROM {rel}),
{pre}auc AS (
  SELECT {g}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
         CASE WHEN sum(y) > 0 AND sum(y) < count(*)
              THEN (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
                   / (sum(y) * (count(*) - sum(y))) END AS auroc
  FROM {pre}rk GROUP BY {g}),
{pre}dist AS (SELECT {g}, s, sum(y) AS pos, count(*) AS cnt FROM {rel} GROUP BY {g}, s),
{pre}sw AS (
  SELECT *, sum(pos) OVER (PARTITION BY {g} ORDER BY s DESC) AS tp,
         sum(cnt) OVER (PARTITION BY {g} ORDER BY s DESC) AS c,
         sum(pos) OVER (PARTITION BY {g}) AS P
  FROM {pre}dist),
{pre}ap AS (
  SELECT {g}, CASE WHEN max(P) > 0 THEN sum(pos / P * tp / c) ELSE 0.0 END AS ap
  FROM {pre}sw GROUP BY {g}),
{pre}met AS (SELECT a.*, b.ap FROM {pre}auc a JOIN {pre}ap b USING ({g}))"""


def targets_cte(name: str, targets: list[str]) -> str:
    lst = ", ".join(f"'{t}'" for t in targets)
    return f"""
{name} AS (
  SELECT token AS target, stay_id, pos, token_id,
         row_number() OVER (PARTITION BY stay_id, token ORDER BY pos) - 1 AS occ
  FROM stream WHERE testset AND token IN ({lst}))"""


def examples_cte(name: str, tgt: str) -> str:
    return f"""
{name} AS (
  SELECT t.target, t.stay_id, CAST(t.occ AS BIGINT) AS occ, t.pos, t.pos + 1 AS cut,
         n.token AS val_token, coalesce(t.token_id, -1) AS c1,
         CASE WHEN pv.pos IS NOT NULL THEN coalesce(pv.token_id, -1) END AS c2
  FROM {tgt} t JOIN stream n ON n.stay_id = t.stay_id AND n.pos = t.pos + 1
  LEFT JOIN stream pv ON pv.stay_id = t.stay_id AND pv.pos = t.pos - 1
  WHERE t.occ > 0)"""


LABS = ["lab.view", "lab.click"]
EVENT_TYPES = ["view", "click", "purchase", "error", "signup"]
MAGS = ", ".join(f"'magnitude.{i}'" for i in range(10))
GRID = [("s0", 0.1, 0.3, 0.6, 1.0), ("s1", 0.2, 0.3, 0.5, 1.0), ("s2", 0.1, 0.3, 0.6, 0.1),
        ("s3", 0.05, 0.15, 0.8, 0.5), ("s4", 0.3, 0.4, 0.3, 2.0)]


def _event_scores() -> str:
    types = ", ".join(f"('{t}')" for t in EVENT_TYPES)
    return f"""
evs AS (SELECT t.target, e.value AS s, CAST(e.event_type = t.target AS INTEGER) AS y
        FROM events e CROSS JOIN (VALUES {types}) t(target))"""


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["decile_edges"] = with_base("""
SELECT item, CAST(i - 1 AS INTEGER) AS qi, round(e[i], 6) AS edge
FROM edges, range(1, 10) t(i)""")
    q["magnitudes"] = with_base("SELECT stay_id, row_id, item, CAST(mag AS INTEGER) AS mag FROM mag")
    q["hour_spine"] = with_base("""
SELECT stay_id, CAST(hour_no AS BIGINT) AS hour_no, charttime, token FROM stream WHERE kind = 0""")
    q["vocab"] = with_base("SELECT token, CAST(token_id AS INTEGER) AS token_id FROM vocab")
    q["token_parse"] = with_base("""
SELECT token, split_part(token, '.', 1) AS family,
       TRY_CAST(string_split(token, '.')[-1] AS INTEGER) AS suffix FROM vocab""")
    q["unknown_tokens"] = with_base("""
SELECT token, count(*) AS n FROM stream
WHERE testset AND token NOT IN (SELECT token FROM stream WHERE NOT testset AND token NOT LIKE 'med.%' AND token NOT LIKE 'unit.%') GROUP BY token""")
    readable = ("CASE WHEN contains(token, '.') THEN split_part(token, '.', 1) || ': ' || substr(token, instr(token, '.') + 1) "
                "ELSE token END")
    q["token_names"] = with_base(f"SELECT token_id, {readable} AS name FROM vocab")
    q["decoded_heads"] = with_base(f"""
SELECT stay_id, pos // {BLOCK} AS b, string_agg({readable}, ' | ' ORDER BY pos) AS names
FROM stream WHERE testset AND token_id > 0 AND pos % {BLOCK} < 12 GROUP BY stay_id, pos // {BLOCK}""")
    q["token_stream"] = with_base("""
SELECT stay_id, CAST(pos AS BIGINT) AS pos, charttime, token, token_id, CAST(hour_no AS BIGINT) AS hour_no
FROM stream""")

    q["streamed_tokens"] = with_base("SELECT stay_id, charttime, row_id, CAST(sub AS INTEGER) AS sub, token FROM evtok")
    q["occurrences_per_stay"] = with_base("""
SELECT token AS target, stay_id, count(*) AS n FROM stream
WHERE testset AND token IN ('lab.view', 'lab.click', 'culture.error') GROUP BY token, stay_id""")
    tl = targets_cte("tgt", LABS)
    ex = examples_cte("ex", "tgt")
    q["lab_examples"] = with_base("""
SELECT target, stay_id, CAST(occ AS BIGINT) AS occ, pos, pos + 1 AS cut FROM tgt WHERE occ > 0""", tl)
    q["value_at_next"] = with_base("SELECT target, stay_id, occ, val_token FROM ex", tl, ex)
    q["one_hot_labels"] = with_base("""
SELECT target, stay_id, occ, CAST(c AS INTEGER) AS cls,
       CAST(val_token = 'magnitude.' || c AS INTEGER) AS y
FROM ex, range(0, 10) t(c)""", tl, ex)
    q["unexpected_labels"] = with_base(f"""
SELECT target, count(*) AS n_examples, count_if(val_token NOT IN ({MAGS})) AS n_unexpected
FROM ex GROUP BY target""", tl, ex)
    tc = targets_cte("tgtc", ["culture.error"])
    exc = examples_cte("exc", "tgtc")
    q["culture_examples"] = with_base("""
SELECT stay_id, occ, cut, val_token, CAST(val_token = 'Growth' AS INTEGER) AS y FROM exc""", tc, exc)

    ev = _event_scores()
    q["auroc_binary"] = with_base("SELECT target, n, n_pos, round(auroc, 6) AS auroc FROM emet",
                                  ev, metric_ctes("evs", ["target"], "e"))
    q["avg_precision"] = with_base("SELECT target, round(ap, 6) AS ap FROM emet",
                                   ev, metric_ctes("evs", ["target"], "e"))
    q["macro_metrics"] = with_base(f"""
SELECT round(CASE WHEN count(auroc) = {len(EVENT_TYPES)} THEN avg(auroc) END, 6) AS macro_auroc,
       round(sum(coalesce(ap, 0)) / {len(EVENT_TYPES)}, 6) AS macro_ap FROM emet""",
                                   ev, metric_ctes("evs", ["target"], "e"))

    req = f"""
req AS (SELECT ex.*, c.which, c.cls_token, coalesce(v.token_id, -1) AS target_id
        FROM ex CROSS JOIN (VALUES ('low', 'magnitude.0'), ('high', 'magnitude.9')) c(which, cls_token)
        LEFT JOIN vocab v ON v.token = c.cls_token),
sc AS (SELECT R.target, R.which, {p_expr()} AS s, CAST(R.val_token = R.cls_token AS INTEGER) AS y
       {score_from('req')})"""
    q["metric_panel"] = with_base("""
SELECT target, which || '_auroc' AS metric, round(auroc, 6) AS value FROM lmet
UNION ALL
SELECT target, which || '_ap' AS metric, round(ap, 6) AS value FROM lmet""",
                                  tl, ex, MODEL, req, metric_ctes("sc", ["target", "which"], "l"))
    reqc = f"""
reqc AS (SELECT exc.*, coalesce(v.token_id, -1) AS target_id
         FROM exc LEFT JOIN vocab v ON v.token = 'Growth'),
scc AS (SELECT R.target, {p_expr()} AS s, CAST(R.val_token = 'Growth' AS INTEGER) AS y
        {score_from('reqc')})"""
    q["culture_eval"] = with_base("""
SELECT target, n, n_pos, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM cmet""",
                                  tc, exc, MODEL, reqc, metric_ctes("scc", ["target"], "c"))

    q["ngram_counts"] = with_base("""
SELECT 0 AS "order", -1 AS c2, -1 AS c1, token_id, n0 AS n FROM m0
UNION ALL SELECT 1, -1, c1, token_id, n1 FROM m1
UNION ALL SELECT 2, c2, c1, token_id, n2 FROM m2""", MODEL)
    q["next_token_probs"] = with_base(f"""
SELECT R.c2, R.c1, R.target_id AS token_id, round({p_expr()}, 6) AS p
{score_from('treq')}""", MODEL, """
treq AS (SELECT DISTINCT c2, c1, token_id AS target_id FROM ctx WHERE testset)""")
    q["val_loss"] = with_base(f"""
SELECT count(*) AS n, round(avg(nll), 6) AS loss_mean,
       round((SELECT avg(b) FROM (SELECT avg(nll) AS b FROM ls GROUP BY rn // 64)), 6) AS loss_batch_mean
FROM ls""", MODEL, f"""
ls AS (SELECT -ln({p_expr()}) AS nll,
              row_number() OVER (ORDER BY R.stay_id, R.pos) - 1 AS rn
       {score_from('(SELECT stay_id, pos, c2, c1, token_id AS target_id FROM ctx WHERE testset)')})""")
    split = f"{uniform_sql('stay_id')} < 0.9"
    cols = ",\n".join(f"avg(-ln({p_expr('b', l0, l1, l2, a)})) AS {n}" for n, l0, l1, l2, a in GRID)
    stack = "\nUNION ALL ".join(f"SELECT {i} AS step, '{n}' AS config, {n} AS val_loss FROM vl"
                                for i, (n, *_r) in enumerate(GRID))
    q["best_smoothing"] = with_base(f"""
SELECT CAST(step AS INTEGER) AS step, config, round(val_loss, 6) AS val_loss,
       round(min(val_loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
         AS best_so_far,
       val_loss = min(val_loss) OVER () AS is_best
FROM ({stack})""", CTX, model_ctes("b", f"NOT testset AND {split}"), f"""
vl AS (SELECT {cols}
       {score_from(f'(SELECT c2, c1, token_id AS target_id FROM ctx WHERE NOT testset AND NOT ({split}))', 'b')})""")
    q["model_versions"] = f"""
SELECT step, config, val_loss, CASE WHEN better THEN CAST(sum(CAST(better AS INTEGER)) OVER (ORDER BY step) AS INTEGER) END AS version,
       better AND step = max(CASE WHEN better THEN step END) OVER () AS loaded
FROM (SELECT *, coalesce(val_loss < min(val_loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better
      FROM ({q["best_smoothing"]}))"""
    q.update(more_queries())
    q.update(last_queries())
    ce = q["culture_eval"].replace(
        "SELECT target, n, n_pos, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM cmet",
        "SELECT target, 'growth_auroc' AS metric, round(auroc, 6) AS value FROM cmet "
        "UNION ALL SELECT target, 'growth_ap', round(ap, 6) FROM cmet")
    parts = [q["metric_panel"], ce, q["dose_eval_panel"], q["handoff_eval"]]
    q["evaluation_report"] = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return q


SHIFTS = """
shifts AS (
  SELECT d.stay_id, d.shift_start, CAST(count(p.row_id) > 0 AS INTEGER) AS y
  FROM (SELECT DISTINCT stay_id, date_trunc('day', charttime) + INTERVAL 19 HOUR AS shift_start FROM raw) d
  LEFT JOIN raw p ON p.stay_id = d.stay_id AND p.item = 'purchase'
       AND p.charttime >= d.shift_start AND p.charttime < d.shift_start + INTERVAL 12 HOUR
  GROUP BY d.stay_id, d.shift_start),
stay_detail AS (
  SELECT stay_id, (epoch_us(max(charttime)) - epoch_us(min(charttime))) / 86400000000.0 AS los_days
  FROM raw GROUP BY stay_id)"""

LEX = """
lex AS (SELECT target, stay_id, CAST(occ AS BIGINT) AS occ, pos + 1 AS cut FROM tgt WHERE occ > 0)"""


def pad_text(lst: str, n: int = BLOCK) -> str:
    return f"array_to_string(list_concat(list_transform(range({n} - len({lst})), lambda x: 0), {lst}), ' ')"


def tail_list(lst: str, n: int = BLOCK) -> str:
    return f"(CASE WHEN len({lst}) > {n} THEN list_slice({lst}, len({lst}) - {n - 1}, len({lst})) ELSE {lst} END)"


TB = f"""
tbl AS (SELECT stay_id, testset, pos // {BLOCK} AS b, list(coalesce(token_id, 0) ORDER BY pos) AS l
        FROM stream GROUP BY stay_id, testset, pos // {BLOCK})"""

COHORT = f"""
coh AS (SELECT d.stay_id, d.los_days FROM splits s JOIN stay_detail d USING (stay_id)
        WHERE s.testset AND d.los_days > {LOS_MIN_DAYS}),
cuts AS (SELECT c.stay_id, t.pos AS cut_pos, t.token AS cut_token FROM coh c
         JOIN stream t ON t.stay_id = c.stay_id AND t.kind = 0 AND t.hour_no = {H_CUT}),
lastlab AS (
  SELECT c.stay_id,
         (SELECT CASE WHEN n.token LIKE 'magnitude.%' THEN TRY_CAST(split_part(n.token, '.', 2) AS INTEGER) END
          FROM stream l JOIN stream n ON n.stay_id = l.stay_id AND n.pos = l.pos + 1
          WHERE l.stay_id = c.stay_id AND l.token = 'lab.view' AND l.pos < c.cut_pos
          ORDER BY l.pos DESC LIMIT 1) AS last_mag
  FROM cuts c)"""

SHIFT_COHORT = """
scoh AS (
  SELECT s.stay_id, s.shift_start, s.y,
         (SELECT count(*) FROM stream t WHERE t.stay_id = s.stay_id AND t.charttime <= s.shift_start) AS cut
  FROM shifts s WHERE s.stay_id % 10 = 0)"""


def horizon_ctes(steps: int = 16, l0: float = 0.1, lam: float = 0.9) -> str:
    parts = ["""
ids AS (SELECT token_id AS c FROM vocab WHERE token_id > 0),
hb AS MATERIALIZED (
  SELECT i.c, (coalesce(m0.n0, 0) + 1.0) / (kn.N + 1.0 * kn.V) AS p0, coalesce(t1.n1c, 0) AS n1c
  FROM ids i CROSS JOIN kn LEFT JOIN m0 ON m0.token_id = i.c LEFT JOIN t1 ON t1.c1 = i.c
  UNION ALL SELECT -1, 0.0, 0),
g0 AS MATERIALIZED (
  SELECT c, CASE WHEN c = (SELECT token_id FROM vocab WHERE token = 'med.purchase') THEN 1.0 ELSE 0.0 END AS g
  FROM hb)"""]
    for k in range(1, steps + 1):
        parts.append(f"""
g{k} AS MATERIALIZED (
  SELECT b.c, (CASE WHEN b.n1c > 0 THEN {lam} * coalesce(sp.num, 0) / b.n1c ELSE {lam} * gg.G END)
              + {l0} * gg.G AS g
  FROM hb b
  CROSS JOIN (SELECT sum(h.p0 * x.g) AS G FROM g{k - 1} x JOIN hb h USING (c)) gg
  LEFT JOIN (SELECT m1.c1, sum(m1.n1 * x.g) AS num FROM m1 JOIN g{k - 1} x ON x.c = m1.token_id
             GROUP BY m1.c1) sp ON sp.c1 = b.c)""")
    union = " UNION ALL ".join(f"SELECT c, g FROM g{k}" for k in range(1, steps + 1))
    parts.append(f"""
hs AS (SELECT c AS c1, sum(g) / {float(steps)} AS score FROM ({union}) GROUP BY c),
hsc AS (SELECT s.stay_id, s.shift_start, s.y, hs.score FROM scoh s
        LEFT JOIN stream l ON l.stay_id = s.stay_id AND l.pos = s.cut - 1
        LEFT JOIN hs ON hs.c1 = coalesce(l.token_id, -1))""")
    return ",".join(parts)


HORIZON_STEPS = 150


def hour_horizon_ctes(hours: int = HORIZON_HOURS, steps: int = HORIZON_STEPS, l0: float = 0.1, lam: float = 0.9) -> str:
    """Value iteration over (token, hours left) by a recursive query, for a fixed
    number of steps by which hardly any mass is left.  ``hd`` is the dense
    table of P(t | c), also for a start without a token (-1)."""
    return f"""
hk AS (SELECT token_id AS t, CAST(token LIKE 'hour.%' AS INTEGER) AS hr, CAST(token = 'med.purchase' AS INTEGER) AS tgt
       FROM vocab WHERE token_id > 0),
hp AS (SELECT hk.*, (coalesce(m0.n0, 0) + 1.0) / (kn.N + 1.0 * kn.V) AS p0 FROM hk CROSS JOIN kn LEFT JOIN m0 ON m0.token_id = hk.t),
hd AS MATERIALIZED (
  SELECT b.t AS c, hp.t, hp.hr, hp.tgt,
         CASE WHEN t1.n1c > 0 THEN {lam} * coalesce(m1.n1, 0) / t1.n1c + {l0} * hp.p0 ELSE hp.p0 * {l0 + lam} END AS p
  FROM (SELECT t FROM hk UNION ALL SELECT -1) b CROSS JOIN hp LEFT JOIN t1 ON t1.c1 = b.t AND b.t > 0
  LEFT JOIN m1 ON m1.c1 = b.t AND m1.token_id = hp.t AND b.t > 0),
hv AS (
  SELECT 0 AS k, c, CAST(h AS INTEGER) AS h, 0.0::DOUBLE AS e, 0.0::DOUBLE AS f, 0.0::DOUBLE AS l
  FROM (SELECT DISTINCT c FROM hd) CROSS JOIN range(0, {hours + 1}) r(h)
  UNION ALL
  (SELECT v.k + 1, hd.c, v.h + hd.hr, sum(hd.p * (hd.tgt + v.e)), sum(hd.p * CASE WHEN hd.tgt = 1 THEN 1.0 ELSE v.f END), sum(hd.p * (1.0 + v.l))
   FROM hv v JOIN hd ON hd.t = v.c WHERE v.k < {steps} AND v.h + hd.hr BETWEEN 1 AND {hours} GROUP BY v.k, hd.c, v.h + hd.hr
   UNION ALL SELECT k + 1, c, 0, 0.0, 0.0, 0.0 FROM hv WHERE h = 0 AND k < {steps})),
hh AS (SELECT s.stay_id, s.shift_start, s.y, v.e, v.f, v.l FROM scoh s
       LEFT JOIN stream l ON l.stay_id = s.stay_id AND l.pos = s.cut - 1
       JOIN hv v ON v.c = coalesce(l.token_id, -1) AND v.h = {hours} AND v.k = {steps})"""


HALF_LIFE, MEMORY_WEIGHT = 64.0, 0.2
# each lab example against the whole vocabulary, with decayed counts of its whole history
MEMORY = f"""
mreq AS (SELECT ex.target, ex.stay_id, ex.occ, ex.cut, ex.c1, ex.c2, coalesce(v.token_id, -1) AS target_id
         FROM ex LEFT JOIN vocab v ON v.token = ex.val_token),
mbag AS (SELECT e.target, e.stay_id, e.occ, t.token_id, sum(pow(2.0, -(e.cut - 1 - t.pos) / {HALF_LIFE})) AS b
         FROM mreq e JOIN stream t ON t.stay_id = e.stay_id AND t.pos < e.cut AND t.token_id > 0
         GROUP BY e.target, e.stay_id, e.occ, t.token_id),
mall AS (SELECT e.target, e.stay_id, e.occ, e.c1, e.c2, e.target_id AS own, v.token_id AS target_id
         FROM mreq e CROSS JOIN (SELECT token_id FROM vocab WHERE token_id > 0) v),
mp AS (SELECT R.target, R.stay_id, R.occ, R.own, R.target_id AS t, @P@ AS p @FROM@),
mz AS (SELECT mp.target, mp.stay_id, mp.occ, sum(pow(p, {1 - MEMORY_WEIGHT}) * pow(coalesce(b, 0) + 1.0, {MEMORY_WEIGHT})) AS z
       FROM mp LEFT JOIN mbag m ON m.target = mp.target AND m.stay_id = mp.stay_id AND m.occ = mp.occ AND m.token_id = mp.t
       GROUP BY mp.target, mp.stay_id, mp.occ),
ms AS (SELECT R.target, R.stay_id, R.occ, @P@ AS p_plain,
              pow(@P@, {1 - MEMORY_WEIGHT}) * pow(coalesce(b, 0) + 1.0, {MEMORY_WEIGHT}) / z AS p_memory
       @FROM2@ JOIN mz ON mz.target = R.target AND mz.stay_id = R.stay_id AND mz.occ = R.occ
       LEFT JOIN mbag m ON m.target = R.target AND m.stay_id = R.stay_id AND m.occ = R.occ AND m.token_id = R.target_id)"""


def memory_ctes() -> str:
    return MEMORY.replace("@FROM@", score_from("mall")).replace("@FROM2@", score_from("mreq")).replace("@P@", p_expr())


def panel_ctes(panel: list[str]) -> str:
    """Eleven outcomes a step for every stay (not shared between stays)."""
    nh = "'hour.' || ((CAST(split_part(c.cut_token, '.', 2) AS INTEGER) + 1) % 24)"
    parts = [f"""
fw0 AS (SELECT c.stay_id, coalesce(v.token_id, 0) AS c2, 1.0 AS a FROM cuts c LEFT JOIN vocab v ON v.token = {nh})"""]
    for i, lab in enumerate(panel):
        parts.append(f"""
fq{i} AS (SELECT s.stay_id, s.a, k, s.c2, coalesce(lv.token_id, 0) AS c1, coalesce(mv.token_id, 0) AS target_id
          FROM fw{i} s CROSS JOIN range(0, 10) r(k)
          LEFT JOIN vocab lv ON lv.token = '{lab}' LEFT JOIN vocab mv ON mv.token = 'magnitude.' || k),
fs{i} AS MATERIALIZED (SELECT R.stay_id, R.k, R.c1, R.target_id, sum(R.a * {p_expr()}) AS a {score_from(f'fq{i}')}
          GROUP BY R.stay_id, R.k, R.c1, R.target_id),
fa{i} AS MATERIALIZED (SELECT stay_id, c1, sum(a) AS mass, sum(k * a) / sum(a) AS e FROM fs{i} GROUP BY stay_id, c1),
fw{i + 1} AS MATERIALIZED (SELECT stay_id, target_id AS c2, a FROM fs{i} UNION ALL SELECT stay_id, c1, 1 - mass FROM fa{i})""")
    return ",".join(parts)


RULES = """
rules AS (SELECT * FROM (VALUES
    (0, 'med.purchase', 'unit.0', 'lab.view', 9, 9), (1, 'med.purchase', 'unit.1', 'lab.view', 0, 0),
    (2, 'med.purchase', 'unit.2', 'lab.click', 8, 9), (3, 'med.purchase', 'unit.3', 'lab.click', 0, 1),
    (4, 'med.purchase', NULL, 'lab.view', 4, 4), (5, 'culture.error', NULL, 'lab.click', 9, 9))
  r(rule, drug, unit, lab, low, high)),
given AS (SELECT l.stay_id, l.pos, l.token AS lab, TRY_CAST(split_part(n.token, '.', 2) AS INTEGER) AS v
          FROM stream l JOIN stream n ON n.stay_id = l.stay_id AND n.pos = l.pos + 1
          WHERE l.token LIKE 'lab.%' AND n.token LIKE 'magnitude.%'),
asked AS (SELECT s.stay_id, s.pos, s.token AS drug, u.token AS unit FROM stream s
          LEFT JOIN stream u ON u.stay_id = s.stay_id AND u.pos = s.pos + 1 WHERE s.token IN ('med.purchase', 'culture.error')),
latest AS (SELECT a.stay_id, a.pos, a.drug, a.unit, g.lab, arg_max(g.v, g.pos) AS state
           FROM asked a JOIN given g ON g.stay_id = a.stay_id AND g.pos < a.pos GROUP BY a.stay_id, a.pos, a.drug, a.unit, g.lab)"""

EM_ROUNDS = 200


def more_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["horizon_hours"] = with_base("""
SELECT stay_id, shift_start, round(e, 6) AS expected, round(f, 6) AS first_passage, round(l, 6) AS n_tokens, TRUE AS ended
FROM hh""", SHIFTS, SHIFT_COHORT, MODEL, hour_horizon_ctes()).replace("WITH ", "WITH RECURSIVE ", 1)
    tl = targets_cte("tgt", LABS)
    ex = examples_cte("ex", "tgt")
    q["memory_scores"] = with_base("""
SELECT target, stay_id, occ, round(p_plain, 6) AS p_plain, round(p_memory, 6) AS p_memory FROM ms""", tl, ex, MODEL, memory_ctes())
    q["memory_loss"] = with_base("""
SELECT 'plain' AS model, count(*) AS n, round(avg(-ln(p_plain)), 6) AS loss FROM ms
UNION ALL SELECT 'memory', count(*), round(avg(-ln(p_memory)), 6) FROM ms""", tl, ex, MODEL, memory_ctes())
    split = f"{uniform_sql('stay_id')} < 0.9"
    parts = p_expr("b", 1.0, 0.0, 0.0), p_expr("b", 0.0, 1.0, 0.0), p_expr("b", 0.0, 0.0, 1.0)
    q["interpolation_weights"] = with_base(f"""
SELECT CAST(r AS INTEGER) AS round, round(a, 6) AS l0, round(b, 6) AS l1, round(c, 6) AS l2, round(loss, 6) AS loss
FROM (SELECT *, lag(loss) OVER (ORDER BY r) - loss AS fell FROM em)
QUALIFY coalesce(count(CASE WHEN fell < 1e-6 THEN 1 END) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0""",
        CTX, model_ctes("b", f"NOT testset AND {split}"), f"""
hv AS MATERIALIZED (SELECT {parts[0]} AS p0, {parts[1]} AS p1, {parts[2]} AS p2, count(*) AS k
  {score_from(f'(SELECT c2, c1, token_id AS target_id FROM ctx WHERE NOT testset AND NOT ({split}))', 'b')} GROUP BY ALL),
emw AS (SELECT 0 AS r, [1 / 3.0, 1 / 3.0, 1 / 3.0]::DOUBLE[] AS w UNION ALL
  SELECT r, [x / n, y / n, z / n] FROM (
    SELECT e.r + 1 AS r, sum(k) AS n, sum(k * w[1] * p0 / (w[1] * p0 + w[2] * p1 + w[3] * p2)) AS x,
           sum(k * w[2] * p1 / (w[1] * p0 + w[2] * p1 + w[3] * p2)) AS y, sum(k * w[3] * p2 / (w[1] * p0 + w[2] * p1 + w[3] * p2)) AS z
    FROM emw e, hv WHERE e.r < {EM_ROUNDS - 1} GROUP BY e.r)),
em AS (SELECT r, w[1] AS a, w[2] AS b, w[3] AS c, (SELECT sum(-ln(w[1] * p0 + w[2] * p1 + w[3] * p2) * k) / sum(k) FROM hv) AS loss FROM emw)""")
    q["interpolation_weights"] = q["interpolation_weights"].replace("WITH ", "WITH RECURSIVE ", 1)
    panel = ["lab.click", "lab.view", "lab.view", "lab.click", "lab.click", "lab.view", "lab.click", "lab.view"]
    q["panel_forward"] = with_base(" UNION ALL ".join(f"""
SELECT stay_id, CAST({i} AS INTEGER) AS step, '{lab}' AS lab, round(mass, 6) AS mag_mass, round(e, 6) AS exp_mag, round(1 - mass, 6) AS none_mass
FROM fa{i}""" for i, lab in enumerate(panel)), SHIFTS, COHORT, MODEL, panel_ctes(panel))
    cells = ", ".join(f"CAST(count(CASE WHEN dd.decile = {k} THEN 1 END) AS BIGINT) AS d{k}" for k in range(10))
    q["dose_table"] = with_base(f"""
SELECT c.stay_id, u.unit, {cells} FROM cuts c CROSS JOIN (SELECT DISTINCT token AS unit FROM stream WHERE token LIKE 'unit.%') u
LEFT JOIN dd ON dd.stay_id = c.stay_id AND dd.unit = u.unit GROUP BY c.stay_id, u.unit""", SHIFTS, COHORT, """
dd AS (
  SELECT c.stay_id, u.token AS unit, TRY_CAST(split_part(m.token, '.', 2) AS INTEGER) AS decile
  FROM cuts c JOIN stream s ON s.stay_id = c.stay_id AND s.token = 'med.purchase' AND s.pos < c.cut_pos
  JOIN stream u ON u.stay_id = s.stay_id AND u.pos = s.pos + 1
  JOIN stream m ON m.stay_id = s.stay_id AND m.pos = s.pos + 2
  WHERE m.token LIKE 'magnitude.%')""")
    q["forbidden_positions"] = with_base("""
SELECT a.stay_id, a.pos, CAST(r.rule AS INTEGER) AS rule, a.drug, a.lab, CAST(a.state AS INTEGER) AS state
FROM latest a JOIN rules r ON r.drug = a.drug AND r.lab = a.lab AND (r.unit IS NULL OR r.unit = a.unit) AND a.state BETWEEN r.low AND r.high""",
                                         RULES)
    q["vocab_refit"] = with_base("""
SELECT token, CAST(token_id AS INTEGER) AS token_id, FALSE AS is_new FROM v1
UNION ALL SELECT token, CAST((SELECT max(token_id) FROM v1) + row_number() OVER (ORDER BY token) AS INTEGER), TRUE
FROM vocab WHERE token NOT IN (SELECT token FROM v1)""", """
v1 AS (SELECT 'Null event' AS token, 0 AS token_id UNION ALL
       SELECT token, row_number() OVER (ORDER BY token) FROM vocab
       WHERE token_id > 0 AND split_part(token, '.', 1) NOT IN ('med', 'unit'))""")
    q["decile_sketches"] = with_base("""
SELECT e.item, CAST(i - 1 AS INTEGER) AS qi, n, round(e[i], 6) AS edge, TRUE AS in_bound
FROM edges e JOIN (SELECT item, count(value) AS n FROM rawt WHERE NOT testset GROUP BY item) USING (item), range(1, 10) t(i)""")
    tl = targets_cte("tgt", LABS)
    q["asof_cut"] = with_base("""
SELECT s.stay_id, s.shift_start,
       (SELECT count(*) FROM stream t WHERE t.stay_id = s.stay_id AND t.charttime <= s.shift_start) AS cut
FROM shifts s""", SHIFTS)
    q["tail_block"] = with_base(f"""
SELECT e.target, e.stay_id, e.occ, t.pos - (e.cut - {BLOCK}) AS i, coalesce(t.token_id, 0) AS token_id
FROM lex e JOIN stream t ON t.stay_id = e.stay_id AND t.pos >= e.cut - {BLOCK} AND t.pos < e.cut""", tl, LEX)
    q["padded_block"] = with_base(f"""
SELECT target, stay_id, occ, {pad_text('l')} AS block FROM (
  SELECT e.target, e.stay_id, e.occ, list(coalesce(t.token_id, 0) ORDER BY t.pos) AS l
  FROM lex e JOIN stream t ON t.stay_id = e.stay_id AND t.pos >= e.cut - {BLOCK} AND t.pos < e.cut
  GROUP BY e.target, e.stay_id, e.occ)""", tl, LEX)
    q["history_bag"] = with_base(f"""
SELECT e.target, e.stay_id, e.occ, coalesce(t.token_id, 0) AS token_id, count(*) AS n
FROM lex e JOIN stream t ON t.stay_id = e.stay_id AND t.pos < e.cut - {BLOCK}
GROUP BY e.target, e.stay_id, e.occ, coalesce(t.token_id, 0)""", tl, LEX)
    q["training_blocks"] = with_base(f"SELECT stay_id, b, {pad_text('l')} AS x FROM tbl", TB)
    q["next_token_labels"] = with_base(f"""
SELECT tb.stay_id, tb.b, {pad_text('tb.l')} || ' ' || coalesce(n.token_id, 0) AS y,
       CAST({BLOCK + 1} AS INTEGER) AS n_labels
FROM tbl tb LEFT JOIN stream n ON n.stay_id = tb.stay_id AND n.pos = (tb.b + 1) * {BLOCK}""", TB)
    q["train_val_split"] = with_base(f"""
SELECT stay_id, b,
       CASE WHEN {uniform_sql('stay_id', 'b')} < 0.9 THEN 'train' ELSE 'val' END AS by_example,
       CASE WHEN {uniform_sql('stay_id')} < 0.9 THEN 'train' ELSE 'val' END AS by_stay
FROM (SELECT DISTINCT stay_id, pos // {BLOCK} AS b FROM stream WHERE NOT testset)""")
    head = "array_to_string(list_slice(list_filter(l, lambda v: v != 0), 1, 12), ' ')"
    q["head_nonpad"] = with_base(f"SELECT stay_id, b, {head} AS head FROM tbl WHERE testset", TB)
    q["draw_example"] = with_base(f"""
SELECT stay_id, b, {head} AS head FROM tbl WHERE testset
ORDER BY {uniform_sql('stay_id', 'b')}, stay_id, b LIMIT 1""", TB)
    inj = """
inj AS (SELECT list(coalesce(v.token_id, 0) ORDER BY x.k) AS a
        FROM (VALUES (0, 'med.purchase'), (1, 'unit.3'), (2, 'magnitude.9')) x(k, tok)
        LEFT JOIN vocab v ON v.token = x.tok)"""
    q["append_block"] = with_base(f"""
SELECT target, stay_id, occ, {pad_text(tail_list('z'))} AS block FROM (
  SELECT e.target, e.stay_id, e.occ,
         list_concat(list(coalesce(t.token_id, 0) ORDER BY t.pos), any_value(inj.a)) AS z
  FROM lex e JOIN stream t ON t.stay_id = e.stay_id AND t.pos >= e.cut - {BLOCK} AND t.pos < e.cut
  CROSS JOIN inj
  GROUP BY e.target, e.stay_id, e.occ)""", tl, LEX, inj)

    dex = """
dex AS (
  SELECT e.stay_id, e.row_id, e.charttime,
         (SELECT max(d.pos) FROM stream d WHERE d.stay_id = e.stay_id AND d.charttime <= e.charttime
            AND d.token = 'med.purchase') AS last_pos
  FROM stream e WHERE e.testset AND e.token = 'med.purchase'),
dex2 AS (
  SELECT x.*, u.token AS unit_token, coalesce(u.token_id, -1) AS unit_id,
         TRY_CAST(string_split(m.token, '.')[-1] AS INTEGER) AS dose
  FROM dex x JOIN stream u ON u.stay_id = x.stay_id AND u.pos = x.last_pos + 1
  JOIN stream m ON m.stay_id = x.stay_id AND m.pos = x.last_pos + 2
  WHERE m.token LIKE 'magnitude.%')"""
    q["dose_examples"] = with_base("""
SELECT stay_id, row_id, charttime, last_pos, unit_token, dose FROM dex2""", dex)
    q["dose_prompt"] = with_base(f"""
SELECT stay_id, row_id, {pad_text('l')} AS prompt, dose FROM (
  SELECT x.stay_id, x.row_id, x.dose, list(coalesce(t.token_id, 0) ORDER BY t.pos) AS l
  FROM dex2 x JOIN stream t ON t.stay_id = x.stay_id AND t.pos >= x.last_pos + 2 - {BLOCK}
       AND t.pos < x.last_pos + 2
  GROUP BY x.stay_id, x.row_id, x.dose)""", dex)
    dsc = f"""
dreq AS (
  SELECT x.*, k AS cls, coalesce(dv.token_id, -1) AS c2, x.unit_id AS c1,
         coalesce(mv.token_id, -1) AS target_id
  FROM dex2 x CROSS JOIN range(0, 10) r(k)
  LEFT JOIN vocab dv ON dv.token = 'med.purchase'
  LEFT JOIN vocab mv ON mv.token = 'magnitude.' || k),
dsc AS (SELECT R.cls, {p_expr()} AS s, CAST(R.dose = R.cls AS INTEGER) AS y {score_from('dreq')})"""
    q["dose_eval_panel"] = with_base("""
SELECT 'med.purchase' AS target, 'overall_auroc' AS metric,
       round(CASE WHEN count(auroc) = 10 THEN avg(auroc) END, 6) AS value FROM dmet
UNION ALL SELECT 'med.purchase', 'overall_ap', round(sum(coalesce(ap, 0)) / 10, 6) FROM dmet
UNION ALL SELECT 'med.purchase', 'top_auroc', round(auroc, 6) FROM dmet WHERE cls = 9
UNION ALL SELECT 'med.purchase', 'top_ap', round(ap, 6) FROM dmet WHERE cls = 9""",
                                     dex, MODEL, dsc, metric_ctes("dsc", ["cls"], "d"))

    q["los_cohort"] = with_base("SELECT stay_id, round(los_days, 6) AS los_days FROM coh", SHIFTS, COHORT)
    q["first_n_hours"] = with_base("SELECT stay_id, cut_pos, cut_token FROM cuts", SHIFTS, COHORT)
    q["last_lab_before_cut"] = with_base("SELECT stay_id, last_mag FROM lastlab", SHIFTS, COHORT)
    q["dropped_examples"] = with_base("""
SELECT e.target, count(*) AS n_examples, count(*) FILTER (n.token IS NULL) AS n_dropped
FROM lex e LEFT JOIN stream n ON n.stay_id = e.stay_id AND n.pos = e.cut GROUP BY e.target
UNION ALL
SELECT 'first_n_hours', count(*), count(*) FILTER (u.stay_id IS NULL) FROM coh c LEFT JOIN cuts u USING (stay_id)""",
                                      SHIFTS, COHORT, tl, LEX)
    q["dose_histogram"] = with_base("""
SELECT stay_id, unit, CAST(decile AS INTEGER) AS decile, count(*) AS n FROM dd
GROUP BY stay_id, unit, decile""", SHIFTS, COHORT, """
dd AS (
  SELECT c.stay_id, u.token AS unit, TRY_CAST(split_part(m.token, '.', 2) AS INTEGER) AS decile
  FROM cuts c JOIN stream s ON s.stay_id = c.stay_id AND s.token = 'med.purchase' AND s.pos < c.cut_pos
  JOIN stream u ON u.stay_id = s.stay_id AND u.pos = s.pos + 1
  JOIN stream m ON m.stay_id = s.stay_id AND m.pos = s.pos + 2
  WHERE m.token LIKE 'magnitude.%')""")
    nh = "'hour.' || ((CAST(split_part(c.cut_token, '.', 2) AS INTEGER) + 1) % 24)"
    q["counterfactual_prompt"] = with_base(f"""
SELECT stay_id, array_to_string({tail_list('z')}, ' ') AS prompt FROM (
  SELECT cf.stay_id, list_concat(cf.l, ij.a) AS z FROM cf JOIN ij USING (stay_id))""", SHIFTS, COHORT, f"""
cf AS (SELECT c.stay_id, list(coalesce(t.token_id, 0) ORDER BY t.pos) AS l FROM cuts c
       JOIN stream t ON t.stay_id = c.stay_id AND t.pos > c.cut_pos - {BLOCK} AND t.pos <= c.cut_pos
       GROUP BY c.stay_id),
ij AS (SELECT c.stay_id, list(coalesce(v.token_id, 0) ORDER BY x.k) AS a
       FROM cuts c CROSS JOIN (VALUES (0, 'med.purchase'), (1, 'unit.3'), (2, 'magnitude.9'), (3, NULL)) x(k, tok)
       LEFT JOIN vocab v ON v.token = coalesce(x.tok, {nh})
       GROUP BY c.stay_id)""")
    probe = [f"""
pr0 AS (SELECT c.stay_id, coalesce(v.token_id, 0) AS c2 FROM cuts c LEFT JOIN vocab v ON v.token = {nh})"""]
    for i, lab in enumerate(["lab.click", "lab.view"]):
        probe.append(f"""
rq{i} AS (SELECT s.stay_id, '{lab}' AS lab, k, s.c2, coalesce(lv.token_id, 0) AS c1,
                 coalesce(mv.token_id, 0) AS target_id
          FROM pr{i} s CROSS JOIN range(0, 10) r(k)
          LEFT JOIN vocab lv ON lv.token = '{lab}' LEFT JOIN vocab mv ON mv.token = 'magnitude.' || k),
sc{i} AS (SELECT R.stay_id, R.lab, R.k, {p_expr()} AS p {score_from(f'rq{i}')}),
ag{i} AS (SELECT stay_id, lab, sum(p) AS mag_mass, sum(k * p) / sum(p) AS exp_mag,
                 (list(k ORDER BY p DESC, k ASC))[1] AS argmax_mag
          FROM sc{i} GROUP BY stay_id, lab),
pr{i + 1} AS (SELECT a.stay_id, coalesce(v.token_id, 0) AS c2 FROM ag{i} a
              LEFT JOIN vocab v ON v.token = 'magnitude.' || a.argmax_mag)""")
    q["panel_probe"] = with_base("""
SELECT stay_id, lab, round(mag_mass, 6) AS mag_mass, round(exp_mag, 6) AS exp_mag,
       CAST(argmax_mag AS INTEGER) AS argmax_mag FROM ag0
UNION ALL
SELECT stay_id, lab, round(mag_mass, 6), round(exp_mag, 6), CAST(argmax_mag AS INTEGER) FROM ag1""",
                                 SHIFTS, COHORT, MODEL, ",".join(probe))
    mm = """
lr AS (SELECT l.stay_id, l.pos, l.token AS item, TRY_CAST(split_part(n.token, '.', 2) AS INTEGER) AS mag,
              CAST(NULL AS INTEGER) AS dose
       FROM stream l JOIN stream n ON n.stay_id = l.stay_id AND n.pos = l.pos + 1
       WHERE NOT l.testset AND l.token LIKE 'lab.%' AND n.token LIKE 'magnitude.%'),
dr AS (SELECT d.stay_id, d.pos, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS INTEGER) AS mag,
              TRY_CAST(split_part(m.token, '.', 2) AS INTEGER) AS dose
       FROM stream d JOIN stream m ON m.stay_id = d.stay_id AND m.pos = d.pos + 2
       WHERE NOT d.testset AND d.token LIKE 'med.%' AND m.token LIKE 'magnitude.%'),
uw AS (SELECT *, last_value(dose IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_dose
       FROM (SELECT * FROM lr UNION ALL SELECT * FROM dr)),
uw2 AS (SELECT *, lag(mag) OVER (PARTITION BY stay_id, item ORDER BY pos) AS prev_mag
        FROM uw WHERE item IS NOT NULL),
mmod AS (SELECT item, prev_mag, last_dose AS dose, mag, count(*) AS n FROM uw2
         GROUP BY item, prev_mag, last_dose, mag)"""
    q["magnitude_model"] = with_base("""
SELECT item, CAST(prev_mag AS INTEGER) AS prev_mag, CAST(dose AS INTEGER) AS dose,
       CAST(mag AS INTEGER) AS mag, n FROM mmod""", mm)
    q["magnitude_probs"] = with_base("""
SELECT w.item, CAST(w.prev_mag AS INTEGER) AS prev_mag, CAST(w.dose AS INTEGER) AS dose, CAST(k AS INTEGER) AS mag,
       round((coalesce(o.n, 0) + 10.0 * (coalesce(l.n, 0) + 1.0) / (bt.n + 10.0)) / (w.n + 10.0), 6) AS p
FROM (SELECT item, prev_mag, dose, sum(n) AS n FROM mmod GROUP BY item, prev_mag, dose) w
CROSS JOIN range(0, 10) r(k)
JOIN (SELECT item, dose, sum(n) AS n FROM mmod GROUP BY item, dose) bt ON bt.item = w.item AND bt.dose IS NOT DISTINCT FROM w.dose
LEFT JOIN mmod o ON o.item = w.item AND o.prev_mag IS NOT DISTINCT FROM w.prev_mag AND o.dose IS NOT DISTINCT FROM w.dose AND o.mag = k
LEFT JOIN (SELECT item, dose, mag, sum(n) AS n FROM mmod GROUP BY item, dose, mag) l
  ON l.item = w.item AND l.dose IS NOT DISTINCT FROM w.dose AND l.mag = k""", mm)
    q["pre_post_delta"] = with_base("""
SELECT count(*) AS n, count(pre) AS n_pre, count(post) AS n_post, count(post - pre) AS n_pairs,
       round(avg(pre), 6) AS avg_pre, round(avg(post), 6) AS avg_post, round(avg(post - pre), 6) AS avg_delta
FROM pp""", SHIFTS, COHORT, mm, """
mmv AS (SELECT * FROM mmod WHERE item = 'lab.view' AND dose = 9),
tot AS (SELECT coalesce(sum(mag * n), 0) AS bs, coalesce(sum(n), 0) AS bw FROM mmv),
pre AS (SELECT stay_id, CAST(last_mag AS DOUBLE) AS pre FROM lastlab),
pp AS (SELECT p.stay_id, any_value(p.pre) AS pre,
              CASE WHEN sum(m.n) > 0 THEN (sum(m.mag * m.n) + 45.0) / (sum(m.n) + 10.0)
                   ELSE (any_value(tot.bs) + 45.0) / (any_value(tot.bw) + 10.0) END AS post
       FROM pre p CROSS JOIN tot LEFT JOIN mmv m ON m.prev_mag = p.pre
       GROUP BY p.stay_id)""")

    q["shift_labels"] = with_base("SELECT stay_id, shift_start, y FROM shifts", SHIFTS)
    q["shift_cohort"] = with_base("SELECT stay_id, shift_start, y, cut FROM scoh ORDER BY stay_id, shift_start LIMIT 1000", SHIFTS, SHIFT_COHORT)
    q["no_prior_event"] = with_base("""
SELECT s.stay_id, s.shift_start FROM shifts s JOIN splits sp USING (stay_id) JOIN stay_detail d USING (stay_id)
WHERE sp.testset AND d.los_days > 1 AND NOT EXISTS (
  SELECT 1 FROM raw r WHERE r.stay_id = s.stay_id AND r.item = 'error' AND r.charttime < s.shift_start)""",
                                    SHIFTS)
    context = f"""
sctx AS (SELECT s.stay_id, s.shift_start, s.y, s.cut, {pad_text('coalesce(l, []::INTEGER[])')} AS block FROM (
  SELECT s.stay_id, s.shift_start, any_value(s.y) AS y, any_value(s.cut) AS cut,
         list(coalesce(t.token_id, 0) ORDER BY t.pos) FILTER (t.pos IS NOT NULL) AS l
  FROM scoh s LEFT JOIN stream t ON t.stay_id = s.stay_id AND t.pos >= s.cut - {BLOCK} AND t.pos < s.cut
  GROUP BY s.stay_id, s.shift_start) s)"""
    q["shift_context"] = with_base("SELECT stay_id, shift_start, y, cut, block FROM sctx", SHIFTS, SHIFT_COHORT, context)
    q["first_time_shifts"] = with_base("""
SELECT x.stay_id, x.shift_start, x.y, x.cut, x.block FROM sctx x JOIN stay_detail d USING (stay_id)
WHERE d.los_days > 1 AND NOT EXISTS (
  SELECT 1 FROM raw r WHERE r.stay_id = x.stay_id AND r.item = 'error' AND r.charttime < x.shift_start)""",
                                       SHIFTS, SHIFT_COHORT, context)
    q["horizon_score"] = with_base("SELECT stay_id, shift_start, round(score, 6) AS score FROM hsc",
                                   SHIFTS, SHIFT_COHORT, MODEL, horizon_ctes())
    q["hour_horizon"] = with_base("""
SELECT c.stay_id, c.shift_start, count(t.pos) AS n_tokens, count(CASE WHEN t.token = 'med.purchase' THEN 1 END) AS n_target
FROM scoh c LEFT JOIN stream h ON h.stay_id = c.stay_id AND h.pos = c.cut - 1
LEFT JOIN stream t ON t.stay_id = c.stay_id AND t.pos >= c.cut AND t.hour_no <= coalesce(h.hour_no, 0) + 12
GROUP BY c.stay_id, c.shift_start""", SHIFTS, SHIFT_COHORT)
    q["handoff_eval"] = with_base("""
SELECT 'handoff' AS target, 'auroc' AS metric, round(auroc, 6) AS value FROM hmet
UNION ALL SELECT 'handoff', 'ap', round(ap, 6) FROM hmet""", SHIFTS, SHIFT_COHORT, MODEL, hour_horizon_ctes(),
                                  """
hsel AS (SELECT 'handoff' AS t, e / l AS s, y FROM hh)""",
                                  metric_ctes("hsel", ["t"], "h")).replace("WITH ", "WITH RECURSIVE ", 1)
    return q


LI_ORDER = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
            "l_discount, l_tax, l_returnflag, l_linestatus")
LI_NULLS = ", ".join(f"NULL AS {c.strip()}" for c in LI_ORDER.split(","))

LRAW = f"""
lraw AS (SELECT o.o_custkey AS stay_id, l.l_shipdate AS charttime, l.l_returnflag AS item,
                CAST(l.l_quantity AS DOUBLE) AS value, {", ".join("l." + c.strip() for c in LI_ORDER.split(","))}
         FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
lspl AS (SELECT DISTINCT stay_id, (stay_id % 10 = 0) AS testset FROM lraw),
lrt AS (SELECT r.*, s.testset FROM lraw r JOIN lspl s USING (stay_id)),
ledges AS (SELECT item, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
           FROM lrt WHERE NOT testset GROUP BY item),
lmag AS (SELECT r.*, len(list_filter(d.e, lambda x: x < r.value)) AS mag FROM lrt r LEFT JOIN ledges d USING (item)),
levtok AS (SELECT stay_id, charttime, 1 AS kind, {LI_ORDER}, testset,
                  unnest(['lab.' || item, 'magnitude.' || mag]) AS token, unnest([0, 1]) AS sub FROM lmag),
lbounds AS (SELECT stay_id, any_value(testset) AS testset, date_trunc('day', min(charttime)) AS d0,
                   date_trunc('day', max(charttime)) AS d1 FROM lrt GROUP BY stay_id),
lday AS (SELECT stay_id, b AS charttime, 0 AS kind, {LI_NULLS}, testset,
                'day.' || (isodow(b) - 1) AS token, 0 AS sub
         FROM (SELECT stay_id, testset, unnest(generate_series(d0 + INTERVAL 1 DAY, d1, INTERVAL 1 DAY)) AS b
               FROM lbounds)),
lstream0 AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY charttime, kind, {LI_ORDER}, sub) - 1 AS pos
             FROM (SELECT * FROM levtok UNION ALL SELECT * FROM lday)),
lvocab AS (SELECT 'Null event' AS token, 0 AS token_id UNION ALL
           SELECT token, CAST(row_number() OVER (ORDER BY token) AS INTEGER)
           FROM (SELECT DISTINCT token FROM lstream0 WHERE NOT testset AND token IS NOT NULL)),
lstream AS (SELECT s.*, v.token_id FROM lstream0 s LEFT JOIN lvocab v USING (token))"""

CI = """
labv AS (SELECT l.stay_id, l.pos,
                CASE WHEN n.token LIKE 'magnitude.%' THEN TRY_CAST(split_part(n.token, '.', 2) AS INTEGER) END AS v
         FROM stream l LEFT JOIN stream n ON n.stay_id = l.stay_id AND n.pos = l.pos + 1
         WHERE l.token = 'lab.view'),
drg AS (SELECT stay_id, pos, CAST(NULL AS INTEGER) AS v FROM stream WHERE token = 'med.purchase'),
lst AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state
        FROM (SELECT * FROM labv UNION ALL SELECT * FROM drg)),
ci AS (SELECT s.stay_id, s.pos, 'med.purchase' AS drug, s.state FROM lst s JOIN drg d USING (stay_id, pos)
       WHERE s.state >= 8)"""


def insert_sql(anchors: str, replace: str | None = None) -> str:
    """Stream with an 'error' token after every anchor (stay_id, pos)."""
    tok = "s.token" if replace is None else f"CASE WHEN r.pos IS NOT NULL THEN '{replace}' ELSE s.token END"
    rj = "" if replace is None else "LEFT JOIN anc r ON r.stay_id = s.stay_id AND r.pos = s.pos"
    return f"""
anc AS (SELECT DISTINCT stay_id, pos FROM {anchors}),
ancr AS (SELECT stay_id, pos, row_number() OVER (PARTITION BY stay_id ORDER BY pos) - 1 AS k FROM anc),
aug AS (
  SELECT s.stay_id, s.pos + (SELECT count(*) FROM anc a WHERE a.stay_id = s.stay_id AND a.pos < s.pos) AS pos,
         {tok} AS token, 0 AS loss_weight
  FROM stream s {rj}
  UNION ALL
  SELECT stay_id, pos + k + 1, 'error', 1 FROM ancr)"""


def last_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    u1, u2 = uniform_sql("stay_id", "b", "1"), uniform_sql("stay_id", "b", "2")
    padded = "list_concat(list_transform(range(256 - len(l)), lambda x: 0), l)"
    q["sampled_next_token"] = with_base(f"""
SELECT stay_id, b, CAST(part AS INTEGER) AS part, token_id AS next_token_id FROM (
  SELECT r.stay_id, r.b, r.part, c2.token_id FROM rq r
  JOIN cdf2 c2 ON r.part = 2 AND c2.c2 = r.c2 AND c2.c1 = r.c1 AND r.v >= c2.cum0 AND r.v < c2.cum
  UNION ALL
  SELECT r.stay_id, r.b, r.part, c1.token_id FROM rq r
  JOIN cdf1 c1 ON r.part = 1 AND c1.c1 = r.c1 AND r.v >= c1.cum0 AND r.v < c1.cum
  UNION ALL
  SELECT r.stay_id, r.b, r.part, c0.token_id FROM rq r
  JOIN cdf0 c0 ON r.part = 0 AND r.v >= c0.cum0 AND r.v < c0.cum)""", TB, MODEL, f"""
rq0 AS (SELECT stay_id, b, p[256] AS c1, p[255] AS c2, {u1} AS u, {u2} AS v
        FROM (SELECT stay_id, b, {padded} AS p FROM tbl WHERE testset)),
rq AS (SELECT r.*, CASE WHEN r.u < 0.6 AND t2.n2c > 0 THEN 2
                        WHEN r.u >= 0.6 AND r.u < 0.6 + 0.3 AND t1.n1c > 0 THEN 1 ELSE 0 END AS part
       FROM rq0 r LEFT JOIN t2 ON t2.c2 = r.c2 AND t2.c1 = r.c1 LEFT JOIN t1 ON t1.c1 = r.c1),
cdf2 AS (SELECT c2, c1, token_id,
                sum(n2) OVER (PARTITION BY c2, c1 ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  / sum(n2) OVER (PARTITION BY c2, c1) AS cum,
                (sum(n2) OVER (PARTITION BY c2, c1 ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  - n2) / sum(n2) OVER (PARTITION BY c2, c1) AS cum0 FROM m2),
cdf1 AS (SELECT c1, token_id,
                sum(n1) OVER (PARTITION BY c1 ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  / sum(n1) OVER (PARTITION BY c1) AS cum,
                (sum(n1) OVER (PARTITION BY c1 ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  - n1) / sum(n1) OVER (PARTITION BY c1) AS cum0 FROM m1),
w0 AS (SELECT v.token_id, coalesce(m0.n0, 0) + 1.0 AS w FROM vocab v LEFT JOIN m0 USING (token_id)
       WHERE v.token_id > 0),
cdf0 AS (SELECT token_id,
                sum(w) OVER (ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER () AS cum,
                (sum(w) OVER (ORDER BY token_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w)
                  / sum(w) OVER () AS cum0 FROM w0)""")
    q["contraindicated_positions"] = with_base("SELECT stay_id, pos, drug, state FROM ci", CI)
    q["inject_error"] = with_base("SELECT stay_id, pos, token, loss_weight FROM aug", CI,
                                  insert_sql("(SELECT stay_id, pos + 2 AS pos FROM ci)"))
    q["masked_loss"] = with_base(f"""
SELECT count(*) AS n, CAST(sum(R.loss_weight) AS BIGINT) AS n_weighted, round(avg(-ln({p_expr()})), 6) AS loss_all,
       round(sum(-ln({p_expr()}) * R.loss_weight) / sum(R.loss_weight), 6) AS loss_masked
{score_from('mreq')}""", CI, insert_sql("(SELECT stay_id, pos + 2 AS pos FROM ci)"), MODEL, """
mtok AS (SELECT a.stay_id, a.pos, a.loss_weight, coalesce(v.token_id, -1) AS target_id
         FROM aug a LEFT JOIN vocab v USING (token) WHERE a.stay_id % 10 = 0),
mreq AS (SELECT target_id, loss_weight, lag(target_id, 1) OVER (PARTITION BY stay_id ORDER BY pos) AS c1,
                lag(target_id, 2) OVER (PARTITION BY stay_id ORDER BY pos) AS c2 FROM mtok)""")
    q["saved_model"] = with_base("""
SELECT 0 AS "order", count(*) AS n_rows, CAST(sum(n0) AS BIGINT) AS n_tokens, any_value(kn.N) AS total FROM m0, kn
UNION ALL SELECT 1, count(*), CAST(sum(n1) AS BIGINT), any_value(kn.N) FROM m1, kn
UNION ALL SELECT 2, count(*), CAST(sum(n2) AS BIGINT), any_value(kn.N) FROM m2, kn""", MODEL)
    q["dose_x10"] = with_base("SELECT stay_id, pos, token, loss_weight FROM aug", insert_sql(
        f"(SELECT stay_id, pos + 2 AS pos FROM stream WHERE token = 'med.purchase' "
        f"AND {uniform_sql('stay_id', 'pos')} < 0.1)", replace="magnitude.9"))
    u5 = uniform_sql("stay_id", "5")
    q["real_synth_mix"] = with_base(f"""
SELECT stay_id, source, count(*) AS n_tokens, count(CASE WHEN token = 'error' THEN 1 END) AS n_error FROM (
  SELECT stay_id, token, 'real' AS source FROM stream WHERE {u5} >= 0.1
  UNION ALL SELECT stay_id, token, 'synthetic' FROM aug WHERE {u5} < 0.1)
GROUP BY stay_id, source""", CI, insert_sql("(SELECT stay_id, pos + 2 AS pos FROM ci)"))
    q["response_splice"] = with_base(f"""
SELECT s.stay_id, s.pos + CASE WHEN s.pos > a.a THEN 4 ELSE 0 END AS pos, s.token, 0 AS loss_weight
FROM stream s JOIN anch a USING (stay_id)
UNION ALL
SELECT a.stay_id, a.a + 1 + x.i AS pos,
       CASE WHEN x.t LIKE 'magnitude.%'
            THEN 'magnitude.' || (CAST(split_part(x.t, '.', 2) AS INTEGER)
                                  + CASE WHEN {uniform_sql('a.stay_id', '7 + x.i')} < 0.3 THEN 1 ELSE 0 END)
            ELSE x.t END AS token, 1 AS loss_weight
FROM anch a CROSS JOIN (VALUES (0, 'lab.view'), (1, 'magnitude.0'), (2, 'lab.click'), (3, 'magnitude.0')) x(i, t)""",
                                     f"""
hh AS (SELECT stay_id, max(hour_no) AS H FROM stream WHERE kind = 0 AND testset GROUP BY stay_id),
pk AS (SELECT stay_id, 1 + floor({uniform_sql('stay_id', '6')} * H) AS j FROM hh WHERE H >= 1),
anch AS (SELECT t.stay_id, t.pos AS a FROM stream t JOIN pk ON pk.stay_id = t.stay_id
         AND t.kind = 0 AND t.hour_no = pk.j)""")
    lens = "(0, 5), (1, 7), (2, 3)"
    toks = ("(0, 0, 'lab.view'), (0, 1, 'magnitude.0'), (0, 2, 'lab.click'), (0, 3, 'magnitude.1'), (0, 4, 'mort'), "
            "(1, 0, 'lab.click'), (1, 1, 'magnitude.8'), (1, 2, 'lab.view'), (1, 3, 'magnitude.0'), (1, 4, 'culture.error'), (1, 5, 'Growth'), (1, 6, 'mort'), "
            "(2, 0, 'lab.view'), (2, 1, 'magnitude.2'), (2, 2, 'mort')")
    q["response_kinds"] = with_base(f"""
SELECT s.stay_id, s.pos + CASE WHEN s.pos > a.a THEN a.n ELSE 0 END AS pos, s.token, 0 AS loss_weight, a.response FROM stream s JOIN anch a USING (stay_id)
UNION ALL
SELECT a.stay_id, a.a + 1 + x.i, CASE WHEN x.t LIKE 'magnitude.%'
         THEN 'magnitude.' || (CAST(split_part(x.t, '.', 2) AS INTEGER) + CASE WHEN {uniform_sql('a.stay_id', '10 + x.i')} < 0.3 THEN 1 ELSE 0 END)
         ELSE x.t END, 1, a.response
FROM anch a JOIN (VALUES {toks}) x(k, i, t) ON x.k = a.response""", f"""
hh AS (SELECT stay_id, max(hour_no) AS H FROM stream WHERE kind = 0 AND testset GROUP BY stay_id),
pk AS (SELECT stay_id, 1 + floor({uniform_sql('stay_id', '8')} * H) AS j, CAST(floor({uniform_sql('stay_id', '9')} * 3) AS INTEGER) AS response FROM hh WHERE H >= 1),
anch AS (SELECT t.stay_id, t.pos AS a, pk.response, l.n FROM stream t JOIN pk ON pk.stay_id = t.stay_id AND t.kind = 0 AND t.hour_no = pk.j
         JOIN (VALUES {lens}) l(k, n) ON l.k = pk.response)""")
    q["block_nll"] = with_base(f"""
SELECT R.stay_id, R.b, round(avg(-ln({p_expr(l0=0.1, l1=0.9, l2=0.0)})), 6) AS nll
{score_from("(SELECT stay_id, pos // 256 AS b, c1, c2, token_id AS target_id FROM ctx WHERE testset AND pos % 256 > 0)")} GROUP BY R.stay_id, R.b
UNION ALL SELECT stay_id, b, NULL FROM tbl WHERE testset AND len(l) = 1""", TB, MODEL)
    q["batch_scorer"] = with_base("""
SELECT stay_id, b, round(len(list_filter(l, lambda v: v = t9)) / len(list_filter(l, lambda v: v != 0)), 6) AS score
FROM tbl CROSS JOIN (SELECT token_id AS t9 FROM vocab WHERE token = 'magnitude.9') WHERE testset""", TB)
    q["lineitem_stream_digest"] = "WITH " + LRAW + """
SELECT stay_id, count(*) AS n_tokens, CAST(sum(pos * coalesce(token_id, 0) % 1000003) AS BIGINT) AS checksum,
       count(CASE WHEN kind = 0 THEN 1 END) AS n_spine
FROM lstream GROUP BY stay_id"""
    return q
