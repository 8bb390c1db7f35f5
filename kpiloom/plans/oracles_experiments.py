"""DuckDB forms of the experiment reports and of those on the models' upkeep."""

from __future__ import annotations

from .oracles import (AB_GROUP, FEATURES, RETENTION_WEEKLY, REVENUE_DAILY, SEGMENT_METRICS, SPLIT, _auc, ab_test_sql,
                      pivot_sql, with_adapter)
from .scorers import SCORERS

_M = "18446744073709551616::UHUGEINT"
_K0, _K1, _K2 = ("14097894508562428199::UBIGINT", "13011662864482103923::UBIGINT", "11160318154034397263::UBIGINT")


def _times(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT * ({b})::UHUGEINT) % {_M})::UBIGINT"


def _plus(*terms: str) -> str:
    return "((" + " + ".join(f"({t})::UHUGEINT" for t in terms) + f") % {_M})::UBIGINT"


def _turn(v: str, k: int) -> str:
    return f"((({v}) >> {k}) | ((({v})::UHUGEINT * {1 << (64 - k)}::UHUGEINT) % {_M})::UBIGINT)"


def _read(size: int, at: str) -> str:
    pairs = ", ".join(f"substr(h, 2 * ({at} + {i}) + 1, 2)" for i in reversed(range(size)))
    return f"concat('0x', {pairs})::UBIGINT"


def _mix(u: str, v: str) -> str:
    """Columns that mix the columns u and v into ``r``."""
    return f"""{_times(f'xor({u}, {v})', 'mul')} AS m1, xor(m1, m1 >> 47) AS m2, {_times(f'xor({v}, m2)', 'mul')} AS m3,
           xor(m3, m3 >> 47) AS m4, {_times('m4', 'mul')} AS r"""


def fingerprint_cte(name: str, texts: str) -> str:
    """``name(k, fingerprint)`` of ``texts(k, t)``, texts of 1 to 32 bytes."""
    base = f"SELECT *, {_plus(_K2, '2 * n')} AS mul FROM {name}_hex"
    short = f"""
      SELECT k, {_plus(_read(1, '0'), f"{_read(1, 'n // 2')} * 256")} AS y, {_plus('n', f"{_read(1, 'n - 1')} * 4")} AS z,
             xor({_times('y', _K2)}, {_times('z', _K0)}) AS w, {_times('xor(w, w >> 47)', _K2)} AS r
      FROM {name}_hex WHERE n BETWEEN 1 AND 3"""
    some = f"""
      SELECT k, {_plus('n', f"{_read(4, '0')} * 8")} AS u, {_read(4, 'n - 4')} AS v, {_mix('u', 'v')}
      FROM ({base}) WHERE n BETWEEN 4 AND 7"""
    more = f"""
      SELECT k, {_plus(_read(8, '0'), _K2)} AS a, {_read(8, 'n - 8')} AS b, {_plus(_times(_turn('b', 37), 'mul'), 'a')} AS c,
             {_plus(_turn('a', 25), 'b')} AS d0, {_times('d0', 'mul')} AS d, {_mix('c', 'd')}
      FROM ({base}) WHERE n BETWEEN 8 AND 16"""
    many = f"""
      SELECT k, {_times(_read(8, '0'), _K1)} AS a, {_read(8, '8')} AS b, {_times(_read(8, 'n - 8'), 'mul')} AS c,
             {_times(_read(8, 'n - 16'), _K2)} AS d, {_plus('a', 'b')} AS ab, {_plus('b', _K2)} AS bk,
             {_plus(_turn('ab', 43), _turn('c', 30), 'd')} AS e, {_plus('a', _turn('bk', 18), 'c')} AS f, {_mix('e', 'f')}
      FROM ({base}) WHERE n BETWEEN 17 AND 32"""
    parts = " UNION ALL ".join(f"SELECT k, r FROM ({p})" for p in (short, some, more, many))
    return f"""
{name}_hex AS (SELECT k, hex(t) AS h, length(hex(t)) // 2 AS n FROM ({texts})),
{name} AS (
  SELECT k, CASE WHEN r >= 9223372036854775808 THEN (r::HUGEINT - 18446744073709551616)::BIGINT ELSE r::BIGINT END
            AS fingerprint
  FROM ({parts}))"""


def _phi(x: str) -> str:
    """Normal CDF by Simpson's rule over 2,000 pieces from 0."""
    return (f"list_transform([greatest(-9.0, least(9.0, {x}))], lambda v: 0.5 + v / 6000 / sqrt(2 * pi()) * list_sum("
            f"list_transform(range(0, 2001), lambda i: (CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-pow(i * v / 2000, 2) / 2))))[1]")


_Z975, _Z80 = "1.959963984540054", "0.8416212335729143"


def _power(rate: str, effect: str) -> str:
    other = f"({rate} + {effect})"
    pooled = f"(({rate} * a_total + {other} * b_total) / (a_total + b_total))"
    se0 = f"sqrt({pooled} * (1 - {pooled}) * (1 / a_total + 1 / b_total))"
    se1 = f"sqrt({rate} * (1 - {rate}) / a_total + {other} * (1 - {other}) / b_total)"
    tails = [_phi(f"(({sign}({effect}) - {_Z975} * {se0}) / {se1})") for sign in ("", "-")]
    return f"({tails[0]} + {tails[1]})"


SEQUENTIAL = f"""
  SELECT signup_day, a_success, a_total, b_success, b_total, uplift, z, CASE WHEN valid THEN round(bound, 10) END AS bound,
         round(least(1.0, coalesce(min(CASE WHEN valid THEN exp(-ratio) END) OVER w, 1.0)), 10) AS p_always,
         coalesce(bool_or(abs(z) >= bound) OVER w, false) AS stop, valid
  FROM (SELECT *, CASE WHEN valid THEN uplift / sqrt(v) END AS z, ln((v + 0.0004) / v) / 2 AS half,
               uplift * uplift / v * 0.0004 / (2 * (v + 0.0004)) - half AS ratio,
               sqrt(2 * (v + 0.0004) / 0.0004 * (half - ln(0.05))) AS bound
        FROM (SELECT *, coalesce(a_total >= 30 AND b_total >= 30 AND v0 > 0, false) AS valid, CASE WHEN v0 > 0 THEN v0 END AS v
              FROM (SELECT *, CASE WHEN a_total > 0 AND b_total > 0 THEN b_success / b_total - a_success / a_total END AS uplift,
                           CASE WHEN a_total > 0 AND b_total > 0 THEN
                             (a_success + b_success) / (a_total + b_total) * (1 - (a_success + b_success) / (a_total + b_total))
                             * (1 / a_total + 1 / b_total) END AS v0
                    FROM (SELECT signup_day, {", ".join(
                        f"sum(coalesce({c}, 0)) OVER (ORDER BY signup_day)::BIGINT AS {c}"
                        for c in ("a_success", "a_total", "b_success", "b_total"))}
                          FROM ({pivot_sql('seg_metrics', 'signup_day')})))))
  WINDOW w AS (ORDER BY signup_day)"""

POWER = f"""
power_cells AS (
  SELECT signup_day, a_success, a_total, b_success, b_total, coalesce(rate > 0 AND rate < 1 AND b_rate >= 0, false) AS valid,
         CASE WHEN coalesce(rate > 0 AND rate < 1 AND b_rate >= 0, false) THEN rate END AS rate,
         CASE WHEN coalesce(rate > 0 AND rate < 1 AND b_rate >= 0, false) THEN b_rate - rate END AS uplift
  FROM (SELECT *, a_success / nullif(a_total, 0) AS rate FROM ({pivot_sql('seg_metrics', 'signup_day')}))),
halving AS (
  SELECT signup_day, rate, a_total, b_total, 0.0::DOUBLE AS low, (1 - rate)::DOUBLE AS high, 0 AS step
  FROM power_cells WHERE valid
  UNION ALL
  SELECT signup_day, rate, a_total, b_total, CASE WHEN found THEN low ELSE middle END,
         CASE WHEN found THEN middle ELSE high END, step + 1
  FROM (SELECT *, (low + high) / 2 AS middle, {_power('rate', '((low + high) / 2)')} >= 0.8 AS found
        FROM halving WHERE step < 60))"""


def _margin(name: str) -> str:
    intercept, weights = SCORERS[name]
    return " + ".join([f"{intercept!r}::DOUBLE", *(
        f"coalesce(CAST({f} AS DOUBLE), 0.0) * {w!r}::DOUBLE" for f, w in weights.items())])


def scorer_ctes() -> tuple[str, ...]:
    """Scores, leaderboard and champion of the fixed scorers."""
    scores = ", ".join(f"1 / (1 + exp(-({_margin(n)}))) AS {n}" for n in SCORERS)
    parts = " UNION ALL ".join(f"""
      SELECT CAST({i} AS INTEGER) AS train_order, '{n}' AS model,
             (WITH s AS (SELECT {n} AS score, y FROM scored WHERE split = 'test') SELECT {_auc('s')}) AS auc,
             (SELECT avg(CASE WHEN ({n} >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) FROM scored WHERE split = 'test')
               AS accuracy,
             (SELECT count(*) FROM scored) AS rows, 'will_convert_14d' AS target, 'features_conversion' AS feature_table"""
                              for i, n in enumerate(SCORERS))
    return (SPLIT, f"scored AS (SELECT user_id, split, will_convert_14d AS y, {scores} FROM split)",
            f"board AS ({parts})", "best AS (SELECT model FROM board ORDER BY auc DESC, accuracy DESC, train_order LIMIT 1)")


def _of_best(column) -> str:
    return "CASE (SELECT model FROM best) " + " ".join(f"WHEN '{n}' THEN {column(n)}" for n in SCORERS) + " END"


def oracle_sql() -> dict[str, str]:
    A = with_adapter
    q: dict[str, str] = {}
    ids = fingerprint_cte("fp", "SELECT DISTINCT id AS k, CAST(id AS VARCHAR) AS t FROM s_users")
    q["ab_group_fingerprint"] = A(ids, body="""
      SELECT id AS user_id, CASE WHEN abs(fingerprint) % 100 < 50 THEN 'A' ELSE 'B' END AS ab_group, fingerprint
      FROM s_users LEFT JOIN fp ON k = id""")
    q["text_fingerprints"] = A(
        fingerprint_cte("fp_name", "SELECT DISTINCT c_name AS k, c_name AS t FROM s_users"),
        fingerprint_cte("fp_segment", "SELECT DISTINCT c_mktsegment AS k, c_mktsegment AS t FROM s_users"),
        body="""
      SELECT id AS user_id, n.fingerprint AS c_name_fingerprint, s.fingerprint AS c_mktsegment_fingerprint
      FROM s_users LEFT JOIN fp_name n ON n.k = c_name LEFT JOIN fp_segment s ON s.k = c_mktsegment""")
    q["ab_sequential"] = A(AB_GROUP, SEGMENT_METRICS, body=SEQUENTIAL)
    q["ab_power"] = A(AB_GROUP, SEGMENT_METRICS, POWER, body=f"""
      SELECT c.signup_day, a_success, c.a_total, b_success, c.b_total, c.rate AS a_rate, c.valid, uplift,
             CASE WHEN c.valid THEN round({_power('c.rate', 'uplift').replace('a_total', 'c.a_total').replace('b_total', 'c.b_total')}, 8) END AS power,
             CASE WHEN {_power('c.rate', '(1 - c.rate)').replace('a_total', 'c.a_total').replace('b_total', 'c.b_total')} >= 0.8
                  THEN round(h.high, 8) END AS min_effect,
             CAST(ceil(pow({_Z975} * sqrt(2 * (c.rate + uplift / 2) * (1 - c.rate - uplift / 2))
                  + {_Z80} * sqrt(c.rate * (1 - c.rate) + (c.rate + uplift) * (1 - c.rate - uplift)), 2)
                  / nullif(uplift * uplift, 0)) AS BIGINT) AS users_needed
      FROM power_cells c LEFT JOIN halving h ON h.signup_day = c.signup_day AND h.step = 60""").replace(
        "WITH ", "WITH RECURSIVE ", 1)
    q["ab_exposure"] = A(AB_GROUP, """
    shown AS (
      SELECT DISTINCT id, (SELECT min(e.created_at) FROM s_events e
                           WHERE e.user_id = u.id AND e.event_type = 'page_view'
                             AND e.created_at >= (SELECT min(a.created_at) FROM s_users a WHERE a.id = u.id)) AS exposed_at,
             (SELECT max(o.created_at) FROM s_orders o WHERE o.user_id = u.id AND o.status = 'Complete') AS last_order
      FROM s_users u WHERE id IS NOT NULL)""", body="""
      SELECT ab_group, count(*) AS assigned, count(exposed_at) AS exposed,
             count(*) FILTER (last_order >= exposed_at) AS converters,
             count(*) FILTER (last_order IS NOT NULL AND NOT coalesce(last_order >= exposed_at, false)) AS early_converters,
             count(exposed_at) / count(*) AS exposure_rate,
             count(*) FILTER (last_order >= exposed_at) / nullif(count(exposed_at), 0) AS conversion_rate
      FROM (SELECT shown.*, (SELECT any_value(g.ab_group) FROM ab_group g WHERE g.user_id = shown.id) AS ab_group FROM shown)
      GROUP BY ab_group""")
    q["incremental_revenue"] = A(REVENUE_DAILY, body="SELECT * FROM revenue_daily")
    q["incremental_activity"] = A(body="""
      SELECT CAST(created_at AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS active_users
      FROM s_events GROUP BY 1""")
    q["incremental_retention"] = A(RETENTION_WEEKLY, body="SELECT * FROM retention_weekly")
    keys = [("s_orders", "orders", "user_id", "s_users", "users", "id"),
            ("s_items", "order_items", "order_id", "s_orders", "orders", "order_id"),
            ("s_events", "events", "user_id", "s_users", "users", "id")]
    q["dq_relationships"] = A(body="\nUNION ALL ".join(f"""
      SELECT CAST({i} AS INTEGER) AS test_id, '{name}' AS model, '{c}' AS "column", 'relationship' AS test,
             count(*) AS failures, count(*) = 0 AS passed, '{to_name}' AS to_model, count(DISTINCT {c}) AS orphan_keys
      FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {to_c} FROM {to} WHERE {to_c} IS NOT NULL)"""
        for i, (t, name, c, to, to_name, to_c) in enumerate(keys)))
    q["dq_bounds"] = A(REVENUE_DAILY, """
    cells AS (UNPIVOT (SELECT day, CAST(orders AS DOUBLE) AS orders, revenue, aov FROM revenue_daily)
              ON orders, revenue, aov INTO NAME metric VALUE value),
    every AS (SELECT m.metric, d.day, (SELECT any_value(value) FROM cells c WHERE c.metric = m.metric AND c.day = d.day) AS value
              FROM (SELECT unnest(['orders', 'revenue', 'aov']) AS metric) m, revenue_daily d),
    past AS (
      SELECT e.*, (SELECT list(c.value) FROM cells c WHERE c.metric = e.metric AND c.day < e.day
                   AND c.day >= e.day - INTERVAL 28 DAY) AS vs FROM every e),
    mid AS (SELECT *, coalesce(len(vs), 0)::BIGINT AS n, CASE WHEN len(vs) >= 7 THEN list_median(vs) END AS median FROM past),
    spread AS (SELECT *, CASE WHEN len(vs) >= 7 THEN list_median(list_transform(vs, lambda x: abs(x - median))) END AS mad
               FROM mid)""", body="""
      SELECT metric, day, value, n, median, mad, median - mad * (5.0 * 1.4826) AS low, median + mad * (5.0 * 1.4826) AS high,
             coalesce(value < median - mad * (5.0 * 1.4826) OR value > median + mad * (5.0 * 1.4826), false) AS flagged
      FROM spread""")
    q["ab_guardrails"] = A(AB_GROUP, """
    per_user AS (
      SELECT id, (SELECT any_value(g.ab_group) FROM ab_group g WHERE g.user_id = id) AS g,
             (SELECT count(*) FROM s_events e WHERE e.user_id = id)::DOUBLE AS n_events,
             (SELECT count(*) FROM s_orders o WHERE o.user_id = id AND o.status = 'Complete')::DOUBLE AS n_orders,
             coalesce((SELECT sum(CAST(i.sale_price AS DECIMAL(18,4))) FROM s_orders o JOIN s_items i USING (order_id)
                       WHERE o.user_id = id AND o.status = 'Complete'), 0)::DOUBLE AS revenue
      FROM (SELECT DISTINCT id FROM s_users WHERE id IS NOT NULL)),
    cells AS (
      SELECT g, 'revenue_per_order' AS metric, revenue AS x, n_orders AS y FROM per_user
      UNION ALL SELECT g, 'events_per_user', n_events, 1.0 FROM per_user
      UNION ALL SELECT g, 'orders_per_user', n_orders, 1.0 FROM per_user),
    sums AS (SELECT metric, g, count(*) AS n, sum(x) / sum(y) AS r,
                    var_samp(x - y * (SELECT sum(c.x) / sum(c.y) FROM cells c WHERE c.metric = cells.metric AND c.g = cells.g))
                      / (count(*) * pow(avg(y), 2)) AS v FROM cells GROUP BY metric, g),
    tested AS (SELECT metric, a.n AS a_users, b.n AS b_users, a.r AS a_ratio, b.r AS b_ratio,
                      (b.r - 0.95 * a.r) / sqrt(b.v + 0.95 * 0.95 * a.v) AS z
               FROM (SELECT * FROM sums WHERE g = 'A') a JOIN (SELECT * FROM sums WHERE g = 'B') b USING (metric))""",
                           body=f"""
      SELECT metric, a_users, b_users, round(a_ratio, 9) AS a_ratio, round(b_ratio, 9) AS b_ratio,
             round(b_ratio / a_ratio - 1, 9) AS lift, round(z, 9) AS z, round(p, 8) AS p_value,
             round(least(1.0, max(p * step) OVER (ORDER BY p, metric)), 8) AS p_holm,
             least(1.0, max(p * step) OVER (ORDER BY p, metric)) < 0.05 AS safe
      FROM (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1 AS step
            FROM (SELECT *, {_phi("-z")} AS p FROM tested))""")
    q["ab_experiment_board"] = A("""
    plans AS (
      SELECT n_name AS experiment, CAST(DATE '2023-12-15' + n_nationkey::INTEGER AS TIMESTAMP) AS starts,
             CAST(DATE '2023-12-15' + (n_nationkey + n_nationkey % 5 * 7 + 3)::INTEGER AS TIMESTAMP) AS ends,
             'x' || n_nationkey AS salt FROM nation),
    person AS (
      SELECT id, (SELECT min(created_at) FROM s_events e WHERE e.user_id = id) AS first_event
      FROM (SELECT DISTINCT id FROM s_users WHERE id IS NOT NULL)),
    places AS (
      SELECT experiment, CASE WHEN CAST('0x' || substr(md5(salt || ':' || id), 1, 8) AS BIGINT) % 100 < 50
                              THEN 'A' ELSE 'B' END AS ab_group,
             EXISTS (FROM s_orders o WHERE o.user_id = id AND o.status = 'Complete' AND o.created_at >= first_event
                     AND o.created_at < ends) AS converted
      FROM person JOIN plans ON first_event >= starts AND first_event < ends),
    board_metrics AS (
      SELECT experiment, ab_group, count(*) AS users, count(*) FILTER (converted) AS converters,
             count(*) FILTER (converted) / count(*) AS conversion_rate FROM places GROUP BY ALL)""",
        body=ab_test_sql(f"({pivot_sql('board_metrics', 'experiment')})", "experiment"))
    ctes = scorer_ctes()
    q["ml_fixed_metrics"] = A(FEATURES, *ctes, body="""
      SELECT model, model = (SELECT model FROM best) AS chosen, train_order, auc, accuracy, rows, target, feature_table
      FROM board""")
    q["ml_fixed_scores"] = A(FEATURES, *ctes, body=f"""
      SELECT user_id, CAST(y AS DOUBLE) AS label, round({_of_best(str)}, 12) AS score FROM scored WHERE split = 'test'""")
    q["ml_fixed_evaluate"] = A(FEATURES, *ctes, body=f"""
      SELECT count(*) AS rows, count(*) FILTER (y = 1) AS positives,
             (WITH s AS (SELECT {_of_best(str)} AS score, y FROM scored) SELECT {_auc('s')}) AS auc,
             avg(CASE WHEN ({_of_best(str)} >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM scored""")
    parts = " UNION ALL ".join(f"""
      SELECT '{f}' AS feature, CAST({i} AS INTEGER) AS position,
             (SELECT round(avg(abs((v - m) * {w!r}::DOUBLE)), 9)
              FROM (SELECT coalesce(CAST({f} AS DOUBLE), 0.0) AS v FROM split WHERE split = 'train'),
                   (SELECT avg(coalesce(CAST({f} AS DOUBLE), 0.0)) AS m FROM split WHERE split = 'train')) AS mean_abs_shap
      WHERE (SELECT model FROM best) = '{n}'"""
                              for n, (_, weights) in SCORERS.items() for i, (f, w) in enumerate(weights.items()))
    q["ml_fixed_importance"] = A(FEATURES, *ctes, body=parts)
    return q
