"""DuckDB oracles: the same results asked per user, day or week with correlated
subqueries over the raw driver tables, a shape of their own beside the Spark plans.

Every oracle starts with the silver adapter as a shared WITH prefix.  Money is
summed as DECIMAL(18,4) and returned as DOUBLE (the Spark side sums exact 1e-4
units; both give the correctly rounded double of the exact sum).
"""

from __future__ import annotations

ADAPTER = """
s_users AS (
  SELECT c_custkey AS id,
         CAST(DATE '2023-10-02' + CAST((((c_custkey * 37) % 120) + 120) % 120 AS INTEGER) AS TIMESTAMP) AS created_at,
         c_name, c_nationkey, c_acctbal, c_mktsegment
  FROM customer
),
s_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'F' AND ((o_orderkey % 7) + 7) % 7 = 0 THEN 'Complete'
              WHEN o_orderstatus = 'F' THEN 'Returned'
              WHEN o_orderstatus = 'O' THEN 'Processing'
              WHEN o_orderstatus = 'P' THEN 'Shipped' END AS status,
         CAST(DATE '2023-12-01'
              + CAST(((date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 90) + 90) % 90 AS INTEGER)
              AS TIMESTAMP) AS created_at,
         o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders
),
s_items AS (
  SELECT l_orderkey AS order_id, l_extendedprice AS sale_price, l_partkey, l_suppkey, l_linenumber, l_quantity,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM lineitem
),
s_events AS (
  SELECT user_id,
         CASE WHEN event_type = 'view' AND value >= 40 THEN 'page_view'
              WHEN event_type = 'click' AND value >= 100 THEN 'add_to_cart'
              ELSE event_type END AS event_type,
         event_type AS raw_event_type,
         ts AS created_at,
         (['Email', 'Direct', 'Organic', 'Ads', 'Social', 'Other'])[
            CAST((((TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) % 6) + 6) % 6 + 1 AS INTEGER)
         ] AS traffic_source,
         event_id, value, props
  FROM events
)"""


def with_adapter(*ctes: str, body: str) -> str:
    parts = [ADAPTER.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


M = "DECIMAL(18,4)"

# -- gold models as CTEs (reused by reports) -----------------------------------

REVENUE_DAILY = f"""
revenue_daily AS (
  SELECT CAST(o.created_at AS DATE) AS day,
         CAST(count(*) FILTER (WHERE o.status = 'Complete') AS BIGINT) AS orders,
         CAST(SUM(CASE WHEN o.status = 'Complete' THEN CAST(oi.sale_price AS {M}) ELSE 0 END) AS DOUBLE) AS revenue,
         CAST(SUM(CASE WHEN o.status = 'Complete' THEN CAST(oi.sale_price AS {M}) ELSE 0 END) AS DOUBLE)
           / NULLIF(count(*) FILTER (WHERE o.status = 'Complete'), 0) AS aov
  FROM s_orders o JOIN s_items oi ON o.order_id = oi.order_id
  GROUP BY 1
)"""

REVENUE_DAILY_COMPLETED = f"""
revenue_completed AS (
  SELECT CAST(CAST(o.created_at AS DATE) AS TIMESTAMP) AS day,
         CAST(COUNT(DISTINCT o.order_id) AS BIGINT) AS orders,
         CAST(SUM(CAST(oi.sale_price AS {M})) AS DOUBLE) AS revenue,
         CAST(SUM(CAST(oi.sale_price AS {M})) AS DOUBLE) / COUNT(oi.sale_price) AS aov
  FROM s_orders o JOIN s_items oi USING (order_id)
  WHERE o.status = 'Complete'
  GROUP BY 1
)"""


FUNNEL_USERS = """
funnel_users AS (
  SELECT DISTINCT id AS user_id,
         EXISTS (FROM s_events WHERE user_id = id AND event_type = 'page_view') AS visited,
         EXISTS (FROM s_events WHERE user_id = id AND event_type = 'add_to_cart') AS added_to_cart,
         EXISTS (FROM s_orders WHERE user_id = id AND status = 'Complete') AS converted
  FROM s_users
)"""

FUNNEL_EVENT_SET = """
funnel_event_set AS (
  SELECT e.user_id,
         count(*) FILTER (WHERE raw_event_type = 'view') > 0 AS saw_landing,
         count(*) FILTER (WHERE raw_event_type = 'click') > 0 AS saw_product,
         count(*) FILTER (WHERE raw_event_type = 'signup') > 0 AS saw_cart,
         bool_or(EXISTS (FROM s_orders o WHERE o.user_id = e.user_id AND o.status = 'Complete')) AS converted
  FROM s_events e GROUP BY e.user_id
)"""


def retention_cte(name: str, week: str, n: str, rate: str, keep: str) -> str:
    """Retention of the signup weeks; ``week`` maps a date ``d`` to its week's first day."""
    first = week.format(d="CAST(created_at AS DATE)")
    return f"""
{name}_signups AS (SELECT id, {first} AS w0 FROM s_users),
{name} AS (
  SELECT w0 AS cohort_week, {n},
         count(DISTINCT id) / (SELECT count(DISTINCT peer.id) FROM {name}_signups peer WHERE peer.w0 = pair.w0) AS {rate}
  FROM (SELECT s.id, s.w0, CAST((CAST(e.w1 AS DATE) - CAST(s.w0 AS DATE)) // 7 AS BIGINT) AS {n}
        FROM (SELECT user_id, {first} AS w1 FROM s_events) e, {name}_signups s WHERE s.id = e.user_id) pair
  WHERE w0 IS NOT NULL AND {keep}
  GROUP BY w0, {n}
)"""


RETENTION_WEEKLY = retention_cte("retention_weekly", "CAST(date_trunc('week', {d}) AS DATE)", "week_n",
                                 "retention_rate", "week_n >= 0 AND week_n <= 12")
RETENTION_UNBOUNDED = retention_cte("retention_unbounded", "({d} - CAST(dayofweek({d}) AS INTEGER))", "week_number",
                                    "retention", "true")

# One row per (user, whole days from signup to the newest event), ``copies`` user rows each;
# an order counts as its item rows, at least one.
FEATURES = f"""
newest AS (SELECT user_id, max(created_at) AS anchor_ts FROM s_events GROUP BY user_id),
person AS (
  SELECT id, anchor_ts, CAST(date_sub('day', created_at, anchor_ts) AS BIGINT) AS days, count(*) AS copies
  FROM s_users, newest WHERE user_id = id GROUP BY ALL),
basket AS (
  SELECT user_id, order_id, created_at,
         (SELECT greatest(count(*), 1) FROM s_items i WHERE i.order_id = o.order_id) AS lines,
         (SELECT sum(CAST(sale_price AS {M})) FROM s_items i WHERE i.order_id = o.order_id) AS amount
  FROM s_orders o),
spending AS (
  SELECT id AS user_id, days AS days_since_signup,
         CAST(copies * coalesce((SELECT sum(lines) FROM basket b
              WHERE b.user_id = p.id AND b.created_at >= p.anchor_ts - INTERVAL 30 DAY), 0) AS BIGINT) AS orders_30d,
         CAST(copies * CASE WHEN EXISTS (FROM basket b WHERE b.user_id = p.id)
              THEN (SELECT sum(CASE WHEN b.created_at >= p.anchor_ts - INTERVAL 30 DAY THEN amount ELSE 0 END)
                    FROM basket b WHERE b.user_id = p.id) ELSE 0 END AS DOUBLE) AS revenue_30d,
         (SELECT count(DISTINCT order_id) FROM basket b
          WHERE b.user_id = p.id AND b.created_at >= p.anchor_ts - INTERVAL 30 DAY) AS frequency_30d
  FROM person p),
channels AS (
  SELECT user_id, {", ".join(f"avg(CASE WHEN traffic_source = '{c}' THEN 1 ELSE 0 END) AS pct_{c.lower()}"
                             for c in ("Email", "Direct", "Organic", "Ads", "Social"))}
  FROM s_events GROUP BY user_id),
outcome AS (
  SELECT user_id, CAST(EXISTS (FROM s_orders o WHERE o.user_id = newest.user_id AND o.created_at > anchor_ts
                               AND o.created_at <= anchor_ts + INTERVAL 14 DAY) AS BIGINT) AS will_convert_14d
  FROM newest),
features_conversion AS (
  SELECT spending.*, channels.* EXCLUDE (user_id), will_convert_14d
  FROM spending JOIN channels USING (user_id) JOIN outcome USING (user_id)
)"""

AB_GROUP = """
ab_group AS (
  SELECT id AS user_id,
         CASE WHEN (CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT)) % 100 < 50 THEN 'A' ELSE 'B' END
           AS ab_group
  FROM s_users
)"""


def ab_metrics_cte(name: str, funnel: str) -> str:
    return f"""
{name} AS (
  SELECT g.ab_group, CAST(count(*) AS BIGINT) AS users,
         CAST(SUM(CAST(f.converted AS BIGINT)) AS BIGINT) AS converters,
         SUM(CAST(f.converted AS BIGINT)) / count(*) AS conversion_rate
  FROM {funnel} f JOIN ab_group g ON f.user_id = g.user_id
  GROUP BY g.ab_group
)"""


AB_METRICS = ab_metrics_cte("ab_metrics", "funnel_users")
AB_METRICS_EVENT_USERS = ab_metrics_cte("ab_metrics_ev", "funnel_event_set")


# Train and test side of every row of the feature table.
SPLIT = """
fc AS (
  SELECT *, CAST('0x' || substr(md5('42:' || CAST(user_id AS VARCHAR)), 1, 12) AS BIGINT) AS h
  FROM features_conversion),
stats AS (SELECT will_convert_14d, quantile_disc(h, 0.8) AS p, max(h) AS mx, count(*) AS n FROM fc GROUP BY 1),
thr AS (
  SELECT s.will_convert_14d,
         CASE WHEN s.n >= 2 AND s.p >= s.mx
              THEN coalesce((SELECT max(f.h) FROM fc f
                             WHERE f.will_convert_14d = s.will_convert_14d AND f.h < s.mx), s.p)
              ELSE s.p END AS t
  FROM stats s),
split AS (
  SELECT fc.*, CASE WHEN fc.h <= thr.t THEN 'train' ELSE 'test' END AS split
  FROM fc JOIN thr ON thr.will_convert_14d = fc.will_convert_14d)"""


# A/B metrics per signup day.
SEGMENT_METRICS = """
seg_metrics AS (
  SELECT signup_day, ab_group, CAST(count(*) AS BIGINT) AS users, count(*) FILTER (converted) AS converters,
         count(*) FILTER (converted) / count(*) AS conversion_rate
  FROM (SELECT CAST(u.created_at AS DATE) AS signup_day, u.id,
               (SELECT any_value(g.ab_group) FROM ab_group g WHERE g.user_id = u.id) AS ab_group,
               EXISTS (FROM s_orders o WHERE o.user_id = u.id AND o.status = 'Complete') AS converted
        FROM s_users u WHERE u.id IS NOT NULL)
  GROUP BY ALL
)"""


def _erfc_taylor(x: str) -> str:
    """1 - erf(x) from the Maclaurin series of erf (60 terms; fine for x <= 4),
    independent of the rational approximation used on the Spark side."""
    return (f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: "
            f"pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))))")


def ab_test_sql(cells: str, keys: str = "", alpha: float = 0.05) -> str:
    """Z-test, CI and SRM over a cells relation, from the pooled variance."""
    k = f"{keys}, " if keys else ""
    return f"""
    SELECT {k}a_success, a_total, b_success, b_total,
           CASE WHEN both_ok THEN a_success / a_total END AS a_rate,
           CASE WHEN both_ok THEN b_success / b_total END AS b_rate,
           CASE WHEN ok THEN uplift END AS uplift,
           CASE WHEN ok THEN uplift / sqrt(var) END AS z,
           CASE WHEN ok THEN round({_erfc_taylor('abs(uplift / sqrt(var)) / sqrt(2)')}, 10) END AS p_value,
           CASE WHEN ok THEN uplift - 1.96 * sqrt(var) END AS ci_low,
           CASE WHEN ok THEN uplift + 1.96 * sqrt(var) END AS ci_high,
           CASE WHEN both_ok THEN chi2 END AS srm_chi2,
           CASE WHEN both_ok THEN round({_erfc_taylor('sqrt(chi2 / 2)')}, 10) END AS srm_p,
           CASE WHEN ok THEN {_erfc_taylor('abs(uplift / sqrt(var)) / sqrt(2)')} < {alpha} END AS significant,
           coalesce(ok, false) AS valid
    FROM (
      SELECT *, both_ok AND var > 0 AS ok,
             b_success / b_total - a_success / a_total AS uplift,
             pow(a_total - half, 2) / half + pow(b_total - half, 2) / half AS chi2
      FROM (
        SELECT *, pooled * (1 - pooled) * (1 / a_total + 1 / b_total) AS var
        FROM (
          SELECT *, a_total > 0 AND b_total > 0 AS both_ok, (a_total + b_total) / 2 AS half,
                 CASE WHEN a_total + b_total <> 0 THEN (a_success + b_success) / (a_total + b_total) END AS pooled
          FROM {cells}) c0) c1) c2"""


def pivot_sql(metrics: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""
    SELECT {k}CAST(max(converters) FILTER (ab_group = 'A') AS BIGINT) AS a_success,
           CAST(max(users) FILTER (ab_group = 'A') AS BIGINT) AS a_total,
           max(conversion_rate) FILTER (ab_group = 'A') AS a_rate,
           CAST(max(converters) FILTER (ab_group = 'B') AS BIGINT) AS b_success,
           CAST(max(users) FILTER (ab_group = 'B') AS BIGINT) AS b_total,
           max(conversion_rate) FILTER (ab_group = 'B') AS b_rate
    FROM {metrics} {g}"""


def verdict_sql(tested: str) -> str:
    return f"""
    SELECT *, CASE WHEN srm_p > 0.001 THEN 'PASS' WHEN srm_p <= 0.001 THEN 'FAIL' END AS srm_status,
           CASE WHEN valid THEN (NOT significant) AND abs(uplift * 100) < 1.0 END AS expected_null,
           CASE WHEN valid THEN CASE WHEN (NOT significant) AND abs(uplift * 100) < 1.0
                THEN 'EXPECTED' ELSE 'UNEXPECTED' END END AS verdict
    FROM ({tested}) t"""


def _auc(scored: str) -> str:
    """Exact AUC of (score, y) rows: the share of pairs in order, ties one half, rounded
    like the Spark side's result in the driver's comparison."""
    return f"""(SELECT round(sum(pos * (below + 0.5 * neg)) / NULLIF(sum(pos) * sum(neg), 0), 10)
              FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY score) - neg AS below
                    FROM (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
                          FROM {scored} GROUP BY score)))"""


def oracle_sql() -> dict[str, str]:
    from . import oracles_experiments
    A = with_adapter
    q: dict[str, str] = {}
    q["silver_users"] = A(body="SELECT * FROM s_users")
    q["silver_orders"] = A(body="SELECT * FROM s_orders")
    q["silver_order_items"] = A(body="SELECT * FROM s_items")
    q["silver_events"] = A(body="SELECT * FROM s_events")
    q["revenue_daily"] = A(REVENUE_DAILY, body="SELECT * FROM revenue_daily")
    q["revenue_daily_completed"] = A(REVENUE_DAILY_COMPLETED, body="SELECT * FROM revenue_completed")
    q["funnel_users"] = A(FUNNEL_USERS, body="SELECT * FROM funnel_users")
    q["funnel_event_set"] = A(FUNNEL_EVENT_SET, body="SELECT * FROM funnel_event_set")
    q["retention_weekly"] = A(RETENTION_WEEKLY, body="SELECT * FROM retention_weekly")
    q["retention_unbounded"] = A(RETENTION_UNBOUNDED, body="SELECT * FROM retention_unbounded")
    q["features_last_event"] = A(FEATURES, body="SELECT * FROM newest")
    q["features_rfm"] = A(FEATURES, body="SELECT * FROM spending")
    q["features_source_mix"] = A(FEATURES, body="SELECT * FROM channels")
    q["features_label"] = A(FEATURES, body="SELECT * FROM outcome")
    q["features_conversion"] = A(FEATURES, body="SELECT * FROM features_conversion")
    q["ab_group"] = A(AB_GROUP, body="SELECT * FROM ab_group")
    q["ab_metrics"] = A(FUNNEL_USERS, AB_GROUP, AB_METRICS, body="SELECT * FROM ab_metrics")
    q["revenue_daily_range"] = A(REVENUE_DAILY, body=(
        "SELECT day, orders, revenue, aov FROM revenue_daily ORDER BY day"))
    q["funnel_users_page"] = A(FUNNEL_USERS, body="SELECT * FROM funnel_users ORDER BY user_id LIMIT 5000")
    q["retention_weekly_sorted"] = A(RETENTION_WEEKLY, body=(
        "SELECT * FROM retention_weekly ORDER BY cohort_week, week_n"))
    q["ab_group_page"] = A(AB_GROUP, body="SELECT * FROM ab_group ORDER BY user_id LIMIT 5000")
    q["ab_metrics_sorted"] = A(FUNNEL_USERS, AB_GROUP, AB_METRICS, body="SELECT * FROM ab_metrics ORDER BY ab_group")
    q["features_page"] = A(FEATURES, body="SELECT * FROM features_conversion ORDER BY user_id LIMIT 5000")
    q["revenue_last_7"] = A(REVENUE_DAILY_COMPLETED, body="SELECT * FROM revenue_completed ORDER BY day DESC LIMIT 7")
    q["funnel_counts"] = A(FUNNEL_EVENT_SET, body=(
        "SELECT CAST(SUM(CAST(saw_landing AS BIGINT)) AS BIGINT) AS landing_users, "
        "CAST(SUM(CAST(saw_product AS BIGINT)) AS BIGINT) AS product_users, "
        "CAST(SUM(CAST(saw_cart AS BIGINT)) AS BIGINT) AS cart_users, "
        "CAST(SUM(CAST(converted AS BIGINT)) AS BIGINT) AS purchasers FROM funnel_event_set"))
    q["ab_metrics_event_users"] = A(FUNNEL_EVENT_SET, AB_GROUP, AB_METRICS_EVENT_USERS,
                                    body="SELECT * FROM ab_metrics_ev")
    q["funnel_rates"] = A(FUNNEL_USERS, body="""
        SELECT step_order, step, users, users / total AS share FROM (
          SELECT 0 AS step_order, 'all_users' AS step, CAST(count(*) AS BIGINT) AS users, count(*) AS total
            FROM funnel_users
          UNION ALL SELECT 1, 'visited', CAST(count(*) FILTER (WHERE visited) AS BIGINT), count(*) FROM funnel_users
          UNION ALL SELECT 2, 'added_to_cart', CAST(count(*) FILTER (WHERE added_to_cart) AS BIGINT), count(*)
            FROM funnel_users
          UNION ALL SELECT 3, 'converted', CAST(count(*) FILTER (WHERE converted) AS BIGINT), count(*)
            FROM funnel_users)""")
    weeks = ", ".join(f"max(CASE WHEN week_n = {k} THEN retention_rate END) AS week_{k}" for k in range(13))
    q["retention_pivot"] = A(RETENTION_WEEKLY, body=f"SELECT cohort_week, {weeks} FROM retention_weekly GROUP BY 1")
    gold_ab = (FUNNEL_USERS, AB_GROUP, AB_METRICS)
    q["ab_pivot"] = A(*gold_ab, body=pivot_sql("ab_metrics"))
    q["ab_uplift"] = A(*gold_ab, body="""
        SELECT *, abs_uplift / nullif(cr_A, 0) AS rel_uplift
        FROM (SELECT cr_A, cr_B, cr_B - cr_A AS abs_uplift
              FROM (SELECT (SELECT max(conversion_rate) FROM ab_metrics WHERE ab_group = 'A') AS cr_A,
                           (SELECT max(conversion_rate) FROM ab_metrics WHERE ab_group = 'B') AS cr_B))""")
    q["ab_bucket_share"] = A(AB_GROUP, body="""
        SELECT count(*) FILTER (WHERE ab_group = 'A') / count(*) AS share_A,
               count(*) FILTER (WHERE ab_group = 'B') / count(*) AS share_B FROM ab_group""")
    q["ab_test"] = A(*gold_ab, body=ab_test_sql(f"({pivot_sql('ab_metrics')})"))
    gold_cells = f"({pivot_sql('ab_metrics')})"
    q["ab_srm"] = A(*gold_ab, body=f"SELECT a_total, b_total, srm_chi2, srm_p FROM ({ab_test_sql(gold_cells)}) t")
    q["ab_test_invalid"] = A(*gold_ab, SEGMENT_METRICS,
                             body=ab_test_sql(f"({pivot_sql('seg_metrics', 'signup_day')})", "signup_day"))
    q["ab_verdict"] = A(FUNNEL_EVENT_SET, AB_GROUP, AB_METRICS_EVENT_USERS,
                        body=verdict_sql(ab_test_sql(f"({pivot_sql('ab_metrics_ev')})")))
    q["ab_experiment"] = A(*gold_ab, body=verdict_sql(ab_test_sql(f"({pivot_sql('ab_metrics')})")))
    tests = [
        ("revenue_daily", "day", "not_null"), ("funnel_users", "user_id", "not_null"),
        ("funnel_users", "converted", "accepted_values"), ("ab_group", "user_id", "not_null"),
        ("ab_group", "ab_group", "not_null"), ("ab_metrics", "ab_group", "not_null"),
        ("ab_metrics", "users", "not_null"), ("retention_weekly", "cohort_week", "not_null"),
        ("retention_weekly", "week_n", "not_null"), ("features_conversion", "user_id", "not_null"),
        ("features_conversion", "will_convert_14d", "accepted_values"),
    ]
    accepted = {"converted": "(true, false)", "will_convert_14d": "(0, 1)"}

    def dq_body(kind: str | None) -> str:
        parts = []
        for i, (m, c, t) in enumerate(tests):
            if kind and t != kind:
                continue
            cond = f"{c} IS NULL" if t == "not_null" else f"{c} IS NOT NULL AND {c} NOT IN {accepted[c]}"
            parts.append(f"SELECT CAST({i} AS INTEGER) AS test_id, '{m}' AS model, '{c}' AS \"column\", "
                         f"'{t}' AS test, CAST(count(*) FILTER (WHERE {cond}) AS BIGINT) AS failures, "
                         f"count(*) FILTER (WHERE {cond}) = 0 AS passed FROM {m}")
        return "\nUNION ALL ".join(parts)

    all_gold = (REVENUE_DAILY, FUNNEL_USERS, AB_GROUP, AB_METRICS, RETENTION_WEEKLY, FEATURES)
    q["dq_report"] = A(*all_gold, body=dq_body(None))
    q["dq_not_null"] = A(*all_gold, body=dq_body("not_null"))
    q["dq_accepted_values"] = A(*all_gold, body=dq_body("accepted_values"))
    feats = ["days_since_signup", "orders_30d", "revenue_30d", "frequency_30d", "pct_email", "pct_direct",
             "pct_organic", "pct_ads", "pct_social"]
    coerced = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in feats)
    q["features_coerced"] = A(FEATURES, body=(
        f"SELECT user_id, {coerced}, CAST(will_convert_14d AS BIGINT) AS will_convert_14d FROM features_conversion"))
    q["ml_split"] = A(FEATURES, SPLIT, body="SELECT user_id, will_convert_14d, split FROM split")
    q["ml_auc"] = A(FEATURES, SPLIT, body="""
      SELECT CAST(sum(pos + neg) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS positives,
             round(sum(pos * (neg_below + 0.5 * neg)) / NULLIF(sum(pos) * sum(neg), 0), 10) AS auc
      FROM (
        SELECT score, pos, neg,
               coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS neg_below
        FROM (SELECT CAST(orders_30d AS DOUBLE) AS score,
                     count(*) FILTER (WHERE will_convert_14d = 1) AS pos,
                     count(*) FILTER (WHERE will_convert_14d = 0) AS neg
              FROM split WHERE split = 'test' GROUP BY 1) g) c""")
    q["ml_accuracy"] = A(FEATURES, SPLIT, body="""
      SELECT CAST(count(*) AS BIGINT) AS rows,
             avg(CASE WHEN (CASE WHEN pct_direct >= 0.5 THEN 1.0 ELSE 0.0 END) = CAST(will_convert_14d AS DOUBLE)
                 THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM split WHERE split = 'test'""")
    scored = "scored AS (SELECT coalesce(pct_direct, 0.0) AS score, will_convert_14d AS y FROM features_conversion)"
    q["ml_evaluate_score"] = A(FEATURES, scored, body=f"""
      SELECT count(*) AS rows, count(*) FILTER (y = 1) AS positives, {_auc('scored')} AS auc,
             avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS accuracy
      FROM scored""")
    board = "\nUNION ALL ".join(f"""
      SELECT CAST({i} AS INTEGER) AS train_order, '{f}' AS model,
             (WITH scored AS (SELECT coalesce(CAST({f} AS DOUBLE), 0.0) AS score, will_convert_14d AS y
                              FROM split WHERE split = 'test')
              SELECT {_auc('scored')}) AS auc,
             (SELECT avg(CASE WHEN (coalesce(CAST({f} AS DOUBLE), 0.0) >= 0.5) = (will_convert_14d = 1)
                              THEN 1.0 ELSE 0.0 END) FROM split WHERE split = 'test') AS accuracy,
             (SELECT count(*) FROM split) AS rows, 'will_convert_14d' AS target,
             'features_conversion' AS feature_table""" for i, f in enumerate(feats))
    q["ml_feature_board"] = A(FEATURES, SPLIT, body=board)
    q["ml_feature_champion"] = A(FEATURES, SPLIT, body=f"""
      SELECT * FROM ({board}) ORDER BY auc DESC, accuracy DESC, train_order LIMIT 1""")
    q["ml_batch_summary"] = A(FEATURES, body=f"""
      SELECT CAST({len(tests)} AS BIGINT) AS tests, CAST({len(tests)} AS BIGINT) AS tests_passed, count(*) AS rows,
             CAST({len(feats)} AS BIGINT) AS features, CAST(4 AS BIGINT) AS models FROM features_conversion""")
    q["event_type_sets"] = A(body="""
      SELECT user_id, string_agg(t, ',' ORDER BY t) AS events, count(t) AS n_types,
             bool_or(t = 'view') AS saw_landing, bool_or(t = 'click') AS saw_product, bool_or(t = 'signup') AS saw_cart
      FROM (SELECT DISTINCT user_id, raw_event_type AS t FROM s_events) GROUP BY user_id""")
    q["features_text_coerced"] = A(body="""
      SELECT event_id, k AS padded, k + 0.5 AS bracketed, 0.0 AS suffixed, CAST('1' || CAST(k AS INTEGER) AS DOUBLE)
             AS grouped, k * 10 AS scientific, value AS listed, 0.0 AS no_list, k AS nested,
             CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS large, 0.0 AS missing, 0.0 AS word,
             CAST(event_type = 'purchase' AS BIGINT) AS bought
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM s_events)""")
    return q | oracles_experiments.oracle_sql()
