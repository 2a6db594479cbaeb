"""Independent DuckDB queries for every entry of the catalog.

They are written the plain relational way (join back, correlated counts, global
NTILE), not the way the Spark operators compute, so that a wrong shortcut shows.
"""

from __future__ import annotations

from statistics import NormalDist

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"


def rd(value: str, places: int) -> str:
    """Round half away from zero on the shortest decimal form of a double."""
    return (
        f"CAST(ROUND(CAST(CAST(CAST({value} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,20)), {places})"
        " AS DOUBLE)"
    )


def dbl(value: str) -> str:
    return f"CAST({value} AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def div(a: str, b: str) -> str:
    return f"({dbl(a)} / NULLIF({dbl(b)}, CAST(0 AS DOUBLE)))"


def pct(a: str, b: str) -> str:
    return f"(({dbl('100')} * {dbl(a)}) / NULLIF({dbl(b)}, CAST(0 AS DOUBLE)))"


def share(flag: str) -> str:
    return f"({dbl('100')} * AVG({flag}))"


def minutes_mean(value: str) -> str:
    return div(f"SUM(CAST(ROUND({value} * 10000) AS BIGINT))", f"COUNT({value}) * 10000")


def erfc(x: str) -> str:
    """Twice the tail of exp(-(x + t)^2) over t from 0 to 8, by Simpson's rule."""
    return f"""(2 / SQRT(PI()) * EXP(-({x}) * ({x})) * (
      SELECT SUM(CASE WHEN k IN (0, 8000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
                 * EXP(-2 * ({x}) * (k / {dbl("1000")}) - (k / {dbl("1000")}) * (k / {dbl("1000")})))
             * {dbl("0.001")} / 3
      FROM RANGE(0, 8001) r(k)))"""


def digits(value: str) -> str:
    """Six significant digits."""
    return f"CAST(PRINTF('%.5e', {value}) AS DOUBLE)"


def two_sided(z: str) -> str:
    return erfc(f"ABS({z}) / SQRT(CAST(2 AS DOUBLE))")


Z_ALPHA = f"CAST({NormalDist().inv_cdf(0.975)!r} AS DOUBLE)"
Z_POWER = f"CAST({NormalDist().inv_cdf(0.8)!r} AS DOUBLE)"

VIEWS = """
users_v AS (
  SELECT c.c_custkey AS user_id, r.r_name AS city,
         CASE WHEN c.c_custkey % 7 < 5 THEN 'Android' ELSE 'iOS' END AS platform,
         c.c_mktsegment AS acquisition_channel,
         CASE WHEN c.c_acctbal > 7500 THEN 1 ELSE 0 END AS is_member
  FROM customer c
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey),
ships_v AS (
  SELECT l_orderkey, MAX(l_shipdate) AS last_ship,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS discount
  FROM lineitem GROUP BY l_orderkey),
orders_v AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS user_id,
         o.o_orderdate + (o.o_custkey % 24) * INTERVAL '1' HOUR AS order_ts,
         ROW_NUMBER() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS order_seq,
         u.city, u.platform, CAST(o.o_totalprice AS DECIMAL(18,2)) AS gmv, l.discount,
         CAST(32.0 AS DOUBLE) AS promised_minutes,
         2 + DATEDIFF('day', o.o_orderdate, l.last_ship) / CAST(40 AS DOUBLE) AS delivery_minutes,
         CASE WHEN l.last_ship IS NULL THEN NULL
              WHEN DATEDIFF('day', o.o_orderdate, l.last_ship) > 1600 THEN 1 ELSE 0 END AS is_late,
         CAST(SUBSTR(o.o_orderpriority, 1, 1) AS DOUBLE) AS rating,
         CASE WHEN o.o_orderkey % 40 = 7 THEN 'cancelled' ELSE 'delivered' END AS status
  FROM orders o
  LEFT JOIN ships_v l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN users_v u ON u.user_id = o.o_custkey),
good_v AS (SELECT * FROM orders_v WHERE status = 'delivered'),
events_v AS (
  SELECT user_id * 100 + EXTRACT(DAY FROM ts) AS session_id, user_id, ts AS event_ts,
         event_type AS event_name,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END
           AS step_no,
         CASE WHEN user_id % 7 < 5 THEN 'Android' ELSE 'iOS' END AS platform
  FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase')),
arms_v AS (
  SELECT f.user_id, f.order_id AS first_order_id, f.order_ts AS assigned_ts,
         CASE WHEN f.user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
         CASE WHEN s.order_id IS NULL THEN 0 ELSE 1 END AS repeat_within_90d,
         CAST(s.gmv AS DOUBLE) AS second_order_aov,
         CAST(CASE s.status WHEN 'cancelled' THEN 1 WHEN 'delivered' THEN 0 END AS DOUBLE)
           AS second_order_cancelled,
         CAST(CASE WHEN s.order_id IS NOT NULL AND f.user_id % 2 = 1 THEN 75 ELSE 0 END AS DOUBLE)
           AS coupon_cost
  FROM orders_v f
  LEFT JOIN orders_v s ON s.user_id = f.user_id AND s.order_seq = 2
       AND s.order_ts <= f.order_ts + INTERVAL 90 DAY
  WHERE f.order_seq = 1)"""

FIRSTS = "firsts AS (SELECT user_id, MIN(order_ts) AS first_ts FROM good_v GROUP BY user_id)"



def matured(days: int) -> str:
    return f"""
{FIRSTS},
back AS (
  SELECT f.user_id, f.first_ts,
         CASE WHEN COUNT(*) FILTER (WHERE g.order_ts > f.first_ts
                                    AND g.order_ts <= f.first_ts + INTERVAL {days} DAY) > 0
              THEN 1 ELSE 0 END AS repeated
  FROM firsts f JOIN good_v g USING (user_id)
  WHERE f.first_ts + INTERVAL {days} DAY <= {AS_OF}
  GROUP BY f.user_id, f.first_ts)"""


def features(days: int) -> str:
    return f"""
{matured(days)},
feat AS (
  SELECT b.user_id, b.first_ts, o.order_id, o.city, o.platform, o.is_late, o.rating,
         o.delivery_minutes, o.promised_minutes, u.acquisition_channel, u.is_member, b.repeated,
         {rd("o.delivery_minutes - o.promised_minutes", 1)} AS minutes_late
  FROM back b
  JOIN orders_v o ON o.user_id = b.user_id AND o.order_ts = b.first_ts
  JOIN users_v u ON u.user_id = b.user_id)"""


MATURED, FEATURES = matured(30), features(30)


def sql(select: str, *extra: str) -> str:
    return "WITH " + ",\n".join([VIEWS, *extra]) + "\n" + select


LATE = "CASE WHEN {0}.is_late = 1 THEN 'First delivery LATE' ELSE 'First delivery ON TIME' END"

MONTHS = "(EXTRACT(YEAR FROM {0}) * 12 + EXTRACT(MONTH FROM {0}))"
COHORT = f"""
{FIRSTS},
sizes AS (SELECT STRFTIME(first_ts, '%Y-%m') AS cohort_month, COUNT(*) AS cohort_size
          FROM firsts GROUP BY 1),
matrix AS (
  SELECT STRFTIME(f.first_ts, '%Y-%m') AS cohort_month,
         CAST({MONTHS.format('g.order_ts')} - {MONTHS.format('f.first_ts')} AS INTEGER)
           AS period_index,
         COUNT(DISTINCT g.user_id) AS active_users
  FROM firsts f JOIN good_v g USING (user_id) GROUP BY 1, 2),
cohorts AS (
  SELECT m.cohort_month, s.cohort_size, m.period_index, m.active_users,
         {rd(pct("m.active_users", "s.cohort_size"), 1)} AS retention_pct
  FROM matrix m JOIN sizes s USING (cohort_month))"""

LATE_CURVE = f"""
placed AS (
  SELECT user_id, order_ts, status, is_late,
         RANK() OVER (PARTITION BY user_id, status ORDER BY order_ts) AS nth
  FROM orders_v WHERE user_id IS NOT NULL),
starts AS (SELECT DISTINCT user_id, order_ts AS since FROM placed WHERE status = 'delivered' AND nth = 1),
known AS (
  SELECT s.user_id, s.since,
         (SELECT MAX(p.is_late) FROM placed p WHERE p.user_id = s.user_id AND p.order_ts = s.since) AS late
  FROM starts s),
visits AS (
  SELECT DISTINCT k.late, k.user_id, CAST({MONTHS.format('p.order_ts')} - {MONTHS.format('k.since')} AS INTEGER) AS period_index
  FROM known k JOIN placed p ON p.user_id = k.user_id AND p.status = 'delivered' WHERE k.late IS NOT NULL),
late_curve AS (
  SELECT 'First delivery ' || CASE WHEN late = 1 THEN 'LATE' ELSE 'ON TIME' END AS segment, period_index,
         {rd(pct("COUNT(*)", "(SELECT COUNT(*) FROM known k WHERE k.late = v.late)"), 1)} AS retention_pct,
         {big("(SELECT COUNT(*) FROM known k WHERE k.late = v.late)")} AS cohort_size
  FROM visits v GROUP BY late, period_index)"""

STEPS = "steps AS (SELECT step_no, event_name, COUNT(DISTINCT session_id) AS sessions FROM events_v GROUP BY 1, 2)"
BEFORE = "LAG(sessions) OVER (ORDER BY step_no)"
PLATFORM_STEPS = f"""
psteps AS (SELECT platform, step_no, event_name, COUNT(DISTINCT session_id) AS sessions
           FROM events_v GROUP BY 1, 2, 3),
pfunnel AS (SELECT platform, step_no, event_name, sessions,
       {rd(pct("sessions", "LAG(sessions) OVER (PARTITION BY platform ORDER BY step_no)"), 1)}
         AS step_conv_pct FROM psteps)"""

LEAK = """
leak AS (
  SELECT platform, COUNT(DISTINCT session_id) FILTER (WHERE step_no = 3) AS started,
         COUNT(DISTINCT session_id) FILTER (WHERE step_no = 4) AS finished
  FROM events_v GROUP BY platform)"""
RECOVERABLE = f"(w.started * {div('s.finished', 's.started')} - w.finished)"

RFM = f"""
rfm_base AS (
  SELECT user_id, MAX(order_ts) AS last_ts, COUNT(*) AS frequency, SUM(gmv) AS monetary
  FROM good_v GROUP BY user_id),
rfm_tiles AS (
  SELECT user_id, EPOCH({AS_OF} - last_ts) / CAST(86400 AS DOUBLE) AS recency_days,
         frequency, monetary,
         CAST(NTILE(5) OVER (ORDER BY last_ts, user_id) AS INTEGER) AS r_score,
         CAST(NTILE(5) OVER (ORDER BY frequency, user_id) AS INTEGER) AS f_score
  FROM rfm_base),
rfm AS (
  SELECT *, CASE WHEN f_score >= 4 THEN CASE WHEN r_score >= 4 THEN 'Champions'
                                             WHEN r_score = 3 THEN 'Loyal'
                                             ELSE 'At Risk (was valuable)' END
                 WHEN f_score = 3 THEN CASE WHEN r_score >= 3 THEN 'Loyal'
                                            ELSE 'Needs Attention' END
                 ELSE CASE WHEN r_score >= 4 THEN 'New / Promising'
                           WHEN r_score = 3 THEN 'Needs Attention'
                           ELSE 'Hibernating / Churned' END END AS segment
  FROM rfm_tiles)"""

# Each cell once per lateness, joined; the gap is a mean over users, weighted by counting them.
CELLS = f"""
sided AS (
  SELECT city, acquisition_channel, is_member, platform, is_late, COUNT(*) AS n, SUM(repeated) AS x
  FROM feat WHERE is_late IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 5),
cells AS (
  SELECT l.n + o.n AS n, {div("l.x", "l.n")} AS p_late, {div("o.x", "o.n")} AS p_on
  FROM sided l JOIN sided o USING (city, acquisition_channel, is_member, platform)
  WHERE l.is_late = 1 AND o.is_late = 0),
strat AS (
  SELECT COUNT(*) AS cells_used, {big("SUM(n)")} AS users_covered, {pct("SUM(n * p_on) - SUM(n * p_late)", "SUM(n)")} AS gap,
         {pct("SUM(n * p_on)", "SUM(n)")} AS on_pct, {pct("SUM(n * p_late)", "SUM(n)")} AS late_pct
  FROM cells)"""

ONE_WAY = f"""
traits AS (
  SELECT city, acquisition_channel AS channel, platform, IF(is_member = 1, 'Member', 'Non-member') AS member,
         (SELECT label FROM (VALUES (4.5, 9.9, '4.5-5.0'), (3.5, 4.4, '3.5-4.0')) band(low, high, label)
          WHERE rating BETWEEN low AND high) AS band, repeated
  FROM feat),
grouped AS (
  SELECT GROUPING_ID(city, channel, platform, member, first_rating) AS which, city, channel, platform, member,
         first_rating, COUNT(*) AS users, {rd(share("repeated"), 2)} AS repeat_pct
  FROM (SELECT *, COALESCE(band, '<3.5') AS first_rating FROM traits)
  GROUP BY GROUPING SETS ((city), (channel), (platform), (member), (first_rating))),
by_segment AS (
  SELECT CASE which WHEN 15 THEN 'city' WHEN 23 THEN 'channel' WHEN 27 THEN 'platform' WHEN 29 THEN 'member'
           ELSE 'first_rating' END AS dimension,
         COALESCE(city, channel, platform, member, first_rating) AS value, users, repeat_pct
  FROM grouped)"""

CITY_HOUR = f"""
city_hour AS (
  SELECT city, CASE WHEN HOUR(order_ts) IN (12, 13, 14) THEN 'Lunch peak'
                    WHEN HOUR(order_ts) IN (19, 20, 21, 22) THEN 'Dinner peak'
                    ELSE 'Off peak' END AS daypart,
         COUNT(*) AS orders, {rd(share("is_late"), 1)} AS late_rate_pct,
         {rd(minutes_mean("delivery_minutes"), 1)} AS avg_minutes
  FROM good_v GROUP BY 1, 2)"""

SPLIT = f"""
split AS (
  SELECT {LATE.format('o')} AS segment, a.variant, COUNT(*) AS n,
         {big("SUM(a.repeat_within_90d)")} AS conversions,
         {rd(share("a.repeat_within_90d"), 2)} AS repeat_90d_pct
  FROM arms_v a JOIN orders_v o ON o.order_id = a.first_order_id GROUP BY 1, 2)"""

PRIMARY = f"""
primary_v AS (
  SELECT variant, COUNT(*) AS n, {big("SUM(repeat_within_90d)")} AS conversions,
         {rd(share("repeat_within_90d"), 3)} AS repeat_90d_pct
  FROM arms_v GROUP BY variant)"""


def readout(source: str, by: str = "") -> str:
    """CTEs ending in ``stats``: control and treatment of ``source`` side by side."""
    on = f"ON t.{by} = c.{by}" if by else "ON TRUE"
    keep = f"c.{by}," if by else ""
    lead = f"{by}," if by else ""
    return f"""
pair AS (
  SELECT {keep} c.n AS n_c, t.n AS n_t, {dbl("c.conversions")} AS x_c, {dbl("t.conversions")} AS x_t,
         {div("c.conversions", "c.n")} AS p_c, {div("t.conversions", "t.n")} AS p_t
  FROM (SELECT * FROM {source} WHERE variant = 'control') c
  JOIN (SELECT * FROM {source} WHERE variant = 'treatment') t {on}),
errors AS (
  SELECT *, SQRT(p_c * (1 - p_c) / n_c) AS se_c, SQRT(p_t * (1 - p_t) / n_t) AS se_t,
         (x_t + x_c) / {dbl("n_t + n_c")} AS pool
  FROM pair),
stats AS (
  SELECT *, (p_t - p_c) / SQRT(pool * (1 - pool) * (1 / {dbl("n_t")} + 1 / {dbl("n_c")})) AS z,
         {Z_ALPHA} * SQRT(se_t * se_t + se_c * se_c) AS margin
  FROM errors),
shown AS (
  SELECT {lead} n_c AS control_n, n_t AS treatment_n,
         {rd("100 * p_c", 3)} AS control_rate_pct, {rd("100 * p_t", 3)} AS treatment_rate_pct,
         {rd("100 * se_c", 3)} AS se_control_pct, {rd("100 * se_t", 3)} AS se_treatment_pct,
         {rd("100 * (p_t - p_c)", 3)} AS abs_lift_pp,
         {rd("100 * (p_t - p_c) / p_c", 2)} AS rel_lift_pct,
         {rd("100 * (p_t - p_c - margin)", 3)} AS ci_low_pp,
         {rd("100 * (p_t - p_c + margin)", 3)} AS ci_high_pp,
         {rd("z", 3)} AS z_stat, {two_sided("z")} AS p
  FROM stats)"""


READOUT_COLUMNS = f"""'treatment' AS variant, control_n, treatment_n, control_rate_pct, treatment_rate_pct,
  se_control_pct, se_treatment_pct, abs_lift_pp, rel_lift_pct, ci_low_pp, ci_high_pp, z_stat,
  {digits("p")} AS p_value,
  CASE WHEN p < 0.0001 THEN '< 0.0001' ELSE PRINTF('%.4f', p) END AS p_value_str,
  p < 0.05 AS significant_at_5pct"""


def lift(source: str, by: str = "") -> str:
    on = f"c.{by} = t.{by}" if by else "TRUE"
    keep = f"c.{by}," if by else ""
    gap = "(t.repeat_90d_pct - c.repeat_90d_pct)"
    return f"""SELECT {keep} t.variant, {rd(gap, 2)} AS lift_pp,
      {rd(f"100 * {gap} / c.repeat_90d_pct", 1)} AS rel_lift_pct
    FROM {source} c JOIN {source} t ON c.variant = 'control' AND t.variant = 'treatment' AND {on}"""


# Label, weekly value, good direction, amber, red
MONITORED = (
    ("Orders", dbl("COUNT(*)"), "up", 0.05, 0.10),
    ("Active users", dbl("COUNT(DISTINCT user_id)"), "up", 0.05, 0.10),
    ("GMV (₹)", dbl("SUM(gmv)"), "up", 0.05, 0.10),
    ("AOV (₹)", div("SUM(gmv)", "COUNT(gmv)"), "up", 0.03, 0.06),
    ("Late-delivery rate (%)", share("is_late"), "down", 0.10, 0.20),
    ("Avg delivery (min)", minutes_mean("delivery_minutes"), "down", 0.05, 0.10),
    ("Avg rating", "AVG(rating)", "up", 0.02, 0.04),
    ("Discount % of GMV", pct("SUM(discount)", "SUM(gmv)"), "down", 0.10, 0.20),
)
SESSIONS = ("Session→order conv (%)", "up", 0.05, 0.10)
WEEKLY = "\nweekly AS (" + " UNION ALL ".join(
    f"SELECT '{label}' AS metric, CAST(DATE_TRUNC('week', order_ts) AS DATE) AS week_start,"
    f" {value} AS value FROM good_v GROUP BY 2"
    for label, value, *_ in MONITORED
) + f""" UNION ALL
  SELECT '{SESSIONS[0]}', CAST(DATE_TRUNC('week', event_ts) AS DATE),
         {pct("COUNT(DISTINCT session_id) FILTER (WHERE step_no = 4)", "COUNT(DISTINCT session_id) FILTER (WHERE step_no = 1)")}
  FROM events_v GROUP BY 2)"""
PREVIOUS = [f"LAG(value, {k}) OVER (PARTITION BY metric ORDER BY week_start)" for k in (4, 3, 2, 1)]
BASELINED = f"""
{WEEKLY},
lags AS (SELECT *, {", ".join(f"{p} AS v{k}" for k, p in zip((4, 3, 2, 1), PREVIOUS))} FROM weekly),
baselined AS (
  SELECT metric, week_start, value,
         (COALESCE(v4, 0) + COALESCE(v3, 0) + COALESCE(v2, 0) + COALESCE(v1, 0))
         / NULLIF(CAST((v4 IS NOT NULL)::INT + (v3 IS NOT NULL)::INT + (v2 IS NOT NULL)::INT
                  + (v1 IS NOT NULL)::INT AS DOUBLE), CAST(0 AS DOUBLE)) AS base
  FROM lags)"""
CLASSIFIED = f"""
{BASELINED},
limits(metric, direction, amber, red) AS (VALUES {", ".join(
    f"('{m}', '{d}', CAST({a} AS DOUBLE), CAST({r} AS DOUBLE))" for m, d, a, r in (*((m, d, a, r) for m, _, d, a, r in MONITORED), SESSIONS))}),
moves AS (
  SELECT b.*, l.direction, l.amber, l.red,
         CASE WHEN base IS NULL OR base = 0 THEN 0 ELSE (value - base) / ABS(base) END AS move,
         base IS NULL OR base = 0 AS unknown
  FROM baselined b JOIN limits l USING (metric)),
classified AS (
  SELECT *, CASE WHEN unknown THEN 'NO DATA'
                 WHEN (CASE direction WHEN 'up' THEN -move ELSE move END) >= red THEN 'RED'
                 WHEN (CASE direction WHEN 'up' THEN -move ELSE move END) >= amber THEN 'AMBER'
                 ELSE 'GREEN' END AS status
  FROM moves)"""
SECOND_LATEST = "(SELECT MAX(week_start) FROM weekly WHERE week_start < (SELECT MAX(week_start) FROM weekly))"


def reported(week: str) -> str:
    return f"""
{CLASSIFIED},
chosen AS (SELECT * FROM classified WHERE week_start = {week}),
report AS (
  SELECT week_start, metric, {rd("value", 2)} AS this_week, {rd("base", 2)} AS base_4wk,
         {rd("100 * move", 1)} AS delta_pct, direction, status,
         (SELECT CASE WHEN BOOL_OR(status = 'RED') THEN 'RED'
                      WHEN BOOL_OR(status = 'AMBER') THEN 'AMBER'
                      WHEN BOOL_OR(status = 'GREEN') THEN 'GREEN' ELSE 'NO DATA' END
          FROM chosen) AS overall
  FROM chosen)"""


REPORT_WEEK = "DATE '2001-06-18'"


def impact(rounded: bool) -> str:
    def use(value: str, places: int) -> str:
        return rd(value, places) if rounded else dbl(value)

    inputs = f"""
inputs AS (
  SELECT (SELECT {use(div("SUM(gmv)", "COUNT(gmv)"), 0)} FROM good_v) AS aov,
    (SELECT {dbl("COUNT(*)")} FROM back) * 2 AS new_users,
    (SELECT {use("AVG(n - 1)", 2)} FROM (SELECT COUNT(*) AS n FROM good_v GROUP BY user_id)
       WHERE n > 1) AS extra,
    (SELECT {use(RECOVERABLE, 0)} FROM leak w, leak s
       WHERE w.platform = 'Android' AND s.platform = 'iOS') AS recoverable,
    (SELECT {use("gap", 2)} FROM strat) AS gap,
    (SELECT {use("100 * (p_t - p_c)", 3)} FROM stats) AS lift,
    (SELECT {use("100 * p_t", 3)} FROM stats) AS treated,
    (SELECT {use(minutes_mean("second_order_aov"), 1)} FROM arms_v WHERE variant = 'control') AS aov_c,
    (SELECT {use(minutes_mean("second_order_aov"), 1)} FROM arms_v WHERE variant = 'treatment') AS aov_t),
parts AS (
  SELECT *, recoverable * 0.5::DOUBLE * 2 * aov AS android,
         new_users * 0.06::DOUBLE * (gap / 100) AS saved,
         new_users * (lift / 100) AS won,
         new_users * (treated / 100) * 75 AS coupons,
         new_users * (treated / 100) * (aov_c - aov_t) AS traded
  FROM inputs),
priced AS (
  SELECT *, saved * (extra * aov) AS lateness, won * (extra * aov) AS gross,
         won * (extra * aov) - coupons - traded AS net FROM parts)"""
    return sql(
        f"""SELECT {rd("aov", 0)} AS aov_used, {rd("extra", 6)} AS orders_per_retained_user_measured,
          {rd("recoverable", 0)} AS android_recoverable_orders_6mo,
          {rd("android / 100000", 1)} AS android_fix_gmv_lakh_yr,
          {rd("gap", 2)} AS adjusted_lateness_gap_pp,
          {dbl("6")} AS lateness_late_rate_reduction_assumed_pp,
          {rd("saved", 0)} AS lateness_fix_users_saved_yr,
          {rd("lateness / 100000", 1)} AS lateness_fix_gmv_lakh_yr,
          {rd("won", 0)} AS nudge_incremental_users_yr,
          {rd("gross / 100000", 1)} AS nudge_gross_gmv_lakh_yr,
          {rd("coupons / 100000", 1)} AS nudge_coupon_cost_lakh_yr,
          {rd("traded / 100000", 1)} AS nudge_aov_guardrail_cost_lakh_yr,
          {rd("aov_c - aov_t", 1)} AS nudge_aov_delta_rupees,
          {rd("net / 100000", 1)} AS nudge_net_gmv_lakh_yr,
          {rd("(android + lateness + net) / 100000", 1)} AS total_gmv_lakh_yr,
          (SELECT STRING_AGG(PRINTF('%s, %s: %.1f', city, daypart, late_rate_pct), '; ' ORDER BY late_rate_pct DESC, city, daypart)
           FROM (FROM city_hour ORDER BY late_rate_pct DESC, city, daypart LIMIT 2)) AS lateness_worst_cells
        FROM priced""",
        FEATURES,
        CELLS,
        LEAK,
        PRIMARY,
        readout("primary_v"),
        CITY_HOUR,
        inputs,
    )


FEATURE_COLUMNS = """user_id, first_ts, city, platform, is_late, rating, delivery_minutes,
  promised_minutes, acquisition_channel, is_member, repeated AS repeated_30d, minutes_late"""

# table, view, then its columns: numbers after the bar, texts and times before it
TABLE_COLUMNS = (
    ("users", "users_v", "city platform acquisition_channel | user_id is_member"),
    ("orders", "orders_2", "order_ts city platform status | order_id user_id gmv discount promised_minutes delivery_minutes is_late rating"),
    ("app_events", "events_2", "event_ts event_name platform | session_id user_id step_no"),
    ("ab_test_assignments", "arms_2", "assigned_ts variant | user_id first_order_id repeat_within_14d second_order_aov second_order_cancelled coupon_cost"),
)


def column_checks() -> str:
    parts = []
    for name, view, columns in TABLE_COLUMNS:
        texts, numbers = (half.split() for half in columns.split("|"))
        for c in texts:
            parts.append(f"SELECT '{name}' AS table_name, '{c}' AS column_name, COUNT({c}) AS n_values, {dbl(f'SUM(LENGTH(CAST({c} AS VARCHAR)))')} AS total, CAST(MIN({c}) AS VARCHAR) AS lowest, CAST(MAX({c}) AS VARCHAR) AS highest FROM {view}")
        for c in numbers:
            parts.append(f"SELECT '{name}', '{c}', COUNT({c}), {dbl(f'SUM(CAST(ROUND({c} * 10000) AS BIGINT))')}, NULL, NULL FROM {view}")
    return sql(
        " UNION ALL ".join(parts),
        "orders_2 AS (SELECT * REPLACE (ROUND(discount, 2) AS discount) FROM orders_v)",
        "events_2 AS (SELECT * REPLACE (CAST(DATE_TRUNC('second', event_ts) AS TIMESTAMP) AS event_ts) FROM events_v)",
        "arms_2 AS (SELECT *, repeat_within_90d AS repeat_within_14d FROM arms_v)",
    )


MONTHS_OF_ORDERS = 80  # that the orders table spans

ORACLES: dict[str, str] = {
    "headline": sql(f"""
        SELECT r.n AS registered_users, COUNT(DISTINCT g.user_id) AS ordering_users,
          {rd(pct("COUNT(DISTINCT g.user_id)", "MAX(r.n)"), 1)} AS activation_rate_pct,
          COUNT(*) AS orders, {rd("SUM(g.gmv)", 0)} AS gmv,
          {rd(div("SUM(g.gmv)", "COUNT(g.gmv)"), 0)} AS aov,
          {rd(div("COUNT(*)", "COUNT(DISTINCT g.user_id)"), 2)} AS orders_per_ordering_user,
          {rd(share("g.is_late"), 1)} AS late_delivery_rate_pct,
          {rd("AVG(g.rating)", 2)} AS avg_rating
        FROM good_v g CROSS JOIN (SELECT COUNT(*) AS n FROM users_v) r GROUP BY r.n"""),
    "repeat_rate": sql(
        f"""SELECT COUNT(*) AS matured_new_users, {big("SUM(repeated)")} AS repeated_users,
          {rd(share("repeated"), 2)} AS repeat_30d_rate_pct FROM back""",
        MATURED,
    ),
    "monthly_trend": sql(f"""
        SELECT STRFTIME(order_ts, '%Y-%m') AS month, COUNT(DISTINCT user_id) AS active_users,
          COUNT(*) AS orders, {rd(f"{dbl('SUM(gmv)')} / CAST(100000 AS DOUBLE)", 1)} AS gmv_lakh,
          {rd(div("SUM(gmv)", "COUNT(gmv)"), 0)} AS aov, {rd(share("is_late"), 1)} AS late_rate_pct,
          {rd(pct("SUM(discount)", "SUM(gmv)"), 1)} AS discount_pct_of_gmv
        FROM good_v GROUP BY 1"""),
    "guardrails": sql(f"""
        SELECT STRFTIME(order_ts, '%Y-%m') AS month,
          {rd(share("CASE status WHEN 'cancelled' THEN 1 ELSE 0 END"), 2)} AS cancel_rate_pct,
          {rd(minutes_mean("delivery_minutes"), 1)} AS avg_delivery_min,
          {rd("AVG(rating)", 2)} AS avg_rating,
          {rd(pct("SUM(discount)", "SUM(gmv)"), 1)} AS discount_pct_of_gmv,
          {rd(div("SUM(gmv - discount)", "COUNT(gmv - discount)"), 0)} AS net_revenue_per_order
        FROM orders_v GROUP BY 1"""),
    "extra_orders_per_retained_user": sql(f"""
        SELECT {rd("AVG(n - 1)", 2)} AS extra_orders
        FROM (SELECT COUNT(*) AS n FROM good_v GROUP BY user_id HAVING COUNT(*) > 1)"""),
    "hour_of_day": sql("""
        SELECT CAST(HOUR(order_ts) AS INTEGER) AS hour, COUNT(*) AS orders FROM good_v GROUP BY 1"""),
    "cohort_matrix": sql("SELECT * FROM cohorts", COHORT),
    "cohort_pivot": sql(
        "SELECT cohort_month, cohort_size, "
        + ", ".join(
            f"MAX(retention_pct) FILTER (WHERE period_index = {k}) AS m{k}" for k in range(MONTHS_OF_ORDERS)
        )
        + " FROM cohorts GROUP BY 1, 2",
        COHORT,
    ),
    "cohort_by_late": sql("SELECT * FROM late_curve", LATE_CURVE),
    "cohort_by_late_pivot": sql(
        """SELECT period_index,
          MAX(retention_pct) FILTER (WHERE segment LIKE '%LATE') AS first_delivery_late,
          MAX(retention_pct) FILTER (WHERE segment LIKE '%ON TIME') AS first_delivery_on_time
        FROM late_curve GROUP BY 1""",
        LATE_CURVE,
    ),
    "funnel_overall": sql(
        f"""SELECT step_no, event_name, sessions,
          {rd(pct("sessions", "(SELECT MAX(sessions) FROM steps)"), 1)} AS pct_of_top,
          {rd(pct("sessions", BEFORE), 1)} AS step_conv_pct,
          {rd(f"100 - {pct('sessions', BEFORE)}", 1)} AS step_dropoff_pct FROM steps""",
        STEPS,
    ),
    "funnel_by_platform": sql("SELECT * FROM pfunnel", PLATFORM_STEPS),
    "leak_size": sql(
        f"""SELECT {rd(pct("w.finished", "w.started"), 1)} AS android_pay_conv_pct,
          {rd(pct("s.finished", "s.started"), 1)} AS ios_pay_conv_pct,
          {rd(RECOVERABLE, 0)} AS recoverable_orders_6mo
        FROM leak w, leak s WHERE w.platform = 'Android' AND s.platform = 'iOS'""",
        LEAK,
    ),
    "funnel_weekly": sql(f"""
        SELECT CAST(DATE_TRUNC('week', event_ts) AS DATE) AS week_start,
          {pct("COUNT(DISTINCT session_id) FILTER (WHERE step_no = 4)",
               "COUNT(DISTINCT session_id) FILTER (WHERE step_no = 1)")} AS value
        FROM events_v GROUP BY 1"""),
    "funnel_pivot": sql(
        """SELECT event_name, MAX(step_conv_pct) FILTER (WHERE platform = 'Android') AS android,
          MAX(step_conv_pct) FILTER (WHERE platform = 'iOS') AS ios FROM pfunnel GROUP BY 1""",
        PLATFORM_STEPS,
    ),
    "rfm_scores": sql("SELECT * FROM rfm", RFM),
    "rfm_summary": sql(
        f"""SELECT segment, COUNT(*) AS users,
          {rd(pct("COUNT(*)", "(SELECT COUNT(*) FROM rfm)"), 1)} AS pct_users,
          {rd(f"{dbl('SUM(monetary)')} / CAST(100000 AS DOUBLE)", 1)} AS gmv_lakh,
          {rd(pct("SUM(monetary)", "(SELECT SUM(monetary) FROM rfm)"), 1)} AS pct_gmv,
          {rd("AVG(frequency)", 2)} AS avg_orders,
          {rd(div("SUM(monetary)", "COUNT(*)"), 0)} AS avg_lifetime_gmv,
          {rd(div("SUM(CAST(ROUND(recency_days * 86400) AS BIGINT))", "COUNT(*)") + " / 86400", 0)}
            AS avg_recency_days
        FROM rfm GROUP BY segment""",
        RFM,
    ),
    "behaviour_by_channel": sql(f"""
        SELECT acquisition_channel, COUNT(*) AS ordering_users,
          {rd(share("CASE WHEN orders > 1 THEN 1 ELSE 0 END"), 1)} AS repeat_rate_pct,
          {rd("AVG(orders)", 2)} AS orders_per_user,
          {rd(div("SUM(gmv)", "COUNT(gmv)"), 0)} AS gmv_per_user,
          {rd(pct("SUM(discount)", "SUM(gmv)"), 1)} AS discount_pct_of_gmv
        FROM (SELECT u.user_id, u.acquisition_channel, COUNT(*) AS orders, SUM(g.gmv) AS gmv,
                     SUM(g.discount) AS discount
              FROM users_v u JOIN good_v g USING (user_id) GROUP BY 1, 2)
        GROUP BY 1"""),
    "first_order_features": sql(f"SELECT {FEATURE_COLUMNS} FROM feat", FEATURES),
    "first_order_features_one_per_user": sql(
        f"""SELECT {FEATURE_COLUMNS} FROM feat f
        WHERE order_id = (SELECT MIN(order_id) FROM feat g WHERE g.user_id = f.user_id)""",
        FEATURES,
    ),
    "repeat_by_late": sql(
        f"""SELECT CASE WHEN is_late = 1 THEN 'Late' ELSE 'On time' END AS first_delivery,
          COUNT(*) AS users, {rd(share("repeated"), 2)} AS repeat_30d_pct
        FROM feat GROUP BY 1""",
        FEATURES,
    ),
    "late_gap_test": sql(
        f"""SELECT {rd("100 * (p_o - p_l)", 2)} AS raw_gap_pp, {rd("z", 6)} AS z,
          {digits(two_sided("z"))} AS p_value FROM tested""",
        FEATURES,
        f"""sides AS (
          SELECT {dbl("COUNT(*) FILTER (WHERE is_late = 1)")} AS n_l,
            {dbl("COALESCE(SUM(repeated) FILTER (WHERE is_late = 1), 0)")} AS x_l,
            {dbl("COUNT(*)")} AS n, {dbl("SUM(repeated)")} AS x FROM feat),
        rates AS (
          SELECT *, x_l / n_l AS p_l, (x - x_l) / (n - n_l) AS p_o, x / n AS pool FROM sides),
        tested AS (
          SELECT *, (p_l - p_o) / SQRT(pool * (1 - pool) * (1 / n_l + 1 / (n - n_l))) AS z
          FROM rates)""",
    ),
    "repeat_by_late_stratified": sql(
        f"""SELECT cells_used, users_covered, {rd("gap", 2)} AS adjusted_gap_pp,
          {rd("on_pct", 2)} AS wtd_ontime_pct, {rd("late_pct", 2)} AS wtd_late_pct FROM strat""",
        FEATURES,
        CELLS,
    ),
    "dose_response": sql(
        f"""SELECT CASE WHEN minutes_late IS NULL OR minutes_late > 30 THEN '5. 30+ min late'
               WHEN minutes_late > 20 THEN '4. 20-30 min late'
               WHEN minutes_late > 10 THEN '3. 10-20 min late'
               WHEN minutes_late > 0 THEN '2. 0-10 min late'
               ELSE '1. Early / on time' END AS lateness_bucket,
          COUNT(*) AS users, {rd("AVG(rating)", 2)} AS avg_first_rating,
          {rd(share("repeated"), 2)} AS repeat_30d_pct
        FROM feat GROUP BY 1""",
        FEATURES,
    ),
    "repeat_by_segment": sql("SELECT * FROM by_segment", FEATURES, ONE_WAY),
    "segment_deviation": sql(
        f"""SELECT s.*, {rd("s.repeat_pct - o.rate", 2)} AS deviation_pp,
          {rd("s.repeat_pct - o.rate", 2)} > 0 AS above
        FROM by_segment s
        CROSS JOIN (SELECT {rd(share("repeated"), 2)} AS rate FROM back) o""",
        FEATURES,
        ONE_WAY,
    ),
    "late_by_city_hour": sql("SELECT * FROM city_hour", CITY_HOUR),
    "late_heatmap": sql(
        """SELECT city, MAX(late_rate_pct) FILTER (WHERE daypart = 'Off peak') AS off_peak,
          MAX(late_rate_pct) FILTER (WHERE daypart = 'Lunch peak') AS lunch_peak,
          MAX(late_rate_pct) FILTER (WHERE daypart = 'Dinner peak') AS dinner_peak
        FROM city_hour GROUP BY 1""",
        CITY_HOUR,
    ),
    "worst_cells": sql(
        """SELECT city, daypart, late_rate_pct FROM city_hour
        ORDER BY late_rate_pct DESC, city, daypart LIMIT 2""",
        CITY_HOUR,
    ),
    "experiment_outcomes": sql("SELECT * FROM arms_v"),
    "srm_check": sql(f"""
        SELECT variant, COUNT(*) AS users,
          {rd(pct("COUNT(*)", "(SELECT COUNT(*) FROM arms_v)"), 2)} AS pct
        FROM arms_v GROUP BY variant"""),
    "srm_test": sql(
        f"""SELECT {rd("chi2", 6)} AS chi2, CAST(1 AS INTEGER) AS df,
          {digits(erfc("SQRT(chi2 / 2)"))} AS p_value, {erfc("SQRT(chi2 / 2)")} > 0.01 AS passed
        FROM fit""",
        f"""halves AS (SELECT {dbl("COUNT(*)")} / 2 AS e,
              {dbl("COUNT(*) FILTER (WHERE variant = 'control')")} AS c FROM arms_v),
        fit AS (SELECT 2 * (c - e) * (c - e) / e AS chi2 FROM halves)""",
    ),
    "ab_balance": sql(f"""
        SELECT a.variant, COUNT(*) AS users,
          {rd(div("SUM(o.gmv)", "COUNT(o.gmv)"), 1)} AS first_order_aov,
          {rd(share("o.is_late"), 2)} AS first_late_pct, {rd("AVG(o.rating)", 3)} AS first_rating
        FROM arms_v a JOIN orders_v o ON o.order_id = a.first_order_id GROUP BY a.variant"""),
    "ab_primary": sql("SELECT * FROM primary_v", PRIMARY),
    "ab_readout": sql(f"SELECT {READOUT_COLUMNS} FROM shown", PRIMARY, readout("primary_v")),
    "ab_readout_by_segment": sql(
        f"SELECT segment, {READOUT_COLUMNS} FROM shown", SPLIT, readout("split", "segment")
    ),
    "ab_power": sql(
        """SELECT 'treatment' AS variant, CAST(2 AS DOUBLE) AS planned_mde_pp, required_n_per_arm, actual_min_n_per_arm,
          actual_min_n_per_arm >= required_n_per_arm AS powered FROM sized""",
        PRIMARY,
        readout("primary_v"),
        f"""spreads AS (
          SELECT *, SQRT(2 * ((p_c + (p_c + 0.02::DOUBLE)) / 2)
                           * (1 - (p_c + (p_c + 0.02::DOUBLE)) / 2)) AS a,
            SQRT(p_c * (1 - p_c) + (p_c + 0.02::DOUBLE) * (1 - (p_c + 0.02::DOUBLE))) AS b
          FROM pair),
        sized AS (
          SELECT {big(f"CEIL(({Z_ALPHA} * a + {Z_POWER} * b) * ({Z_ALPHA} * a + {Z_POWER} * b) / (0.02::DOUBLE * 0.02::DOUBLE))")}
              AS required_n_per_arm,
            LEAST(n_c, n_t) AS actual_min_n_per_arm FROM spreads)""",
    ),
    "ab_guardrails": sql(f"""
        SELECT variant, COUNT(*) AS n,
          {rd(minutes_mean("second_order_aov"), 1)} AS second_order_aov,
          {rd(share("second_order_cancelled"), 2)} AS second_cancel_pct,
          {rd("SUM(coupon_cost)", 0)} AS total_coupon_cost
        FROM arms_v GROUP BY variant"""),
    "ab_by_segment": sql("SELECT * FROM split", SPLIT),
    "ab_segment_lift": sql(lift("split", "segment"), SPLIT),
    "ab_lift": sql(lift("primary_v"), PRIMARY),
    "weekly_metrics": sql(
        f"SELECT metric, week_start, {rd('value', 6)} AS value FROM weekly", WEEKLY
    ),
    "trailing_baseline": sql(
        f"""SELECT metric, week_start, {rd("value", 6)} AS value, {rd("base", 6)} AS base
        FROM baselined""",
        BASELINED,
    ),
    "classify": sql(
        f"SELECT metric, week_start, direction, {rd('move', 6)} AS move, status FROM classified",
        CLASSIFIED,
    ),
    "weekly_report": sql("SELECT * FROM report", reported(SECOND_LATEST)),
    "weekly_report_of_a_week": sql("SELECT * FROM report", reported(REPORT_WEEK)),
    "late_drilldown": sql(
        f"""SELECT city, {rd(share("is_late"), 1)} AS late_rate_pct,
          {rd(minutes_mean("delivery_minutes"), 1)} AS avg_min, COUNT(*) AS orders
        FROM good_v WHERE CAST(DATE_TRUNC('week', order_ts) AS DATE) IN
          (SELECT week_start FROM report WHERE status IN ('AMBER', 'RED'))
        GROUP BY city""",
        reported(REPORT_WEEK),
    ),
    "impact_model": impact(rounded=False),
    "impact_model_rounded_inputs": impact(rounded=True),
    "enrich_orders": sql("""
        SELECT order_id, user_id, order_ts, CAST(order_seq AS INTEGER) AS order_seq,
          CASE WHEN delivery_minutes IS NULL THEN NULL
               WHEN delivery_minutes - 32 > 10 THEN 1 ELSE 0 END AS is_late
        FROM orders_v"""),
    "read_tables": column_checks(),
}


def units(value: str) -> str:
    return f"CAST(SUM(CAST(ROUND({value} * 10000) AS BIGINT)) AS BIGINT)"


ORACLES["order_cells"] = sql(f"""
    SELECT CAST(DATE_TRUNC('month', order_ts) AS DATE) AS month, EXTRACT(HOUR FROM order_ts) AS hour, city, platform, status,
           COUNT(*) AS n, {dbl("SUM(gmv)")} AS gmv, COUNT(gmv) AS gmv_n, {dbl("SUM(discount)")} AS discount,
           COUNT(discount) AS discount_n, {dbl("SUM(gmv - discount)")} AS net, COUNT(gmv - discount) AS net_n,
           SUM(is_late) AS is_late, COUNT(is_late) AS is_late_n, {units("delivery_minutes")} AS delivery_minutes,
           COUNT(delivery_minutes) AS delivery_minutes_n, {units("rating")} AS rating, COUNT(rating) AS rating_n
    FROM orders_v GROUP BY 1, 2, 3, 4, 5""")
ORACLES["first_order_cells"] = sql(f"""
    SELECT city, acquisition_channel, is_member, platform, is_late,
           CASE WHEN minutes_late <= 0 THEN '1. Early / on time' WHEN minutes_late <= 10 THEN '2. 0-10 min late'
                WHEN minutes_late <= 20 THEN '3. 10-20 min late' WHEN minutes_late <= 30 THEN '4. 20-30 min late'
                ELSE '5. 30+ min late' END AS lateness_bucket,
           CASE WHEN rating >= 4.5 THEN '4.5-5.0' WHEN rating >= 3.5 THEN '3.5-4.0' ELSE '<3.5' END AS rating_band,
           COUNT(*) AS n, SUM(repeated) AS x, {units("rating")} AS rating, COUNT(rating) AS rating_n
    FROM feat GROUP BY 1, 2, 3, 4, 5, 6, 7""", FEATURES)
ORACLES["experiment_cells"] = sql(f"""
    SELECT a.variant, o.order_id IS NOT NULL AS found, o.is_late, COUNT(*) AS n, SUM(a.repeat_within_90d) AS conversions,
           SUM(a.coupon_cost) AS coupon_cost, {dbl("SUM(o.gmv)")} AS gmv, COUNT(o.gmv) AS gmv_n,
           SUM(a.second_order_cancelled) AS second_order_cancelled, COUNT(a.second_order_cancelled) AS second_order_cancelled_n,
           {units("o.rating")} AS rating, COUNT(o.rating) AS rating_n, {units("a.second_order_aov")} AS second_order_aov,
           COUNT(a.second_order_aov) AS second_order_aov_n
    FROM arms_v a LEFT JOIN orders_v o ON o.order_id = a.first_order_id GROUP BY 1, 2, 3""")
ORACLES["read_tables_parquet"] = ORACLES["read_tables"]
ORACLES["write_results_json"] = ORACLES["guardrails"]

# The same queries over a window of 14 days.
for _name in ("repeat_by_late", "late_gap_test", "repeat_by_late_stratified", "dose_response", "repeat_by_segment"):
    ORACLES[f"{_name}_14d"] = ORACLES[_name].replace(FEATURES, features(14)).replace("repeat_30d_pct", "repeat_14d_pct")

ACTIVE = "active AS (" + " UNION ALL ".join(
    f"SELECT '{grain}' AS grain, {period} AS period, COUNT(DISTINCT user_id) AS active_users FROM good_v GROUP BY 1, 2"
    for grain, period in (
        *((g, f"CAST(DATE_TRUNC('{g}', order_ts) AS DATE)") for g in ("week", "month", "quarter")),
        ("all", "CAST(NULL AS DATE)"),
    )
) + ")"
ORACLES["active_users_by_bitmaps"] = sql("SELECT * FROM active", ACTIVE)
ORACLES["active_users_by_sketches"] = sql("SELECT *, TRUE AS within FROM active", ACTIVE)
ORACLES["funnel_by_bitmaps"] = sql("""
    SELECT step_no, event_name, CAST(DATE_TRUNC('month', event_ts) AS DATE) AS month, COUNT(DISTINCT session_id) AS sessions
    FROM events_v GROUP BY 1, 2, 3""")
ORACLES["weekly_metrics_incremental"] = ORACLES["weekly_metrics"]
ORACLES["late_drilldown_by_week"] = ORACLES["late_drilldown"]
ORACLES["repeat_rate_by_user_days"] = ORACLES["repeat_rate"]
ORACLES["cohort_matrix_by_user_days"] = ORACLES["cohort_matrix"]
ORACLES["rfm_scores_by_user_days"] = ORACLES["rfm_scores"]
FAULTS = (
    ("unreadable", "3"),
    ("negative gmv", "4, 7"),
    ("no order_ts", "5"),
    ("rating is not within 1 and 5", "6"),
    ("unknown status", "7"),
)
ORACLES["quarantine_on_load"] = sql(
    "SELECT 'good' AS reason, COUNT(*) AS n, CAST(SUM(order_id) AS BIGINT) AS ids FROM orders_v WHERE order_id % 50 NOT IN (3, 4, 5, 6, 7)"
    " AND COALESCE(delivery_minutes >= 0, TRUE) UNION ALL SELECT 'negative delivery_minutes', COUNT(*), CAST(NULL AS BIGINT)"
    " FROM orders_v WHERE order_id % 50 <> 3 AND delivery_minutes < 0 HAVING COUNT(*) > 0"
    + "".join(
        f" UNION ALL SELECT '{reason}', COUNT(*), CAST(NULL AS BIGINT) FROM orders_v WHERE order_id % 50 IN ({rest}) HAVING COUNT(*) > 0"
        for reason, rest in FAULTS
    )
)
