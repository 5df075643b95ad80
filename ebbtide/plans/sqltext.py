"""The canonical views as DuckDB text, written independently of the DataFrame code."""

CTE: dict[str, str] = {}

CTE["c_customers"] = """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
       coalesce(f.d, TIMESTAMP '1995-01-01') AS created_at,
       n_name AS country, c_mktsegment AS segment
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1) f
  ON f.o_custkey = c_custkey"""

CTE["c_subs"] = """
SELECT 'sub_' || o_orderkey AS subscription_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       o_orderpriority AS plan, floor(o_totalprice / 10) / 100.0::DOUBLE AS mrr,
       CASE WHEN o_orderkey % 5 = 0 THEN 'year' ELSE 'month' END AS "interval",
       o_orderdate AS started_at,
       CASE WHEN o_orderstatus = 'F'
            THEN o_orderdate + to_days(CAST(1 + (o_orderkey * 37) % 720 AS INTEGER)) END AS ended_at,
       CASE WHEN o_orderstatus = 'F' THEN
            CASE WHEN o_orderkey % 3 = 0 THEN 'payment' ELSE 'voluntary' END END AS cancel_reason,
       CASE o_orderstatus WHEN 'F' THEN 'canceled' WHEN 'O' THEN 'active'
            ELSE 'past_due' END AS status,
       o_orderdate AS available_at
FROM orders"""

CTE["c_inv"] = """
SELECT 'inv_' || md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
         CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
         l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS invoice_id,
       CAST(o_custkey AS VARCHAR) AS customer_id, 'sub_' || l_orderkey AS subscription_id,
       floor(l_extendedprice * (1 - l_discount)) / 100.0::DOUBLE AS amount, 'usd' AS currency,
       CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'paid' END AS status,
       l_shipdate AS attempted_at,
       CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS paid_at,
       CASE WHEN l_returnflag = 'R' THEN
            (['insufficient_funds', 'expired_card', 'do_not_honor', 'generic_decline',
              'processing_error', 'lost_or_stolen_card'])[(l_partkey % 6) + 1] END AS failure_code,
       CAST(1 + l_linenumber % 3 AS BIGINT) AS attempt_number,
       CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 2 DAY ELSE l_shipdate END
         AS available_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

CTE["c_events"] = """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id,
       CASE event_type WHEN 'click' THEN 'session_start' ELSE event_type END AS name,
       ts AS occurred_at, ts + to_hours(CAST(event_id % 6 AS INTEGER)) AS available_at, value
FROM events"""

CTE["c_tickets"] = """
SELECT CAST(event_id AS VARCHAR) AS ticket_id, CAST(user_id AS VARCHAR) AS customer_id,
       ts AS opened_at,
       CASE WHEN event_id % 7 <> 0 THEN ts + to_days(CAST(event_id % 5 AS INTEGER)) END
         AS resolved_at,
       (['low', 'normal', 'high'])[(event_id % 3) + 1] AS severity, ts AS available_at
FROM events WHERE event_type = 'error'"""

_U = ("CAST(CAST('0x' || substr(sha256('{salt}' || {key}), 1, 16) AS UBIGINT) AS DOUBLE) "
      "/ 18446744073709551616.0::DOUBLE")


def u(salt: str, key: str) -> str:
    """sha256 uniform of a key, as SQL text."""
    return "(" + _U.format(salt=salt, key=key) + ")"


CTE["c_touch"] = f"""
SELECT 'int_' || c_custkey AS intervention_id, CAST(c_custkey AS VARCHAR) AS customer_id,
       'trial-v1' AS experiment_id,
       CASE WHEN {u('trial-v1', 'c_custkey')} < 0.5 THEN 'treatment' ELSE 'control' END AS arm,
       'offer_' || (c_custkey % 6) AS offer, c_custkey % 6 AS rung,
       (c_custkey % 6) * 5.0::DOUBLE AS cost,
       TIMESTAMP '1999-12-31' AS sent_at, TIMESTAMP '1999-12-31' AS available_at
FROM customer"""

CTE["c_surv"] = """
SELECT subscription_id AS unit, plan, mrr,
       CASE WHEN "interval" = 'year' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS annual,
       CAST(least(greatest(ceil((epoch_us(coalesce(ended_at, e.e)) - epoch_us(started_at))
            / 86400000000.0::DOUBLE / 30.44::DOUBLE), 1), 24) AS INTEGER) AS duration,
       CASE WHEN ended_at IS NULL THEN 0 WHEN cancel_reason = 'voluntary' THEN 1 ELSE 2 END
         AS event
FROM c_subs, (SELECT max(greatest(started_at, coalesce(ended_at, started_at))) AS e
              FROM c_subs) e"""

CTE["c_panel"] = """
SELECT unit, plan, mrr, annual, CAST(m AS INTEGER) AS month,
       CAST((k * 31 + m * 17) % 20 AS INTEGER) AS sessions,
       CAST((m + k % 5) // 5 AS INTEGER) AS failures_ltd,
       CAST(m = duration - 1 AND event = 1 AS INTEGER) AS churn_voluntary,
       CAST(m = duration - 1 AND event = 2 AS INTEGER) AS churn_involuntary
FROM (SELECT *, CAST(substr(unit, 5) AS BIGINT) AS k,
             unnest(range(0, CAST(duration AS BIGINT))) AS m FROM c_surv)"""

CTE["c_trial"] = f"""
SELECT c_custkey AS unit, c_mktsegment, c_nationkey,
       CAST(coalesce(n_before, 0) AS DOUBLE) AS x1,
       floor(coalesce(mean_price, 0.0) / 100) / 100.0::DOUBLE AS x2,
       coalesce(share_f, 0.0) AS x3,
       CAST({u('trial-v1', 'c_custkey')} < 0.5 AS INTEGER) AS t, coalesce(lost, 0) AS y
FROM customer LEFT JOIN (
  SELECT o_custkey, count(CASE WHEN b THEN 1 END) AS n_before,
         avg(CASE WHEN b THEN floor(o_totalprice) END) AS mean_price,
         avg(CASE WHEN b THEN CAST(o_orderstatus = 'F' AS DOUBLE) END) AS share_f,
         max(CAST(NOT b AND o_orderstatus = 'F' AS INTEGER)) AS lost
  FROM (SELECT *, o_orderdate < TIMESTAMP '2000-01-01' AS b FROM orders) GROUP BY 1
) p ON p.o_custkey = c_custkey"""

CTE["c_scored"] = """
SELECT *, CAST(uu < p0 AS INTEGER) AS y0, CAST(uu < p0 + tau AS INTEGER) AS y1
FROM (SELECT *, floor(x3 * 10) / 10.0::DOUBLE + (unit * 271 % 50) / 100.0::DOUBLE AS score,
             floor(x2 * 10) / 10.0::DOUBLE + unit % 7 AS value,
             0.5::DOUBLE + (unit % 6) * 0.5::DOUBLE AS cost,
             0.05::DOUBLE + ((unit * 7919) % 900) / 1000.0::DOUBLE AS p0,
             ((unit * 104729) % 401 - 250) / 1000.0::DOUBLE AS tau,
             ((unit * 15485863) % 1009) / 1009.0::DOUBLE AS uu
      FROM c_trial)"""

CTE["c_draws"] = """
WITH g AS (
  SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 250 WHEN 'BUILDING' THEN 500
              WHEN 'FURNITURE' THEN 1000 WHEN 'HOUSEHOLD' THEN 2000 ELSE 4000 END AS n_customers,
         c_nationkey AS seed, (y0 - y1) * value - cost AS gain,
         unit * 37 % 10 < 3 AS r, score >= 0.7 AS k, -tau * value - cost > 0 AS a FROM c_scored)
SELECT n_customers, seed, count(*) AS n_eligible, 'do_nothing' AS policy, 0.0::DOUBLE AS value,
       CAST(0 AS BIGINT) AS n_treated FROM g GROUP BY 1, 2
UNION ALL SELECT n_customers, seed, count(*), 'treat_all',
       round_even(sum(gain), 4), count(*) FROM g GROUP BY 1, 2
UNION ALL SELECT n_customers, seed, count(*), 'random_30pct',
       round_even(coalesce(sum(gain) FILTER (r), 0.0), 4), count(*) FILTER (r) FROM g GROUP BY 1, 2
UNION ALL SELECT n_customers, seed, count(*), 'top_k_money',
       round_even(coalesce(sum(gain) FILTER (k), 0.0), 4), count(*) FILTER (k) FROM g GROUP BY 1, 2
UNION ALL SELECT n_customers, seed, count(*), 'abstention_money',
       round_even(coalesce(sum(gain) FILTER (a), 0.0), 4), count(*) FILTER (a) FROM g GROUP BY 1, 2"""
