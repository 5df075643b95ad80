"""The given order, line-item and event tables seen as the canonical billing model.

Every derived value uses operations that are exact in IEEE doubles (floor, integer
arithmetic), so an independent engine reading the same files gets the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import MONTH_DAYS, days_between, uniform
from ..schema import Dataset
from ..session import spread

TRIAL = "trial-v1"
CUTOFF = "2000-01-01"
MAX_MONTHS = 24


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    first = raw(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"))
    # nation is the fixed 25-row dimension.
    nation = F.broadcast(raw(spark, folder, "nation"))
    return (raw(spark, folder, "customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.col("c_custkey").cast("string").alias("customer_id"),
                    F.expr("coalesce(first_order, timestamp_ntz'1995-01-01')")
                    .alias("created_at"),
                    F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment")))


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    return raw(spark, folder, "orders").selectExpr(
        "concat('sub_', o_orderkey) AS subscription_id",
        "cast(o_custkey AS string) AS customer_id",
        "o_orderpriority AS plan",
        "floor(o_totalprice / 10) / 100.0D AS mrr",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'year' ELSE 'month' END AS interval",
        "o_orderdate AS started_at",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + "
        "make_dt_interval(cast(1 + (o_orderkey * 37) % 720 AS int)) END AS ended_at",
        "CASE WHEN o_orderstatus = 'F' THEN "
        "CASE WHEN o_orderkey % 3 = 0 THEN 'payment' ELSE 'voluntary' END END AS cancel_reason",
        "CASE o_orderstatus WHEN 'F' THEN 'canceled' WHEN 'O' THEN 'active' "
        "ELSE 'past_due' END AS status",
        "o_orderdate AS available_at")


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    owner = raw(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (raw(spark, folder, "lineitem")
            .join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
            .selectExpr(
        # (order, line) repeats, so the key is a digest of the whole row.
        "concat('inv_', md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        "cast(l_quantity AS bigint), cast(round(l_extendedprice * 100) AS bigint), "
        "cast(round(l_discount * 100) AS bigint), cast(round(l_tax * 100) AS bigint), "
        "l_returnflag, l_linestatus, date_format(l_shipdate, 'yyyy-MM-dd')))) AS invoice_id",
        "cast(o_custkey AS string) AS customer_id",
        "concat('sub_', l_orderkey) AS subscription_id",
        "floor(l_extendedprice * (1 - l_discount)) / 100.0D AS amount",
        "'usd' AS currency",
        "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'paid' END AS status",
        "l_shipdate AS attempted_at",
        "CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS paid_at",
        "CASE WHEN l_returnflag = 'R' THEN element_at(array('insufficient_funds', "
        "'expired_card', 'do_not_honor', 'generic_decline', 'processing_error', "
        "'lost_or_stolen_card'), cast(l_partkey % 6 AS int) + 1) END AS failure_code",
        "cast(1 + l_linenumber % 3 AS bigint) AS attempt_number",
        "CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL '2' DAY "
        "ELSE l_shipdate END AS available_at"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return raw(spark, folder, "events").selectExpr(
        "cast(event_id AS string) AS event_id", "cast(user_id AS string) AS customer_id",
        "CASE event_type WHEN 'click' THEN 'session_start' ELSE event_type END AS name",
        "ts AS occurred_at",
        "ts + make_dt_interval(0, cast(event_id % 6 AS int)) AS available_at",
        "value")


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    return raw(spark, folder, "events").filter("event_type = 'error'").selectExpr(
        "cast(event_id AS string) AS ticket_id", "cast(user_id AS string) AS customer_id",
        "ts AS opened_at",
        "CASE WHEN event_id % 7 <> 0 THEN ts + make_dt_interval(cast(event_id % 5 AS int)) END "
        "AS resolved_at",
        "element_at(array('low', 'normal', 'high'), cast(event_id % 3 AS int) + 1) AS severity",
        "ts AS available_at")


def interventions(spark: SparkSession, folder: str) -> DataFrame:
    u = uniform(TRIAL, F.col("c_custkey"))
    return raw(spark, folder, "customer").select(
        F.concat(F.lit("int_"), "c_custkey").alias("intervention_id"),
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.lit(TRIAL).alias("experiment_id"),
        F.when(u < 0.5, "treatment").otherwise("control").alias("arm"),
        F.concat(F.lit("offer_"), F.col("c_custkey") % 6).alias("offer"),
        (F.col("c_custkey") % 6).alias("rung"),
        ((F.col("c_custkey") % 6) * 5.0).alias("cost"),
        F.expr("timestamp_ntz'1999-12-31'").alias("sent_at"),
        F.expr("timestamp_ntz'1999-12-31'").alias("available_at"))


def dataset(spark: SparkSession, folder: str) -> Dataset:
    return Dataset(customers(spark, folder), subscriptions(spark, folder),
                   invoices(spark, folder), events(spark, folder), tickets(spark, folder),
                   interventions(spark, folder))


def survival(spark: SparkSession, folder: str, follow_up: int = MAX_MONTHS) -> DataFrame:
    """(unit, plan, mrr, annual, duration, event): 0 active, 1 voluntary, 2 payment.

    Whoever left after `follow_up` months is censored there.
    """
    s = spread(subscriptions(spark, folder))  # curves and expansions follow
    end = s.select(F.max(F.greatest("started_at", F.coalesce("ended_at", "started_at")))
                   .alias("e")).scalar()
    days = days_between("started_at", F.coalesce("ended_at", end))
    months = F.greatest(F.ceil(days / MONTH_DAYS), F.lit(1))
    return s.select(
        F.col("subscription_id").alias("unit"), "plan", "mrr",
        F.when(F.col("interval") == "year", 1.0).otherwise(0.0).alias("annual"),
        F.least(months, F.lit(follow_up)).cast("int").alias("duration"),
        F.when(F.col("ended_at").isNull() | (months > follow_up), 0)
        .when(F.col("cancel_reason") == "voluntary", 1).otherwise(2).alias("event"))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Person-month panel with a cumulative failure counter and churn flags on the last row."""
    s = survival(spark, folder)
    key = F.substring("unit", 5, 20).cast("long")
    return (s.withColumn("month", F.explode(F.sequence(F.lit(0), F.col("duration") - 1)))
            .select("unit", "plan", "mrr", "annual", "month",
                    ((key * 31 + F.col("month") * 17) % 20).cast("int").alias("sessions"),
                    (F.floor((F.col("month") + key % 5) / 5)).cast("int").alias("failures_ltd"),
                    ((F.col("month") == F.col("duration") - 1) & (F.col("event") == 1))
                    .cast("int").alias("churn_voluntary"),
                    ((F.col("month") == F.col("duration") - 1) & (F.col("event") == 2))
                    .cast("int").alias("churn_involuntary")))


def trial(spark: SparkSession, folder: str) -> DataFrame:
    """Randomised trial: covariates before the cut-off, outcome = a canceled order after it."""
    o = raw(spark, folder, "orders")
    before = F.col("o_orderdate") < F.expr(f"timestamp_ntz'{CUTOFF}'")
    per = o.groupBy("o_custkey").agg(
        F.count(F.when(before, 1)).alias("n_before"),
        F.avg(F.when(before, F.floor(F.col("o_totalprice")))).alias("mean_price"),
        F.avg(F.when(before, (F.col("o_orderstatus") == "F").cast("double"))).alias("share_f"),
        F.max((~before & (F.col("o_orderstatus") == "F")).cast("int")).alias("lost"))
    return (raw(spark, folder, "customer").join(
        per, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(F.col("c_custkey").alias("unit"), "c_mktsegment", "c_nationkey",
                F.coalesce("n_before", F.lit(0)).cast("double").alias("x1"),
                (F.floor(F.coalesce("mean_price", F.lit(0.0)) / 100) / 100.0).alias("x2"),
                F.coalesce("share_f", F.lit(0.0)).alias("x3"),
                (uniform(TRIAL, "c_custkey") < 0.5).cast("int").alias("t"),
                F.coalesce("lost", F.lit(0)).alias("y")))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The trial with a score (ties included), a value, a cost, an effect and both outcomes."""
    t = trial(spark, folder)
    key = F.col("unit")
    risk = 0.05 + ((key * 7919) % 900) / 1000.0
    tau = ((key * 104729) % 401 - 250) / 1000.0
    u = ((key * 15485863) % 1009) / 1009.0
    return (t.withColumn("score", F.floor(F.col("x3") * 10) / 10.0 + (key * 271 % 50) / 100.0)
            .withColumn("value", F.floor(F.col("x2") * 10) / 10.0 + key % 7)
            .withColumn("cost", 0.5 + (key % 6) * 0.5)
            .withColumn("p0", risk).withColumn("tau", tau)
            .withColumn("y0", (u < F.col("p0")).cast("int"))
            .withColumn("y1", (u < F.col("p0") + F.col("tau")).cast("int")))


def draws(spark: SparkSession, folder: str) -> DataFrame:
    """Sweep results: one (size, seed, policy) row per business, scored from its customers.

    A business is a (segment, nation) pair of the scored table; its five policies are valued
    in one pass and unpivoted, so nothing is paired with anything.
    """
    s = scored(spark, folder)
    gain = (F.col("y0") - F.col("y1")) * F.col("value") - F.col("cost")
    money = -F.col("tau") * F.col("value") - F.col("cost")
    rules = {"treat_all": F.lit(True), "random_30pct": F.col("unit") * 37 % 10 < 3,
             "top_k_money": F.col("score") >= 0.7, "abstention_money": money > 0}
    size = F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 250 WHEN 'BUILDING' THEN 500 "
                  "WHEN 'FURNITURE' THEN 1000 WHEN 'HOUSEHOLD' THEN 2000 ELSE 4000 END")
    g = s.groupBy(size.alias("n_customers"), F.col("c_nationkey").alias("seed")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.bround(F.coalesce(F.sum(F.when(cond, gain)), F.lit(0.0)), 4).alias(f"v_{p}")
          for p, cond in rules.items()],
        *[F.count(F.when(cond, 1)).alias(f"k_{p}") for p, cond in rules.items()])
    stacked = ", ".join(f"'{p}', v_{p}, k_{p}" for p in rules)
    return g.selectExpr(
        "n_customers", "seed", "n AS n_eligible",
        f"stack(5, 'do_nothing', 0.0D, 0L, {stacked}) AS (policy, value, n_treated)")


def last_known(df: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
