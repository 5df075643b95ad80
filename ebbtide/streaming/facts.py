"""The batch semantics carried onto streams of canonical facts.

Event time is when a fact happened; the watermark waits as long as facts of that table may take
to become knowable. Sinks are files written per micro-batch, so a restart repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators import holdout
from ..schema import TableDef
from ..sources.csv_export import apply_lag

# How late the facts of a table may arrive.
LATENESS = {"invoices": "2 days", "events": "6 hours", "tickets": "1 hour",
            "subscriptions": "1 hour", "interventions": "1 hour"}


def read_parquet(spark: SparkSession, folder: str, schema: StructType | str,
                 pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def fact_stream(df: DataFrame, table: TableDef, lateness: str | None = None) -> DataFrame:
    """ST1: availability filled and clamped as in batch, event time watermarked."""
    if not table.is_fact:
        raise ValueError(f"{table.name} is not a fact table")
    at = table.occurred_at
    # Watermarks need an instant; the zone is UTC, so this is the same number.
    return (apply_lag(df, table).withColumn(at, F.col(at).cast("timestamp"))
            .withWatermark(at, lateness or LATENESS[table.name]))


def usage_counts(stream: DataFrame, width: str = "30 days", slide: str = "1 day",
                 at: str = "occurred_at", by: str = "customer_id") -> DataFrame:
    """ST2: counts per customer in sliding windows; state is dropped behind the watermark."""
    return stream.groupBy(by, F.window(at, width, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(
        by, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def daily_panes(stream: DataFrame, at: str = "occurred_at", by: str = "customer_id") -> DataFrame:
    """ST2: counts per customer and day, one row of state each, whatever windows they serve."""
    return usage_counts(stream, "1 day", "1 day", at, by).withColumnRenamed("window_start", "day")


def merge_panes(panes: DataFrame, widths: Sequence[int], by: str = "customer_id") -> DataFrame:
    """ST2: counts in windows of `widths` days that slide by a day, from (by, day, n).

    A pane enters a window that starts `width - 1` days before it and leaves with the day after it, so
    four changes per pane and their running sum give all windows of two widths; between changes the
    sum stands and only the days are written out. A customer has at most as many changes as days.
    """
    day = F.unix_date(F.col("day").cast("date"))
    changes = F.array(*[x for w in widths for x in (
        F.struct(F.lit(w).alias("width_days"), (day - (w - 1)).alias("at"), F.col("n").alias("change")),
        F.struct(F.lit(w).alias("width_days"), (day + 1).alias("at"), (-F.col("n")).alias("change")))])
    cells = panes.select(by, F.explode(changes).alias("c")).select(by, "c.*").groupBy(
        by, "width_days", "at").agg(F.sum("change").alias("change"))
    w = Window.partitionBy(by, "width_days").orderBy("at")
    steps = cells.select(by, "width_days", "at", F.lead("at").over(w).alias("until"),
                         F.sum("change").over(w).alias("n")).filter("n > 0")
    return steps.select(by, "width_days", F.explode(F.sequence("at", F.col("until") - 1)).alias("d"), "n").select(
        by, "width_days", F.date_from_unix_date("d").cast("timestamp_ntz").alias("window_start"), "n")


def recovered(failed: DataFrame, paid: DataFrame, days: int = 30, lateness: str = "2 days"
              ) -> DataFrame:
    """ST3: failures with a payment of the same customer in (0, days] after them.

    A semi join, so a failure is emitted once however many payments follow. Both sides forget
    rows the interval can no longer reach.
    """
    f, p, inside = _interval(failed, paid, days, lateness)
    return f.join(p, inside, "left_semi")


def never_recovered(failed: DataFrame, paid: DataFrame, days: int = 30, lateness: str = "2 days"
                    ) -> DataFrame:
    """ST3: failures whose `days` passed without a payment, each once, when its window has closed.

    A left outer join over the interval keeps a failure until the watermark of both sides is past its
    window; only then does it come out alone. A payment that is late by up to `lateness` still counts.
    """
    f, p, inside = _interval(failed, paid, days, lateness)
    return f.join(p, inside, "left_outer").filter("_paid_at IS NULL").select(*f.columns)


def _interval(failed: DataFrame, paid: DataFrame, days: int, lateness: str
              ) -> tuple[DataFrame, DataFrame, Column]:
    f = failed.withColumn("failed_at", F.col("attempted_at").cast("timestamp")).drop(
        "attempted_at").withWatermark("failed_at", lateness)
    p = paid.select(F.col("customer_id").alias("_c"),
                    F.col("attempted_at").cast("timestamp").alias("_paid_at")).withWatermark(
        "_paid_at", lateness)
    inside = ((F.col("customer_id") == F.col("_c")) & (F.col("_paid_at") > F.col("failed_at"))
              & (F.col("_paid_at") <= F.col("failed_at") + F.expr(f"INTERVAL {days} DAYS")))
    return f, p, inside


def unrecovered(failed: DataFrame, matched: DataFrame, key: str, closed: Column) -> DataFrame:
    """ST3: failures whose window has closed and that no payment reached (batch side)."""
    return failed.filter(closed).join(matched.select(key), key, "left_anti")


def last_seen(stream: DataFrame, at: str = "occurred_at", by: str = "customer_id") -> DataFrame:
    """ST5: running latest moment per customer."""
    return stream.groupBy(by).agg(F.max(at).alias("last_seen"))


def run_to_files(stream: DataFrame, folder: str, mode: str = "append") -> str:
    """Process everything available and stop. Appended rows go straight to files; updated rows
    are written per micro-batch with its number, so that the latest can be told."""
    data, state = f"{folder}/data", f"{folder}/state"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(
        availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", data).start()
    else:
        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(
                f"{data}/batch_no={number}")
        q = w.foreachBatch(save).start()
    q.awaitTermination()
    return data


def latest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The last written value per key of an update-mode folder."""
    return df.groupBy(*by).agg(F.max_by(value, "batch").alias(value))


def assign_on_arrival(customers: DataFrame, ledger: str, state: str, experiment: str,
                      at: Column, fraction: float = 0.10, salt: str = holdout.SALT,
                      after: Callable[[int], None] | None = None) -> None:
    """ST4: customers get their arm as they arrive; the ledger only ever grows.

    Assignment needs no state: the arm follows from the id, and a repeated customer is dropped
    inside its batch or by the ledger.
    """
    spark = customers.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        new = holdout.assign(batch.select("customer_id").dropDuplicates(), experiment, at,
                             fraction, salt)
        holdout.record(spark, ledger, new)
        if after:
            after(number)

    (customers.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
     .foreachBatch(save).start().awaitTermination())
