"""Payment-processor objects (JSON) mapped onto the canonical billing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import currency_code, monthly, to_major
from ..schema import Dataset, EVENTS, TICKETS, empty
from ..operators.validation import validate

CUSTOMER = ("id string, created bigint, address struct<country: string>, "
            "metadata struct<segment: string>")
SUBSCRIPTION = (
    "id string, customer string, status string, created bigint, start_date bigint, "
    "ended_at bigint, canceled_at bigint, cancellation_details struct<reason: string>, "
    "items struct<data: array<struct<quantity: bigint, price: struct<id: string, "
    "unit_amount: bigint, currency: string, "
    "recurring: struct<interval: string, interval_count: bigint>>>>>")
INVOICE = (
    "id string, customer string, subscription string, amount_due bigint, currency string, "
    "status string, created bigint, attempt_count bigint, "
    "status_transitions struct<paid_at: bigint, finalized_at: bigint>, "
    "payment_intent struct<last_payment_error: struct<decline_code: string, code: string>>")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line, read with a fixed schema."""
    return spark.read.schema(schema).json(path)


def parse_objects(df: DataFrame, text: str, schema: str) -> DataFrame:
    """The same objects from a text column."""
    return df.select(F.from_json(text, schema).alias("o")).select("o.*")


def utc(seconds: Column | str) -> Column:
    """Unix seconds to a zone-less UTC timestamp."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.timestamp_seconds(s).cast("timestamp_ntz")


def _given(x: Column, zero) -> Column:
    """NULL for a value that counts as absent."""
    return F.nullif(x, F.lit(zero))


def map_customers(o: DataFrame) -> DataFrame:
    """S15."""
    return o.select(F.col("id").alias("customer_id"), utc("created").alias("created_at"),
                    F.col("address.country").alias("country"),
                    F.col("metadata.segment").alias("segment"))


def map_subscriptions(o: DataFrame) -> DataFrame:
    """Recurring revenue summed over the items of each subscription."""
    items = F.coalesce("items.data", F.array())

    def item_value(i: Column) -> Column:
        price, rec = i["price"], i["price"]["recurring"]
        qty = F.coalesce(_given(i["quantity"], 0), F.lit(1))
        return monthly(
            to_major(price["unit_amount"], F.coalesce(price["currency"], F.lit("usd"))) * qty,
            F.coalesce(rec["interval"], F.lit("month")),
            F.coalesce(rec["interval_count"], F.lit(1)))

    total = F.aggregate(F.transform(items, item_value), F.lit(0.0), lambda a, x: a + x)
    start = F.coalesce(_given(F.col("start_date"), 0), F.col("created"))
    end = F.coalesce("ended_at", F.when(F.col("status") == "canceled", F.col("canceled_at")))
    some = F.size(items) > 0
    return o.select(
        F.col("id").alias("subscription_id"), F.col("customer").alias("customer_id"),
        F.when(some, F.try_element_at(items, F.lit(1))["price"]["id"])
        .otherwise("unknown").alias("plan"),
        F.bround(total, 4).alias("mrr"),
        F.coalesce(F.try_element_at(items, F.lit(-1))["price"]["recurring"]["interval"],
                   F.lit("month")).alias("interval"),
        utc(start).alias("started_at"), utc(end).alias("ended_at"),
        F.col("cancellation_details.reason").alias("cancel_reason"),
        F.coalesce("status", F.lit("active")).alias("status"), utc(start).alias("available_at"))


def map_invoices(o: DataFrame) -> DataFrame:
    """The decline code comes from the last payment error."""
    currency = F.coalesce("currency", F.lit("usd"))
    status = F.coalesce("status", F.lit("open"))
    err = F.col("payment_intent.last_payment_error")
    code = F.coalesce(_given(err["decline_code"], ""), err["code"])
    failed = (F.coalesce(code != "", F.lit(False)) | (status == "uncollectible")
              | ((F.coalesce("attempt_count", F.lit(0)) > 0) & (status != "open")))
    attempted = utc("created")
    return o.select(
        F.col("id").alias("invoice_id"), F.col("customer").alias("customer_id"),
        _given(F.col("subscription"), "").alias("subscription_id"),
        to_major("amount_due", currency).alias("amount"), currency.alias("currency"),
        F.when(status == "paid", "paid").when(failed, "failed").otherwise(status).alias("status"),
        attempted.alias("attempted_at"),
        utc(F.col("status_transitions.paid_at")).alias("paid_at"),
        code.alias("failure_code"),
        F.coalesce(_given(F.col("attempt_count"), 0), F.lit(1)).cast("long")
        .alias("attempt_number"),
        F.greatest(attempted, utc(F.col("status_transitions.finalized_at")))
        .alias("available_at"))


def stated_currencies(subscriptions: DataFrame) -> DataFrame:
    """Distinct currencies of the item prices."""
    return (subscriptions.select(F.explode(F.transform(
        F.coalesce("items.data", F.array()), lambda i: i["price"]["currency"])).alias("c"))
        .select(currency_code("c").alias("currency")).filter("currency IS NOT NULL").distinct())


def to_canonical(customers: DataFrame, subscriptions: DataFrame, invoices: DataFrame,
                 check: bool = True) -> Dataset:
    """A tenant from the three object streams; usage and tickets live elsewhere."""
    spark = customers.sparkSession
    ds = Dataset(map_customers(customers), map_subscriptions(subscriptions),
                 map_invoices(invoices), empty(spark, EVENTS), empty(spark, TICKETS),
                 stated=stated_currencies(subscriptions),
                 supplied=frozenset({"customers", "subscriptions", "invoices"}))
    return validate(ds) if check else ds
