"""The canonical bitemporal model: six tables, their keys, and their two clocks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A frame does not satisfy its table definition."""


_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(),
          "ts": T.TimestampNTZType()}


@dataclass(frozen=True)
class TableDef:
    """Name, key, columns and, for facts, when a row happened and when it became knowable."""

    name: str
    key: str
    struct: T.StructType
    occurred_at: str | None = None
    available_at: str | None = None

    @property
    def is_fact(self) -> bool:
        return self.occurred_at is not None

    @property
    def columns(self) -> list[str]:
        return self.struct.fieldNames()

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.struct.fields if not f.nullable]


def _table(name: str, key: str, spec: str, occurred: str | None = None) -> TableDef:
    """Columns as `name:type`, a trailing `?` marking a nullable one."""
    fields = []
    for item in spec.split():
        col, kind = item.split(":")
        fields.append(T.StructField(col, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    return TableDef(name, key, T.StructType(fields), occurred,
                    "available_at" if occurred else None)


CUSTOMERS = _table("customers", "customer_id",
                   "customer_id:string created_at:ts country:string? segment:string?")
SUBSCRIPTIONS = _table(
    "subscriptions", "subscription_id",
    "subscription_id:string customer_id:string plan:string mrr:double interval:string "
    "started_at:ts ended_at:ts? cancel_reason:string? status:string available_at:ts",
    "started_at")
INVOICES = _table(
    "invoices", "invoice_id",
    "invoice_id:string customer_id:string subscription_id:string? amount:double "
    "currency:string status:string attempted_at:ts paid_at:ts? failure_code:string? "
    "attempt_number:long available_at:ts", "attempted_at")
EVENTS = _table(
    "events", "event_id",
    "event_id:string customer_id:string name:string occurred_at:ts available_at:ts "
    "value:double?", "occurred_at")
TICKETS = _table(
    "tickets", "ticket_id",
    "ticket_id:string customer_id:string opened_at:ts resolved_at:ts? severity:string? "
    "available_at:ts", "opened_at")
INTERVENTIONS = _table(
    "interventions", "intervention_id",
    "intervention_id:string customer_id:string experiment_id:string arm:string "
    "offer:string? rung:long? cost:double sent_at:ts available_at:ts", "sent_at")

TABLES: dict[str, TableDef] = {t.name: t for t in (
    CUSTOMERS, SUBSCRIPTIONS, INVOICES, EVENTS, TICKETS, INTERVENTIONS)}
FACTS = [t for t in TABLES.values() if t.is_fact]


def empty(spark: SparkSession, table: TableDef) -> DataFrame:
    """A typed frame with no rows, for a source the tenant does not have."""
    return spark.createDataFrame([], table.struct)


@dataclass
class Dataset:
    """One tenant's six tables, all lazy, plus what is known about the currency."""

    customers: DataFrame
    subscriptions: DataFrame
    invoices: DataFrame
    events: DataFrame
    tickets: DataFrame
    interventions: DataFrame | None = None
    stated: DataFrame | None = None
    """One column `currency`: the distinct codes the raw exports state."""
    declared: str | None = None
    supplied: frozenset[str] = field(
        default_factory=lambda: frozenset(TABLES))
    """Tables a file was given for; the others are empty because they were not measured."""

    def __post_init__(self) -> None:
        if self.interventions is None:
            self.interventions = empty(self.customers.sparkSession, INTERVENTIONS)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def __iter__(self):
        return ((t, self.table(t.name)) for t in TABLES.values())

    def stated_currencies(self) -> DataFrame:
        """Distinct currency codes: those the raw files stated, else those on the invoices."""
        from .functions.money import currency_code

        inv = self.invoices.select(currency_code("currency").alias("currency"))
        found = inv if self.stated is None else inv.unionByName(
            self.stated.select(currency_code("currency").alias("currency")))
        return found.filter(F.col("currency").isNotNull()).distinct()
