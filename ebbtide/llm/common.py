"""What the operators of this package share: written intermediate tables and column idioms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

#: ASCII white space, the only characters that part words in this package.
SPACE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder of the session and go on with the written copy.

    The copy is compressed and columnar, so later passes read only the columns they use, and a
    lost executor costs a re-read instead of a recomputation.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores behind it as it takes not to be a column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` bound to a variable, so that it is computed once per row.

    Inside a lambda a plain column expression would be computed once per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def parts(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions for `rows`, of about `per_part` rows each, so that their number follows the data."""
    return max(least, -(-rows // per_part))
