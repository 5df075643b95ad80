"""Money columns: units, monthly normalisation, currency codes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies without a minor unit.
ZERO_DECIMAL = ("bif", "clp", "djf", "gnf", "jpy", "kmf", "krw", "mga",
                "pyg", "rwf", "ugx", "vnd", "vuv", "xaf", "xof", "xpf")

# Months per billing interval.
INTERVAL_MONTHS = {"day": 1 / 30.44, "week": 1 / 4.345, "month": 1.0, "year": 12.0}

# Symbols; any other code is printed in front of the amount.
SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥",
           "AUD": "A$", "CAD": "C$", "NZD": "NZ$", "SGD": "S$"}

# Spellings that mean "no currency was stated".
NO_CURRENCY = ("", "UNKNOWN", "NAN", "NONE", "<NA>")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_major(minor: Column | str, currency: Column | str) -> Column:
    """Smallest-unit amount to major units; absent is 0, zero-decimal currencies are whole."""
    m = F.coalesce(_c(minor).cast("double"), F.lit(0.0))
    return F.when(F.lower(F.coalesce(_c(currency), F.lit(""))).isin(*ZERO_DECIMAL), m
                  ).otherwise(m / 100.0)


def monthly(amount: Column | str, interval: Column | str, count: Column | str) -> Column:
    """A recurring amount per month."""
    months = F.lit(1.0)
    for name, m in INTERVAL_MONTHS.items():
        months = F.when(_c(interval) == name, F.lit(m)).otherwise(months)
    return _c(amount).cast("double") / (
        months * F.greatest(F.coalesce(_c(count), F.lit(1)), F.lit(1)))


def currency_code(c: Column | str) -> Column:
    """Upper-case code, or NULL for a placeholder."""
    code = F.upper(F.trim(_c(c).cast("string")))
    return F.when(~code.isin(*NO_CURRENCY), code)


def label(amount: Column, currency: Column) -> Column:
    """An amount as text in its own currency; a NULL currency prints a plain number."""
    sign = F.when(amount < 0, "-").otherwise("")
    v = F.abs(amount)
    whole = F.format_number(F.bround(v, 0), 0)
    plain = F.when(v >= 1e6, F.concat(F.format_string("%.2f", v / 1e6), F.lit(" million"))
                   ).otherwise(whole)
    rupee = (F.when(v >= 1e7, F.concat(F.format_string("%.2f", v / 1e7), F.lit(" crore")))
             .when(v >= 1e5, F.concat(F.format_string("%.1f", v / 1e5), F.lit(" lakh")))
             .otherwise(whole))
    symbol = F.concat(currency, F.lit(" "))
    for code, s in SYMBOLS.items():
        symbol = F.when(currency == code, F.lit(s)).otherwise(symbol)
    symbol = F.coalesce(symbol, F.lit(""))
    return F.concat(sign, symbol, F.when(currency == "INR", rupee).otherwise(plain))
