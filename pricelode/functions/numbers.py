"""Number readers (N1-N5), tax arithmetic (N6-N8, N13, N14), cases and invoices (N10-N12), dates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.constants import CENT, PER_PRODUCT, REDUCED_GOODS, REDUCED_VAT, STALE_DAYS, TAX_OPTIONS, VAT
from pricelode.functions.text import folded


def cents(c: Column) -> Column:
    return F.rint(c * 100).cast("long")


def money(c: Column, digits: int = 2) -> Column:
    """Half-even on the binary value, as numpy rounds."""
    return F.rint(c * 10**digits) / 10**digits


def _position(c: Column, mark: str) -> Column:
    return F.length(c) - F.instr(F.reverse(c), mark)


def export_number(c: Column) -> Column:
    """Of two separators the last is decimal; a lone comma is decimal before one or two digits."""
    t = F.regexp_replace(F.trim(c), r"[$ ]", "")
    comma, dot = t.contains(","), t.contains(".")
    last_comma = _position(t, ",") > _position(t, ".")
    spanish = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(t, F.lit(","), F.lit(""))
    text = F.when(comma & dot, F.when(last_comma, spanish).otherwise(english)).when(comma, F.when(t.rlike(r"^-?\d+,\d{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(english)).otherwise(t)
    return text.try_cast("double")


def message_number(c: Column) -> Column:
    """Dots group thousands where a comma or groups of three say so; a comma is decimal."""
    t = F.trim(c)
    spanish = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    text = F.when(t.contains(".") & t.contains(","), spanish).when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit(""))).when(t.contains(","), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    return text.try_cast("double")


def list_number(c: Column, decimal: Column) -> Column:
    """Two digits after one separator are always decimals; else the list's convention rules."""
    t = F.regexp_replace(c, r"[$ ]", "")
    plain = F.when(decimal == ".", F.replace(t, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.when(t.rlike(r"^\d+[.,]\d{2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(plain).try_cast("double")


def price_in_cell(c: Column) -> Column:
    """The number of a cell, its digits joined: one after a peso sign first, else the first of two digits or more; empty without any."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")
    after = F.regexp_extract(t, r"\$\s*(\d[\d\s.,]*\d)", 1)
    return F.regexp_replace(F.when(after != "", after).otherwise(F.regexp_extract(t, r"(\d[\d\s.,]*\d)", 1)), r"\s+", "")


def decimal_signal(c: Column) -> Column:
    """What a price's form says about the decimal mark: strong "." or ",", else null."""
    t = F.replace(c, F.lit(" "), F.lit(""))
    return (
        F.when(t.rlike(r"^\d{1,3}(?:,\d{3})+\.\d+$"), ".")
        .when(t.rlike(r"^\d{1,3}(?:\.\d{3})+,\d+$"), ",")
        .when(t.rlike(r"^\d{4,}\.\d+$") | t.rlike(r"^\d+\.\d{1,2}$"), ".")
    )


def with_tax(net: Column, rate: Column, surcharge: Column) -> Column:
    """N6."""
    return money(net * (1 + rate) * (1 + surcharge))


def list_cost(price: Column, rate: Column, surcharge: Column, included: Column, net_business: Column) -> Column:
    """The truth table of what a list says and how the business keeps its costs."""
    return F.when(net_business, F.when(included, money(price / (1 + rate))).otherwise(price)).otherwise(F.when(included, price).otherwise(with_tax(price, rate, surcharge)))


def rate_needed(included: Column, net_business: Column) -> Column:
    """F15."""
    return included.eqNullSafe(net_business)


def option_rates(option: Column) -> tuple[Column, Column, Column, Column]:
    """(rate, per product, surcharge, included) of a list's tax option; nulls for another word."""
    table = {k: v for k, v in TAX_OPTIONS.items()}
    rate = F.lit(None).cast("double")
    per, extra, included = F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(None).cast("boolean")
    for name, (r, s, i) in table.items():
        hit = option == name
        rate = F.when(hit, F.lit(None if r == PER_PRODUCT else r).cast("double")).otherwise(rate)
        per, extra, included = F.when(hit, r == PER_PRODUCT).otherwise(per), F.when(hit, F.lit(s)).otherwise(extra), F.when(hit, F.lit(i)).otherwise(included)
    return rate, per, extra, included


def suggested_rate(name: Column) -> Column:
    """N14."""
    return F.when(folded(name).rlike(REDUCED_GOODS), REDUCED_VAT).otherwise(VAT)


def variation(new: Column, old: Column) -> Column:
    """P10: percent, one decimal; null without an old cost."""
    return F.when(old != 0, money((new / old - 1) * 100, 1))


def unchanged(new: Column, old: Column) -> Column:
    return F.abs(new - old) < CENT


def per_unit(price: Column, units: Column) -> Column:
    """A case price by its units, four decimals, where there is more than one."""
    return F.when(units > 1, money(price / units, 4)).otherwise(price)


def case_suggested(cost: Column, current: Column, units: Column) -> Column:
    """The price is far from today's as it is and near it when divided by the case's units."""
    whole, single = F.abs(cost / current - 1), F.abs(cost / units / current - 1)
    return F.coalesce((units >= 2) & (whole > 0.5) & (single < 0.35), F.lit(False))


def invoice_cost(amount: Column, quantity: Column, unit: Column) -> Column:
    """Amount by quantity where that is plausible for the unit price; else null."""
    real = money(amount / quantity)
    return F.when((quantity > 0) & (real >= unit * 0.4) & (real <= unit * 1.05), real)


def latest_date(text: Column, as_of: Column) -> Column:
    """The latest credible d/m/y date in a text: from 2000 to 60 days after ``as_of``."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}\s*[/.\-]\s*\d{1,2}\s*[/.\-]\s*\d{2,4})\b"), F.lit(1))
    tidy = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*[/.\-]\s*", "/"), r"/(\d\d)$", "/20$1"))
    dates = F.transform(tidy, lambda x: F.try_to_date(x, "d/M/yyyy"))
    return F.array_max(F.filter(dates, lambda d: (d >= F.lit("2000-01-01").cast("date")) & (d <= F.date_add(as_of, 60))))


def stale_months(day: Column, as_of: Column) -> Column:
    """Months of age of a list older than 60 days; null for a younger one."""
    age = F.datediff(as_of, day)
    return F.when(age > STALE_DAYS, F.floor(age / 30))
