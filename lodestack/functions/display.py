"""How values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def money_display(c: Column) -> Column:
    """85k for whole thousands, else digits in groups; empty for null."""
    whole = (c >= 1000) & (c % 1000 == 0)
    rounded = F.bround(c, 0)
    return F.when(c.isNull(), "").when(whole, F.concat((c / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(F.format_number(rounded, 0))


def salary_display(low: Column, high: Column, currency: Column) -> Column:
    a, b, code = money_display(low), money_display(high), F.coalesce(currency, F.lit(""))
    one = F.trim(F.concat(code, F.lit(" "), F.when(a != "", a).otherwise(b)))
    both = F.trim(F.concat(code, F.lit(" "), a, F.lit(" – "), b))
    return F.when(low.isNull() & high.isNull(), NOTHING).when((a != "") & (b != "") & (a != b), both).otherwise(one)


def posted_display(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(NOTHING))


def share_display(part: Column, whole: Column) -> Column:
    """Percent of whole, or a dash when there is nothing to share."""
    return F.when(whole > 0, F.format_string("%.0f%%", F.bround(100.0 * part / whole, 0))).otherwise(NOTHING)
