"""Calendar functions as columns: moving feasts, weekday rules, deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nth_weekday(year: Column, month: int, weekday: str, n: int) -> Column:
    """The n-th weekday (``SUN`` .. ``SAT``) of a month."""
    eve = F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(eve, weekday), 7 * (n - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    """The last such weekday of a month."""
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def easter(year: Column) -> Column:
    """Easter Sunday in the Gregorian calendar, by Gauss's method with the lunar and solar corrections."""
    y = year.cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    golden = F.pmod(y, F.lit(19))
    century = div(y, 100)
    solar = century - div(century, 4)
    lunar = div(8 * century + 13, 25)
    epact = F.pmod(19 * golden + solar - lunar + 15, F.lit(30))
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    weekday = F.pmod(y + div(y, 4) + moon + 2 - solar, F.lit(7))
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), moon - weekday)


def occurrence(rule: tuple, year: Column) -> Column:
    """Date of a rule in a year.

    Rules: ("fixed", month, day), ("nth", month, weekday, n), ("last", month,
    weekday), ("easter", days), ("after", rule, days).
    """
    kind = rule[0]
    if kind == "fixed":
        return F.make_date(year, F.lit(rule[1]), F.lit(rule[2]))
    if kind == "nth":
        return nth_weekday(year, *rule[1:])
    if kind == "last":
        return last_weekday(year, *rule[1:])
    if kind == "easter":
        return F.date_add(easter(year), rule[1])
    if kind == "after":
        return F.date_add(occurrence(rule[1], year), rule[2])
    raise ValueError(f"no date rule {kind!r}")


def deadline_status(deadline: Column, today: Column, soon: int = 14) -> Column:
    days = F.datediff(deadline, today)
    return F.when(days < 0, "overdue").when(days <= soon, "due_soon").otherwise("upcoming")
