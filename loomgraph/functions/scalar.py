"""Scalar functions: name to a function of columns.  Value semantics follow openCypher where Spark's differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DURATION = "struct<months:bigint,days:bigint,seconds:bigint,nanos:int>"


def to_integer(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        real = c.try_cast("double")
        return F.coalesce(c.try_cast("long"), F.when((real >= -(2.0**63)) & (real < 2.0**63), real).try_cast("long"))
    if isinstance(t, T.BooleanType):
        return c.cast("long")
    if isinstance(t, T.FractionalType):
        fits = (c >= -(2.0**63)) & (c < 2.0**63)
        return F.when(F.isnan(c.cast("double")), F.lit(None)).when(fits | c.isNull(), F.when(fits, c).cast("long")).otherwise(F.raise_error(F.lit("a float beyond the range of integers")).cast("long"))
    return c.try_cast("long")


def to_boolean(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        low = F.lower(F.trim(c))
        return F.when(low == "true", True).when(low == "false", False)
    return (c != 0) if isinstance(t, T.IntegralType) else c.try_cast("boolean")


def to_string(c: Column, t: T.DataType) -> Column:
    return c.cast("string")


def cypher_range(a: Column, b: Column, step: Column | None = None) -> Column:
    """Empty where the step leads away from the end."""
    step = F.lit(1).cast("long") if step is None else step.cast("long")
    a, b = a.cast("long"), b.cast("long")
    none = F.array().cast("array<bigint>")
    return F.when(step == 0, F.raise_error(F.lit("range step is 0")).cast("array<bigint>")).when((step > 0) & (a > b), none).when((step < 0) & (a < b), none).otherwise(F.sequence(a, b, F.when(((step > 0) & (a > b)) | ((step < 0) & (a < b)) | (step == 0), F.when(a <= b, F.lit(1)).otherwise(F.lit(-1)).cast("long")).otherwise(step)))


def left(s: Column, n: Column) -> Column:
    return F.when(n < 0, F.raise_error(F.lit("negative length")).cast("string")).otherwise(F.left(s, n.cast("int")))


def right(s: Column, n: Column) -> Column:
    return F.when(n < 0, F.raise_error(F.lit("negative length")).cast("string")).otherwise(F.right(s, n.cast("int")))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    start = start.cast("int")
    return F.when(start < 0, F.raise_error(F.lit("negative start")).cast("string")).otherwise(F.substring(s, start + 1, F.length(s) if length is None else length.cast("int")))


def split(s: Column, by: Column) -> Column:
    return F.when(by == "", F.split(s, "")).otherwise(F.split(s, F.regexp_replace(by, r"([\\^$.|?*+()\[\]{}])", r"\\$1")))


def reverse(c: Column) -> Column:
    return F.reverse(c)


def truncate(kind: str, unit: str, source: Column) -> Column:
    """Start of the unit; decades, centuries and millennia by year arithmetic, which date_trunc lacks."""
    unit = unit.lower()
    years = {"decade": 10, "century": 100, "millennium": 1000}
    if unit in years:
        y = F.year(source)
        out = F.make_timestamp(y - F.pmod(y, F.lit(years[unit])), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    elif unit == "weekyear":
        out = F.date_trunc("week", F.make_date(F.extract(F.lit("YEAROFWEEK"), source), F.lit(1), F.lit(4)))
    else:
        out = F.date_trunc(unit, source)
    return out.cast("date" if kind == "date" else "timestamp_ntz" if kind == "localdatetime" else "timestamp")


def make_date(fields: dict[str, Column]) -> Column:
    if "week" in fields:
        first = F.date_trunc("week", F.make_date(fields["year"].cast("int"), F.lit(1), F.lit(4))).cast("date")
        return F.date_add(first, ((fields["week"] - 1) * 7 + fields.get("dayOfWeek", F.lit(1)) - 1).cast("int"))
    if "ordinalDay" in fields:
        return F.date_add(F.make_date(fields["year"].cast("int"), F.lit(1), F.lit(1)), (fields["ordinalDay"] - 1).cast("int"))
    if "quarter" in fields:
        first = F.make_date(fields["year"].cast("int"), ((fields["quarter"] - 1) * 3 + 1).cast("int"), F.lit(1))
        return F.date_add(first, (fields.get("dayOfQuarter", F.lit(1)) - 1).cast("int"))
    return F.make_date(*[fields.get(k, F.lit(1)).cast("int") for k in ("year", "month", "day")])


def make_duration(fields: dict[str, Column]) -> Column:
    def g(k: str) -> Column:
        return fields.get(k, F.lit(0))

    seconds = g("hours") * 3600 + g("minutes") * 60 + g("seconds")
    return F.struct((g("years") * 12 + g("quarters") * 3 + g("months")).cast("long").alias("months"), (g("weeks") * 7 + g("days")).cast("long").alias("days"), F.floor(seconds).cast("long").alias("seconds"), ((seconds - F.floor(seconds)) * 1000000000 + g("milliseconds") * 1000000 + g("microseconds") * 1000 + g("nanoseconds")).cast("int").alias("nanos"))


def parse_duration(s: Column) -> Column:
    def part(letter: str, behind_t: bool) -> Column:
        text = F.regexp_extract(s, r"T(.*)$" if behind_t else r"^-?P([^T]*)", 1)
        v = F.regexp_extract(text, rf"(-?\d+(?:\.\d+)?){letter}", 1)
        return F.coalesce(F.when(v != "", v).try_cast("double"), F.lit(0.0))

    out = make_duration({"years": part("Y", False), "months": part("M", False), "weeks": part("W", False), "days": part("D", False), "hours": part("H", True), "minutes": part("M", True), "seconds": part("S", True)})
    return F.when(s.rlike(r"^-?P(?=.)"), out)


def add_duration(c: Column, t: T.DataType, d: Column, sign: int) -> Column:
    months, days, seconds = (d[k] * sign for k in ("months", "days", "seconds"))
    if isinstance(t, T.DateType):
        return F.date_add(F.add_months(c, months.cast("int")), (days + F.floor(seconds / 86400)).cast("int"))
    stamp = c + F.make_interval(months=months.cast("int"), days=days.cast("int"), secs=(seconds + d["nanos"] * sign / 1000000000).cast("decimal(18,6)"))
    return stamp.cast(t)


def between(a: Column, b: Column, unit: str) -> Column:
    """Duration from a to b: in seconds, days, months, or months then days then seconds."""
    a, b = a.cast("timestamp"), b.cast("timestamp")
    zero = F.lit(0).cast("long")
    secs = F.unix_micros(b) - F.unix_micros(a)
    months = F.when(secs >= 0, F.floor(F.months_between(b, a))).otherwise(-F.floor(F.months_between(a, b))).cast("long")
    if unit == "months":
        parts = (months, zero, zero, F.lit(0))
    elif unit == "days":
        parts = (zero, F.expr("0").cast("long") + F.signum(secs.cast("double")).cast("long") * F.floor(F.abs(secs) / 86400000000).cast("long"), zero, F.lit(0))
    elif unit == "seconds":
        parts = (zero, zero, F.floor(secs / 1000000).cast("long"), (F.pmod(secs, F.lit(1000000)) * 1000).cast("int"))
    else:
        rest = F.unix_micros(b) - F.unix_micros(F.add_months(a.cast("date"), months.cast("int")).cast("timestamp")) - (F.unix_micros(a) - F.unix_micros(F.date_trunc("day", a)))
        days = F.signum(rest.cast("double")).cast("long") * F.floor(F.abs(rest) / 86400000000).cast("long")
        left_ = rest - days * 86400000000
        parts = (months, days, F.floor(left_ / 1000000).cast("long"), (F.pmod(left_, F.lit(1000000)) * 1000).cast("int"))
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("months", "days", "seconds", "nanos"), strict=True)])


ACCESSORS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.day, "quarter": F.quarter, "week": F.weekofyear, "hour": F.hour, "minute": F.minute, "second": F.second,
    "ordinalDay": F.dayofyear, "weekDay": lambda c: F.weekday(c) + 1, "dayOfWeek": lambda c: F.weekday(c) + 1, "weekYear": lambda c: F.extract(F.lit("YEAROFWEEK"), c),
    "dayOfQuarter": lambda c: F.datediff(c, F.date_trunc("quarter", c)) + 1,
    "millisecond": lambda c: F.pmod(F.unix_millis(c.cast("timestamp")), F.lit(1000)), "microsecond": lambda c: F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1000000)),
    "epochSeconds": lambda c: F.unix_seconds(c.cast("timestamp")), "epochMillis": lambda c: F.unix_millis(c.cast("timestamp")),
}
DURATION_ACCESSORS: dict[str, Callable[[Column], Column]] = {
    "years": lambda d: F.floor(d["months"] / 12), "quarters": lambda d: F.floor(d["months"] / 3), "months": lambda d: d["months"], "weeks": lambda d: F.floor(d["days"] / 7), "days": lambda d: d["days"],
    "hours": lambda d: F.floor(d["seconds"] / 3600), "minutes": lambda d: F.floor(d["seconds"] / 60), "seconds": lambda d: d["seconds"], "milliseconds": lambda d: d["seconds"] * 1000 + F.floor(d["nanos"] / 1000000),
    "monthsOfYear": lambda d: F.pmod(d["months"], F.lit(12)), "minutesOfHour": lambda d: F.pmod(F.floor(d["seconds"] / 60), F.lit(60)), "secondsOfMinute": lambda d: F.pmod(d["seconds"], F.lit(60)), "nanosecondsOfSecond": lambda d: d["nanos"],
}


def _double(f):
    return lambda *cs: f(*[c.cast("double") for c in cs])


#: Functions that need no argument types.
SIMPLE: dict[str, Callable[..., Column]] = {
    "coalesce": F.coalesce, "nullif": F.nullif, "abs": F.abs, "ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"),
    "round": lambda c, d=None: F.round(c.cast("double"), d) if d is not None else F.round(c.cast("double")), "sign": lambda c: F.signum(c.cast("double")).cast("long"), "sqrt": _double(F.sqrt),
    "exp": _double(F.exp), "log": _double(F.log), "log10": _double(F.log10), "sin": _double(F.sin), "cos": _double(F.cos), "tan": _double(F.tan), "cot": _double(F.cot), "asin": _double(F.asin), "acos": _double(F.acos), "atan": _double(F.atan), "atan2": _double(F.atan2),
    "degrees": _double(F.degrees), "radians": _double(F.radians), "pi": F.pi, "e": F.e, "rand": F.rand, "haversin": _double(lambda c: (1 - F.cos(c)) / 2),
    "isnan": lambda c: F.when(c.isNotNull(), F.isnan(c.cast("double"))),
    "tolower": F.lower, "toupper": F.upper, "lower": F.lower, "upper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "btrim": F.btrim, "left": left, "right": right, "substring": substring,
    "replace": F.replace, "split": split, "head": lambda c: F.try_element_at(c, F.lit(1)), "last": lambda c: F.try_element_at(c, F.lit(-1)), "tail": lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))),
    "range": cypher_range, "sort": F.array_sort, "timestamp": lambda: F.unix_millis(F.current_timestamp()), "randomuuid": F.uuid, "extract": lambda c: c, "filter": lambda c: c,
}
