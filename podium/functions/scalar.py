"""Column expressions used across operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400.0
#: The usual plausible window of epoch seconds, end excluded.
FIRST_S, LAST_S = 1609459200, 1767225600


def epoch_seconds(x: Column, window: tuple[int, int] = (FIRST_S, LAST_S)) -> Column:
    """A count in s, ms, us or ns as seconds, by which unit puts it into the window; null if none does."""
    out = F.lit(None).cast("double")
    for unit in (1e9, 1e6, 1e3, 1.0):
        out = F.when((x >= window[0] * unit) & (x < window[1] * unit), x / unit).otherwise(out)
    return F.when(~F.isnan(x), out)


def decay(ts: Column, now: float, rate: float) -> Column:
    """exp(-rate * days since ts)."""
    return F.exp(-(F.lit(now) - ts) / DAY * rate)


def half_life_rate(days: float) -> float:
    """Rate per day of a half-life; 0 (no decay) for half-lives that aren't positive."""
    return math.log(2) / days if days > 0 else 0.0


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cut(x: Column, breaks: list[float], labels: list[str]) -> Column:
    """Label of the right-closed interval that x lies in; null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for b, label in zip(breaks, labels, strict=False):
        out = out.when(x <= b, label)
    return out.otherwise(labels[-1])


def bradley_terry(a: Column, b: Column, alpha: float = 1.0, eps: float = 1e-12) -> Column:
    """Chance that a beats b: a^alpha / (a^alpha + b^alpha)."""
    return 1 / (1 + F.exp(-alpha * (F.log(F.greatest(a, F.lit(eps))) - F.log(F.greatest(b, F.lit(eps))))))


def logistic(a: Column, b: Column, alpha: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-alpha * (a - b)))


def geometric_mean(x: Column, eps: float = 1e-10) -> Column:
    return F.exp(F.avg(F.log(x + eps)))


def log_centered(df: DataFrame, value: str, eps: float = 1e-10) -> DataFrame:
    """`df` with the value divided by the geometric mean of all."""
    centre = df.agg(F.avg(F.log(F.col(value) + eps))).first()[0] or 0.0
    return df.withColumn(value, F.col(value) / F.lit(math.exp(centre)))


def points(ordinal: Column) -> Column:
    """Queue points of a skill ordinal."""
    return 15 * ordinal + 1000


def url_id(x: Column) -> Column:
    """The first number that is a whole path segment of an address, null without one."""
    n = F.regexp_extract(x, r"^[^?#]*?/(\d+)(?:[/?#]|$)", 1)
    return F.when(n != "", n.try_cast("long"))


def moment_ms(x: Column) -> Column:
    """Epoch seconds or milliseconds, a date (its last millisecond) or an ISO time (UTC without a zone) as epoch milliseconds;
    null for anything else."""
    t = F.trim(x)
    n = t.try_cast("long")
    day = F.unix_millis(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))) + 86_399_999
    return F.when(t.rlike(r"^-?\d+$"), F.when(F.abs(n) < 10**11, n * 1000).otherwise(n)).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).otherwise(F.unix_millis(F.try_to_timestamp(t)))


def time_windows(spark: SparkSession, start: int, end: int, width: int, stride: int | None = None) -> DataFrame:
    """(window, first, last): windows of `width` every `stride` (or `width`) from start, the last one cut at the end."""
    stride = stride or width
    n = max(0, -(-(end - start) // stride))
    return spark.range(n).select(F.col("id").alias("window"), (F.lit(start) + F.col("id") * stride).alias("first"), F.least(F.lit(start) + F.col("id") * stride + width, F.lit(end)).alias("last"))


def weeks(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(year, week, monday): the ISO weeks that the days from first to last lie in."""
    day = F.explode(F.sequence(F.date_trunc("week", F.to_date(F.lit(first))).cast("date"), F.to_date(F.lit(last)), F.expr("interval 7 days"))).alias("monday")
    return spark.range(1).select(day).select(F.extract(F.lit("YEAROFWEEK"), F.col("monday")).alias("year"), F.weekofyear("monday").alias("week"), "monday")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def squeezed(x: Column) -> Column:
    """Without outer spaces and with single ones inside."""
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def country(x: Column) -> Column:
    """Two upper-case letters, null if blank."""
    c = F.upper(F.substring(F.trim(x), 1, 2))
    return F.when(c != "", c)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "t", "yes"), F.lit(False))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames columns that are there to names that aren't yet."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})
