"""Column functions on time, text and numbers.

Time is a whole number of microseconds since the epoch in UTC, column `t`, so
that range frames, buckets and differences are plain arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND

_ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
_PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp; a zoneless one is read in the session zone, UTC here."""
    return F.unix_micros(ts.cast("timestamp"))


def floor_to(t: Column, step: int, anchor: int = 0) -> Column:
    """Start of the step that holds t, counted from `anchor`."""
    return F.floor((t - anchor) / F.lit(step)).cast("long") * step + anchor


def month_of(t: Column) -> Column:
    """Year and month as yyyy-MM."""
    return F.date_format(F.timestamp_micros(t), "yyyy-MM")


def number(text: Column) -> Column:
    """Number of a text; null for status words, NaN and infinities."""
    x = text.try_cast("double") if hasattr(text, "try_cast") else F.expr(f"try_cast({text} as double)")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def fold_accents(text: Column) -> Column:
    return F.translate(text, _ACCENTED, _PLAIN)


def clean_tag(name: Column, prefix: str = r"^\s*(?:\\\\[^\\]+\\)?") -> Column:
    """Name without a historian's prefix, trimmed; runs of other characters than letters, digits and _ become one _."""
    return F.regexp_replace(F.trim(F.regexp_replace(name, prefix, "")), r"[^A-Za-z0-9_]+", "_")


def protection_level(text: Column) -> Column:
    """trip, very high, very low or null by the words of an alarm text."""
    t = F.lower(fold_accents(text))
    return F.when(t.rlike(r"\btrip\b|shutdown"), "trip").when(t.rlike(r"very high|muito alt"), "very high").when(t.rlike(r"very low|muito baix"), "very low")


def parse_time(text: Column, day_first: Column) -> Column:
    """Timestamp of an ISO or slashed text; `day_first` says how slashes are read. Null for anything else."""
    iso = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    dmy, mdy = F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss"))
    return F.coalesce(iso, F.when(day_first, dmy).otherwise(mdy))


def time_shares(text: Column) -> dict[str, Column]:
    """Aggregates that choose a column's time format: the shares of texts that look slashed and ISO, and of those that don't parse in the strict ISO form; nulls count as texts."""
    s = F.coalesce(F.trim(text), F.lit(""))
    look = lambda pattern: F.avg(s.rlike(pattern).cast("double"))
    return {"slashed": look(r"^\d{1,2}/\d{1,2}/\d{4}"), "iso": look(r"^\d{4}-\d{2}-\d{2}"), "failed": F.avg(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")).isNull().cast("double"))}


def parse_by_shares(text: Column, slashed: Column, iso: Column, failed: Column) -> Column:
    """Timestamp of a text by its column's shares: slashes day first from 80 % slashed on; strictly ISO from 80 % ISO on, unless over 10 % fail; else ISO forms and slashes month first. Null for anything else."""
    s = F.trim(text)
    first = lambda *forms: F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in forms))
    iso_forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    slashes = lambda order: tuple(f"{order}/yyyy{tail}" for tail in (" H:mm:ss", " H:mm", ""))
    loose = first(*iso_forms, *slashes("M/d"))
    return F.when(slashed >= 0.8, first(*slashes("d/M"), *iso_forms)).when((iso >= 0.8) & (failed <= 0.1), first(iso_forms[0])).otherwise(loose)


def to_utc(local: Column, zone: str, shift_hours: int = 0) -> Column:
    """UTC of a local wall time; null where the wall time occurs twice.

    A wall time that a forward change skips moves forward with the change.
    """
    utc = F.to_utc_timestamp(local, zone)
    twice = (F.from_utc_timestamp(utc + F.expr("interval 1 hour"), zone) == local) | (F.from_utc_timestamp(utc - F.expr("interval 1 hour"), zone) == local)
    return F.when(~twice, utc + F.expr(f"interval {shift_hours} hours"))


def margin_used(x: Column, typical: Column, high: Column, very_high: Column) -> Column:
    """Share of the way from the typical value to the limit, the very high one if there is one; 0 at least."""
    limit = F.coalesce(very_high, high)
    return F.greatest(F.lit(0.0), F.when(limit != typical, (x - typical) / (limit - typical)))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Limits of a proportion."""
    p, zz = hits / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def poisson_limits(count: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Limits of a Poisson mean by the cube form: k (1 - 1/(9k) -+ z/(3 sqrt k))^3."""
    k = count.cast("double")
    low = F.when(k > 0, k * F.pow(1 - 1 / (9 * k) - z / (3 * F.sqrt(k)), F.lit(3.0))).otherwise(0.0)
    k1 = k + 1
    return low, k1 * F.pow(1 - 1 / (9 * k1) + z / (3 * F.sqrt(k1)), F.lit(3.0))
