"""Reading and writing sensor tables, alarm logs, events and parameters. Schemas are explicit; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantwatch.functions.columns import clean_tag, floor_to, fold_accents, micros, number
from plantwatch.operators.episodes import episodes

#: canonical name -> fragments of the headers that mean it, accents and case folded; fixed words of given files
ALARM_HEADERS = {"ts": ("data da ocorr", "date", "timestamp", "time"), "tag": ("tag alarme", "tag"), "condition": ("condic", "condition"), "priority": ("priori",), "status": ("status",), "description": ("descri",)}


def wide_csv(spark: SparkSession, path: str, columns: Sequence[str], time: str | None = None, asset: str | None = "0", prefix: str = "", keep: Sequence[str] | None = None) -> DataFrame:
    """Long rows (asset, tag, t, value) of CSV files with one column a tag.

    `columns` are the headers in order; the first is the time if none is named.
    Every tag is read as text and coerced: status words, NaN and infinities
    become null. Rows without a time are dropped; a time without a zone is UTC.
    With `asset` None the files have a column of whole numbers with that name.
    Only the columns of `keep`, where given, are parsed.
    """
    time = columns[0] if time is None else time
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, header=True).withColumn("t", micros(F.expr(f"try_cast(`{time}` as timestamp)"))).where("t is not null")
    rows = rows if asset is not None else rows.withColumn("asset", F.expr("try_cast(asset as bigint)"))
    tags = [c for c in columns if c not in (time, *([] if asset is not None else ["asset"])) and (keep is None or c in keep)]
    return to_long(rows, tags, asset, prefix)


def to_long(wide: DataFrame, tags: Sequence[str], asset: str | None = None, prefix: str = "") -> DataFrame:
    """(asset, tag, t, value) of a wide table with a column t; `prefix` is stripped from the tag names."""
    rows = wide.select(F.lit(asset).alias("asset") if asset is not None else F.col("asset"), "t", *(number(F.col(f"`{c}`").cast("string")).alias(c) for c in tags))
    return rows.unpivot(["asset", "t"], list(tags), "tag", "value").withColumn("tag", clean_tag(F.regexp_replace("tag", f"^{prefix}", "") if prefix else F.col("tag"))).select("asset", "tag", "t", "value")


def alarm_log(raw: DataFrame, headers: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Alarm rows under canonical names: several headers that mean one thing are coalesced, those that are missing are null."""
    plain = {c: c.lower().translate(str.maketrans("áàâãéêíóôõúüç", "aaaaeeiooouuc")) for c in raw.columns}
    out, used = [], set()
    for name, fragments in (headers or ALARM_HEADERS).items():
        found = [c for part in fragments for c in raw.columns if part in plain[c] and c not in used]
        used.update(found)
        out.append((F.coalesce(*(F.col(f"`{c}`") for c in dict.fromkeys(found))) if found else F.lit(None).cast("string")).alias(name))
    return raw.select(*out).withColumn("condition", F.upper(fold_accents(F.col("condition"))))


def consolidate(eras: Sequence[tuple[DataFrame, int, int | None, int | None]]) -> DataFrame:
    """One table of several: each era's t is shifted, then cut to [from, until); columns must be the same, or it is an error."""
    out = None
    for df, shift, start, end in eras:
        part = df.withColumn("t", F.col("t") + shift)
        part = part.where(F.col("t") >= start) if start is not None else part
        part = part.where(F.col("t") < end) if end is not None else part
        out = part if out is None else out.unionByName(part, allowMissingColumns=False)
    if out is None:
        raise ValueError("no era is given")
    return out


def trips_json(text: DataFrame, column: str = "value") -> DataFrame:
    """(t): sorted distinct trips of JSON lists, or of objects with a list `trips`; anything else gives none."""
    lists = F.coalesce(F.from_json(column, "array<string>"), F.from_json(column, "struct<trips:array<string>>")["trips"])
    return text.select(F.explode(lists).alias("s")).select(micros(F.expr("try_cast(s as timestamp)")).alias("t")).where("t is not null").distinct().orderBy("t")


def trips(spark: SparkSession, path: str, how: str = "csv") -> DataFrame:
    """(t): sorted distinct trips of CSV files with a column `evento`, or of JSON texts as in trips_json(); none where the path doesn't exist."""
    try:
        if how == "json":
            return trips_json(spark.read.text(path, wholetext=True))
        rows = spark.read.csv(path, header=True).select(F.col("evento").alias("s"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "t long")
    return rows.select(micros(F.expr("try_cast(s as timestamp)")).alias("t")).where("t is not null").distinct().orderBy("t")


def grid_job(raw: DataFrame, path: str, step: int, low: float, high: float) -> None:
    """Masks values out of [low, high], takes the median of each `step` of time, and writes the grid; a step is whole wherever its rows lie."""
    inside = F.when(F.col("value").between(low, high), F.col("value"))
    write_grid(raw.groupBy("asset", "tag", floor_to(F.col("t"), step).alias("t")).agg(F.percentile(inside, 0.5).alias("value")), path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Window scores (tag, seq_start, mae_seq, is_anom_seq, ...) as Parquet by tag."""
    scores.repartition("tag").write.mode("overwrite").partitionBy("tag").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a row a tag, or of a few, as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def episode_summary(alerts: DataFrame, gap: int) -> DataFrame:
    """(asset, start, end, hours, strength, channels) of alerts (asset, t, strength, channels): one row an alarm, with the greatest of both."""
    rows = episodes(alerts, ["asset"], gap, strength=F.max("strength"), channels=F.max("channels"))
    return rows.select("asset", "start", "end", ((F.col("end") - F.col("start")) / 3.6e9).alias("hours"), "strength", "channels")


def write_grid(df: DataFrame, path: str) -> None:
    """Parquet by asset and month, so that a date filter reads only its months."""
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM")
    df.withColumn("month", month).repartition("asset", "month").sortWithinPartitions("tag", "t").write.mode("overwrite").partitionBy("asset", "month").parquet(path)


def read_grid(spark: SparkSession, path: str, tags: Sequence[str] | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """Rows of a written grid; months prune folders, tags reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("month").isin(*months)) if months else df
    return (df.where(F.col("tag").isin(*tags)) if tags else df).select("asset", "tag", "t", "value")


def bundle_json(text: DataFrame, column: str = "value") -> DataFrame:
    """(sensor, time_steps, center, scale, threshold, half_life_hours, ewma_abs_threshold, debounce_hours) of inference bundles."""
    schema = "sensor string, time_steps int, center double, scale double, threshold double, production_alerting struct<half_life_hours:double,ewma_abs_threshold:double,debounce_hours:double>"
    return text.select(F.from_json(column, schema).alias("b")).select("b.sensor", "b.time_steps", "b.center", "b.scale", "b.threshold", "b.production_alerting.*").where("sensor is not null")


def expired(models: DataFrame, now: int, days: int = 62) -> DataFrame:
    """`models` with expired: the newest baseline of the asset ended more than `days` before `now`."""
    newest = models.groupBy("asset").agg(F.max("baseline_end").alias("_n"))
    return models.join(newest, "asset").withColumn("expired", F.lit(now) - F.col("_n") > days * 86_400_000_000).drop("_n")


@dataclass(frozen=True)
class Config:
    """Options of a run; unknown names are an error."""

    time_steps: int = 30
    stride: int = 1
    interpolate_limit: int = 3
    hampel_half: int = 2
    hampel_sigma: float = 3.0
    threshold_quantile: float = 0.995
    half_life_hours: float = 4.0
    debounce_hours: float = 1.0
    skip_conditions: tuple[str, ...] = field(default=("CFN",))

    @classmethod
    def of(cls, options: dict[str, object]) -> Config:
        unknown = set(options) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        return cls(**options)  # type: ignore[arg-type]
