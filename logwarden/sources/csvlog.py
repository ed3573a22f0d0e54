"""CSV sources and Parquet sinks of the login log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header of the raw log and the names used here (three columns are not read).
RAW_COLUMNS = {
    "index": "row_id", "Login Timestamp": "ts", "User ID": "user_id", "IP Address": "ip", "Country": "country", "City": "city", "ASN": "asn",
    "User Agent String": "ua", "Browser Name and Version": "browser", "OS Name and Version": "os", "Device Type": "device_type",
    "Login Successful": "success", "Is Attack IP": "is_attack_ip", "Is Account Takeover": "is_ato",
}
FAKE_ASN_FROM = 500_000


def strict_bool(c: Column) -> Column:
    """Exactly ``True`` / ``False``; anything else fails the job."""
    return F.when(c == "True", F.lit(True)).when(c == "False", F.lit(False)).otherwise(
        F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(c, F.lit("NULL")))).cast("boolean")
    )


def typed(raw: DataFrame) -> DataFrame:
    """Rename, cast and flag raw string columns; an empty string is missing, ``NA`` is a country."""
    cols = [F.when(F.col(f"`{src}`") != "", F.col(f"`{src}`")).alias(dst) for src, dst in RAW_COLUMNS.items() if src in raw.columns]
    df = raw.select(*cols)
    casts = {"row_id": F.col("row_id").cast("bigint"), "ts": F.col("ts").cast("timestamp"), "user_id": F.col("user_id").cast("bigint"), "asn": F.col("asn").cast("int")}
    bools = {c: strict_bool(F.col(c)) for c in ("success", "is_attack_ip", "is_ato")}
    return df.withColumns({**casts, **bools}).withColumns(artifact_flags())


def artifact_flags() -> dict[str, Column]:
    return {
        "is_private_ip": F.col("ip").startswith("10."),
        "is_fake_asn": F.coalesce(F.col("asn") >= FAKE_ASN_FROM, F.lit(False)),
        "ua_parse_failed": F.col("device_type").isNull(),
    }


def read_login_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw log: header, everything read as text, then typed."""
    return typed(spark.read.option("header", True).option("nullValue", "").option("quote", '"').option("escape", '"').csv(path))


def write_events(df: DataFrame, path: str, *, order: str = "t") -> None:
    """Zstd Parquet by day, time-ordered within files; the commit protocol makes it atomic."""
    day = df.withColumn("day", F.to_date(F.timestamp_micros(F.col(order))))
    (
        day.repartitionByRange("day", order)
        .sortWithinPartitions("day", order)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .partitionBy("day")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_range(df: DataFrame, start_us: int | None = None, end_us: int | None = None, *, limit: int | None = None, ordered: bool = False) -> DataFrame:
    """Half-open time range, optionally ordered and limited; filters reach the scan."""
    out = df
    if start_us is not None:
        out = out.where(F.col("t") >= start_us)
    if end_us is not None:
        out = out.where(F.col("t") < end_us)
    if ordered or limit is not None:
        out = out.orderBy("t", "row_id")
    return out if limit is None else out.limit(limit)


def read_ip_list(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame] | None:
    """(networks, counts) of a text list; ``None`` when the file does not exist - not the same as empty."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        return None
    from ..operators.joins import parse_networks

    lines = spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("cidr")).where("cidr <> ''")
    marked = lines.withColumn("list", F.lit(name))
    good = parse_networks(marked)
    counts = marked.agg(F.count(F.lit(1)).alias("lines")).join(F.broadcast(good.agg(F.count(F.lit(1)).alias("valid"))))
    return good, counts.withColumn("invalid", F.col("lines") - F.col("valid"))


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str, lower: int, upper: int, parts: int) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
        .load()
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("login_event_id bigint, username string, is_anomaly int, anomaly_type string").option("header", True).csv(path)


def write_features_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)
