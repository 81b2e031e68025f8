"""Trading sessions as checksummed JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depthlens.sources.exchange_feed import checksum, verify_checksums

VERSION = "2.0.0"


def nest_sessions(sessions: DataFrame, signals: DataFrame, positions: DataFrame) -> DataFrame:
    """One row per session with its signals and positions nested (export only)."""
    def nested(df, name):
        cols = [c for c in df.columns if c != "session_id"]
        return df.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    return sessions.join(nested(signals, "signals"), "session_id", "left").join(
        nested(positions, "positions"), "session_id", "left")


def export_sessions(sessions: DataFrame, path: str) -> None:
    """Write version, session JSON and its checksum, one line per session."""
    payload = F.to_json(F.struct(*sessions.columns))
    sessions.select(F.lit(VERSION).alias("version"), payload.alias("session")).withColumn(
        "checksum", checksum(F.col("session"))).write.mode("overwrite").json(path)


def import_sessions(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """(sessions, quarantine): rows whose checksum does not match are set aside."""
    raw = spark.read.schema("version string, session string, checksum string").json(path)
    raw = verify_checksums(raw, "session", "checksum")
    good = raw.filter("checksum_ok").select(F.from_json("session", schema).alias("s")).select("s.*")
    return good, raw.filter("not checksum_ok").drop("checksum_ok")
