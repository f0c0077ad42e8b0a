"""Sinks and sources for result tables: Parquet first, single-file CSV for small tables, JSON for bands."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..params import DEFAULT


def sanitize_name(name: str) -> str:
    """Lower case, spaces to underscores, without parentheses and dots."""
    return re.sub(r"[().]", "", name.lower().replace(" ", "_"))


def sanitized(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), " ", "_"), "[().]", "")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.round(c, digits) for c in floats})


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local one only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="calibra-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV part with a header; for result tables of known small size."""
    rounded(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_text(lines: DataFrame, path: str) -> None:
    """The strings of one column as lines of one text file, in order; for reports of known small size."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and text of a report that write_text wrote."""
    whole = spark.read.text(path, wholetext=True)  # an empty report is written as no file or an empty one
    lines = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    return whole.where("value != ''").select(F.posexplode(lines).alias("line", "text"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_tiers(spark: SparkSession, path: str | None) -> tuple[tuple[str, float], ...]:
    """Risk-tier bands {"NAME": upper bound, ...} from a JSON file, or the default ones."""
    if path is None:
        return DEFAULT.tiers
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    return tuple(sorted(json.loads(text).items(), key=lambda kv: kv[1]))


def model_version(name: str, size: int, features: list[str]) -> str:
    """Twelve hex digits that change with the model's name, size or features."""
    return hashlib.sha256(f"{name}|{size}|{','.join(sorted(features))}".encode()).hexdigest()[:12]
