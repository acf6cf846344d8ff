"""Small text sources and sinks: parameter files, reports, statistics snapshots."""

from __future__ import annotations

from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.model import PARAM_BOUNDS, PolicyParams


def load_params(spark: SparkSession, path: str, current: PolicyParams = PolicyParams()) -> PolicyParams:
    """Policy parameters from flat JSON text, each clamped; members that are missing keep their value. Text without braces is refused."""
    text = spark.read.text(path, wholetext=True)
    number = lambda n: F.nullif(F.regexp_extract("value", rf'"{n}"\s*:\s*(-?[0-9]+(?:\.[0-9]+)?)', 1), F.lit("")).try_cast("double")
    columns = [S.clamp(n, number(n), F.lit(float(getattr(current, n)))).alias(n) for n in PARAM_BOUNDS]
    row = text.select(F.col("value").contains("{") & F.col("value").contains("}"), F.coalesce(S.meta_string(F.col("value"), "version"), F.lit(current.version)).alias("version"), *columns).first()
    if row is None or not row[0]:
        raise ValueError("not a parameter file")
    kinds = {f.name: type(getattr(current, f.name)) for f in fields(PolicyParams)}
    return PolicyParams(**{n: kinds[n](row[n]) for n in kinds})


def reload_params(spark: SparkSession, path: str, current: PolicyParams) -> tuple[PolicyParams, str | None]:
    """The parameters in force after CONFIG SET PARAMS, and why it is refused (None: it is answered OK); a refused one changes nothing."""
    try:
        return load_params(spark, path, current), None
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return current, "params file not found"
    except ValueError:
        return current, "invalid schema"


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """miss_rate, avg_size_bytes of a JSON statistics snapshot, with defaults."""
    rows = spark.read.schema("miss_rate double, avg_size_bytes double").json(path, multiLine=True)
    return rows.select(F.coalesce("miss_rate", F.lit(0.1)).alias("miss_rate"), F.coalesce("avg_size_bytes", F.lit(1024.0)).alias("avg_size_bytes"))


# What a file of tuned parameters holds beside the weights.
TUNED_VERSION = "tuner-v1"
TUNED_THRESHOLDS = {"admit_threshold": 0.0, "evict_pressure": 0.85}
TUNED_GUARDRAILS = {"max_evictions_per_second": 50_000, "max_admissions_per_second": 50_000}
TUNED_PRIORS = {"default": 0.5, "premium": 0.7}
TUNED_RANGES = {"w_miss": (0.0, 1000.0), "w_reuse": (0.0, 1000.0), "w_mem": (0.0, 1000.0), "w_risk": (0.0, 1000.0), "evict_pressure": (0.1, 1.0)}


def tuned_json(weights: DataFrame, *carry: str) -> DataFrame:
    """One JSON text (value) for each row of ``weights``, beside the columns ``carry``: version, weights, thresholds, guardrails, priors of owners, ranges."""
    fixed = lambda values: F.struct(*(F.lit(v).alias(k) for k, v in values.items()))
    priors = F.struct(*(F.struct(F.lit(v).alias("p_reuse_prior")).alias(k) for k, v in TUNED_PRIORS.items()))
    ranges = F.struct(*(F.array(*map(F.lit, v)).alias(k) for k, v in TUNED_RANGES.items()))
    names = ("w_miss", "w_reuse", "w_mem", "w_risk")
    parts = [F.lit(TUNED_VERSION).alias("version"), F.struct(*names).alias("weights"), fixed(TUNED_THRESHOLDS).alias("thresholds"), fixed(TUNED_GUARDRAILS).alias("guardrails"), priors.alias("per_owner_priors"), ranges.alias("ranges")]
    return weights.select(*carry, F.to_json(F.struct(*parts)).alias("value"))


def save_tuned(weights: DataFrame, path: str) -> None:
    """Tuned parameters as JSON text."""
    tuned_json(weights).write.mode("overwrite").text(path)


def parse_report(reports: DataFrame, column: str = "report") -> DataFrame:
    """Report texts of name:value lines as a map; of repeated names the first counts."""
    lines = F.filter(F.split(column, "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x)).alias("v"))
    pairs = F.transform(lines, pair)
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return reports.withColumn("values", F.map_from_entries(first))
