"""File sources and sinks besides plain tables: CSV references, timelines, samples, metrics, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranking import running_sums
from tidemark.sources.tables import write_table

# Columns of the four reference files.
REFERENCE_SCHEMAS = {
    "thresholds": (
        "concept_id int, male_range_low double, male_range_high double, female_range_low double, female_range_high double"
    ),
    "unit_thresholds": (
        "concept_id int, unit string, male_range_low double, male_range_high double, "
        "female_range_low double, female_range_high double"
    ),
    "units_to_drop": "concept_id int, unit string",
    "out_of_range": "concept_id int, unit string, lower_bound double, upper_bound double",
}

METRICS_TYPE = "map<string, map<string, map<string, double>>>"


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with a header; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_reference_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


# ---------------------------------------------------------------- timelines

TIMELINE_SCHEMA = "person_id bigint, dates array<string>, visits array<array<string>>"


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON person timelines as one row per person, date and concept."""
    people = spark.read.schema(TIMELINE_SCHEMA).json(path)
    visits = people.select("person_id", F.explode(F.arrays_zip("dates", "visits")).alias("v"))
    return visits.select(
        "person_id", F.to_date("v.dates").alias("event_date"), F.explode("v.visits").alias("concept")
    )


def timeline_records(events: DataFrame) -> DataFrame:
    """One record per person: sorted dates and the distinct concepts of each date.

    Repeated events collapse in the first aggregation, so a record is bounded by
    the person's distinct (date, concept) pairs.
    """
    visits = events.groupBy("person_id", "event_date").agg(F.sort_array(F.collect_set("concept")).alias("visit"))
    entry = F.struct(F.col("event_date").cast("string").alias("date"), "visit")
    people = visits.groupBy("person_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return people.select("person_id", F.col("entries.date").alias("dates"), F.col("entries.visit").alias("visits"))


def write_timelines(events: DataFrame, path: str) -> None:
    timeline_records(events).write.mode("overwrite").json(path)


# ------------------------------------------------------------------ samples


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples in one folder per year and split, in files of even size."""
    write_table(samples, path, ["year", "split"])


def read_samples(spark: SparkSession, path: str, year: int | None = None, split: str | None = None) -> DataFrame:
    """Samples of all or one year and split; only the folders asked for are read."""
    samples = spark.read.parquet(path)
    if year is not None:
        samples = samples.where(F.col("year") == year)
    return samples if split is None else samples.where(F.col("split") == split)


# ------------------------------------------------------------------ metrics


def parse_metrics(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested metric JSON (model year, evaluation year, metric) as typed long rows."""
    parsed = df.select(*keep, F.from_json(column, METRICS_TYPE).alias("m"))
    models = parsed.select(*keep, F.explode("m").alias("model_year", "m"))
    years = models.select(*keep, "model_year", F.explode("m").alias("eval_year", "m"))
    metrics = years.select(*keep, "model_year", "eval_year", F.explode("m").alias("metric", "value"))
    return metrics.withColumn("model_year", F.col("model_year").cast("int")).withColumn(
        "eval_year", F.col("eval_year").cast("int")
    )


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, with the file it came from."""
    files = spark.read.option("wholetext", True).text(path).withColumn("source", F.input_file_name())
    return parse_metrics(files, "value", ["source"])


def metrics_json(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long metric rows as one nested JSON document per group; years become string keys."""

    def nested(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
        entry = F.struct(F.col(name).cast("string"), F.col(value))
        entries = F.map_from_entries(F.sort_array(F.collect_list(entry)) if value == "value" else F.collect_list(entry))
        return df.groupBy(*keys).agg(entries.alias("m"))

    per_pair = nested(metrics, [*by, "model_year", "eval_year"], "metric", "value")
    per_model = nested(per_pair, [*by, "model_year"], "eval_year", "m")
    whole = nested(per_model, by, "model_year", "m")
    return whole.select(*by, F.to_json("m").alias("metrics_json"))


def write_metrics_json(metrics: DataFrame, path: str, by: Sequence[str]) -> None:
    """One JSON document per group, in a folder named after the group."""
    metrics_json(metrics, by).write.partitionBy(*by).text(path)


# ------------------------------------------------------------------ results


def collect_results(
    spark: SparkSession, path: str, schema: str, exclude: DataFrame | None = None, expected: DataFrame | None = None,
    incomplete: bool = True,
) -> DataFrame:
    """Result CSVs of many tasks (one folder per task), without excluded tasks.

    ``expected`` lists the tasks that should be there. With ``incomplete`` off,
    any missing task stops the collection.
    """
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    rows = rows.withColumn("task_folder", F.regexp_extract(F.input_file_name(), r"task=([^/]+)/", 1))
    if exclude is not None:
        rows = rows.join(exclude, rows.task_folder == exclude.task, "left_anti")
    if expected is not None and not incomplete:
        missing = missing_tasks(rows, expected if exclude is None else expected.join(exclude, "task", "left_anti"))
        if not missing.isEmpty():
            raise FileNotFoundError("results of some tasks are missing")
    return rows


def missing_tasks(results: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(results.select(F.col("task_folder").alias("task")), "task", "left_anti")


# --------------------------------------------------------------------- text


def delimited(df: DataFrame, columns: Sequence[str], separator: str = " - ") -> DataFrame:
    """Rows as text lines; null fields are written empty."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat_ws(separator, *fields).alias("value"))


def write_delimited(df: DataFrame, path: str, columns: Sequence[str], separator: str = " - ") -> None:
    delimited(df, columns, separator).write.mode("overwrite").text(path)


def fold_repeated_rows(df: DataFrame, key: Sequence[str], tail: Sequence[str], separator: str = " - ") -> DataFrame:
    """Rows of one key as one line: the key once, then the tail columns of each row in order."""
    parts = F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tail])
    lines = df.groupBy(*key).agg(F.sort_array(F.collect_list(parts)).alias("_parts"))
    head: list[Column] = [F.col(c).cast("string") for c in key]
    return lines.select(*key, F.concat_ws(separator, *head, F.array_join("_parts", separator)).alias("line"))


def task_grid(outcomes: DataFrame, outcome_id: str, feature_sets: Sequence[str], batch: int = 5) -> DataFrame:
    """Every outcome with every feature set, numbered in order, in batches of a fixed size."""
    counts = outcomes.select(outcome_id).distinct().withColumn("_n", F.lit(1))
    numbered = running_sums(counts, order=outcome_id, sums=["_n"])
    sets = F.posexplode(F.array(*[F.lit(s) for s in feature_sets])).alias("_pos", "feature_set")
    grid = numbered.select(outcome_id, "_n_below", sets)
    index = F.col("_n_below") * len(feature_sets) + F.col("_pos")
    return grid.select(outcome_id, "feature_set", index.alias("task_index"), F.floor(index / batch).alias("batch"))


