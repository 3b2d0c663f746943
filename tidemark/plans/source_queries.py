"""Queries on sources and sinks. Each writes data derived from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as me
from tidemark.plans.metric_queries import SQL_MODELS, SQL_SCORES, scores, sql_auc
from tidemark.plans.outcome_queries import SQL_COUNTS, SQL_SAMPLED, procedure_counts, samples
from tidemark.plans.common import SQL_ELIGIBLE
from tidemark.plans.registry import query, sql
from tidemark.plans.summary_queries import KEYS, SQL_MAIN, YEARS, results
from tidemark.session import materialize, scratch_path
from tidemark.sources import files
from tidemark.sources.tables import read_tables, write_table


@query(
    "s01_read_tables",
    sql(select="""SELECT n_name, r_name, count(*) AS num_customers FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""),
)
def _(r):
    t = read_tables(r.spark, r.folder, ["customer", "nation", "region"])
    joined = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("num_customers"))


@query(
    "s02_read_reference_csv",
    sql(select="""SELECT CAST(concept_id AS INT) AS concept_id, unit, round(min(range_low), 6) AS male_range_low, round(max(range_high), 6) AS male_range_high,
        CAST(NULL AS DOUBLE) AS female_range_low, round(max(range_high) - 1, 6) AS female_range_high FROM measurement
        WHERE unit IS NOT NULL GROUP BY 1, 2"""),
)
def _(r):
    derived = r["measurement"].where("unit IS NOT NULL").groupBy("concept_id", "unit").agg(
        F.min("range_low").alias("male_range_low"),
        F.max("range_high").alias("male_range_high"),
        F.lit(None).cast("double").alias("female_range_low"),
        (F.max("range_high") - 1).alias("female_range_high"),
    )
    path = scratch_path(r.spark, "reference")
    files.write_reference_csv(derived, path)
    return files.read_reference_csv(r.spark, path, files.REFERENCE_SCHEMAS["unit_thresholds"])


@query(
    "s03_write_table",
    sql(select="SELECT concept_id, count(*) AS num_events FROM procedure_occurrence WHERE year(event_date) = 1998 GROUP BY 1"),
)
def _(r):
    path = scratch_path(r.spark, "procedures")
    write_table(r["procedure_occurrence"].withColumn("year", F.year("event_date")), path, ["year"])
    back = r.spark.read.parquet(path).where("year = 1998")
    return back.groupBy("concept_id").agg(F.count(F.lit(1)).alias("num_events"))


@query(
    "s04_read_timelines",
    sql(select="""SELECT DISTINCT person_id, CAST(event_date AS VARCHAR) AS event_date, concat(CAST(concept_id AS VARCHAR), ' - drug') AS concept
        FROM drug_exposure"""),
)
def _(r):
    events = r["drug_exposure"].withColumn("concept", F.concat(F.col("concept_id").cast("string"), F.lit(" - drug")))
    path = scratch_path(r.spark, "timelines")
    files.write_timelines(events, path)
    return files.read_timelines(r.spark, path)


@query(
    "s05_write_timelines",
    sql(
        """v AS (SELECT person_id, event_date, string_agg(c, ',' ORDER BY c) AS visit FROM
        (SELECT DISTINCT person_id, event_date, CAST(concept_id AS VARCHAR) AS c FROM drug_exposure) GROUP BY 1, 2)""",
        select="""SELECT person_id, string_agg(CAST(event_date AS VARCHAR), ';' ORDER BY event_date) AS dates,
        string_agg(visit, ';' ORDER BY event_date) AS visits FROM v GROUP BY 1""",
    ),
)
def _(r):
    events = r["drug_exposure"].withColumn("concept", F.col("concept_id").cast("string"))
    path = scratch_path(r.spark, "timelines")
    files.write_timelines(events, path)
    people = r.spark.read.schema(files.TIMELINE_SCHEMA).json(path)
    visits = F.array_join(F.transform("visits", lambda v: F.array_join(v, ",")), ";")
    return people.select("person_id", F.array_join("dates", ";").alias("dates"), visits.alias("visits"))


@query(
    "s06_write_samples",
    sql(*SQL_SAMPLED, select="SELECT person_id, CAST(end_date AS VARCHAR) AS end_date, y FROM samples WHERE year = 1999 AND split = 'valid'"),
)
def _(r):
    path = scratch_path(r.spark, "samples")
    files.write_samples(samples(r), path)
    return files.read_samples(r.spark, path, 1999, "valid").select("person_id", "end_date", "y")


SQL_METRIC_ROWS = (
    SQL_SCORES,
    SQL_MODELS,
    *sql_auc("a", "ms", "split, model_year, eval_year", "score"),
    "b AS (SELECT split, model_year, eval_year, avg((score - y) ** 2) AS brier FROM ms GROUP BY ALL)",
    """metric_rows AS (SELECT split, model_year, eval_year, 'auc' AS metric, round(auc, 6) AS value FROM a
        UNION ALL SELECT split, model_year, eval_year, 'brier', round(brier, 6) FROM b)""",
)


def metric_rows(r):
    rows = me.model_scores(scores(r))
    values = me.eval_predictions(rows, "score", 0.5, ["split", "model_year", "eval_year"])
    long = values.unpivot(["split", "model_year", "eval_year"], ["auc", "brier"], "metric", "value")
    return long.withColumn("value", F.round("value", 6))


@query("s07_read_metrics_json", sql(*SQL_METRIC_ROWS, select="SELECT * FROM metric_rows"))
def _(r):
    path = scratch_path(r.spark, "metrics")
    files.write_metrics_json(metric_rows(r), path, ["split"])
    back = files.read_metrics_json(r.spark, f"{path}/*/*.txt")
    return back.withColumn("split", F.regexp_extract("source", "split=([a-z]+)", 1)).drop("source")


@query(
    "s08_write_metrics_json",
    sql(
        *SQL_METRIC_ROWS,
        select="""SELECT split, model_year, eval_year, count(*) AS num_metrics, round(sum(value), 6) AS value_sum FROM metric_rows GROUP BY 1, 2, 3""",
    ),
)
def _(r):
    path = scratch_path(r.spark, "metrics")
    files.write_metrics_json(metric_rows(r), path, ["split"])
    parsed = files.parse_metrics(r.spark.read.option("wholetext", True).text(path), "value", ["split"])
    return parsed.groupBy("split", "model_year", "eval_year").agg(
        F.count(F.lit(1)).alias("num_metrics"), F.sum("value").alias("value_sum")
    )


_WIDE = ", ".join(f'round("{y}", 6) AS "{y}"' for y in YEARS)


@query(
    "s09_collect_results",
    sql(*SQL_MAIN, select=f"SELECT experiment AS task_folder, experiment, outcome_name, region_name, {_WIDE} FROM res WHERE experiment <> 'lab_furniture'"),
)
def _(r):
    table = materialize(results(r))
    path = scratch_path(r.spark, "results")
    table.withColumn("task", F.col("experiment")).write.partitionBy("task").option("header", True).csv(path)
    schema = ", ".join([f"{k} string" for k in KEYS] + [f"`{y}` double" for y in YEARS])
    excluded = r.spark.range(1).select(F.lit("lab_furniture").alias("task"))
    expected = table.select(F.col("experiment").alias("task")).distinct()
    collected = files.collect_results(r.spark, f"{path}/*/*.csv", schema, excluded, expected, incomplete=False)
    return collected.select("task_folder", *KEYS, *[f"{y}" for y in YEARS])


@query(
    "s10_write_delimited",
    sql(*SQL_ELIGIBLE, SQL_COUNTS, select="SELECT concat(CAST(concept_id AS VARCHAR), ' - ', concept_name, ' - ', CAST(concept_count AS VARCHAR)) AS value FROM counts"),
)
def _(r):
    path = scratch_path(r.spark, "lines")
    files.write_delimited(procedure_counts(r), path, ["concept_id", "concept_name", "concept_count"])
    return r.spark.read.text(path)


@query(
    "s11_fold_repeated_rows",
    sql(
        """units AS (SELECT m.concept_id, c.concept_name, m.unit, CAST(count(*) AS VARCHAR) AS n FROM measurement m JOIN concept c ON c.concept_id = m.concept_id
        WHERE m.unit IS NOT NULL GROUP BY 1, 2, 3)""",
        select="""SELECT concept_id, concept_name, concat(CAST(concept_id AS VARCHAR), ' - ', concept_name, ' - ',
        string_agg(concat(unit, ' - ', n), ' - ' ORDER BY concat(unit, ' - ', n))) AS line FROM units GROUP BY 1, 2""",
    ),
)
def _(r):
    units = r["measurement"].where("unit IS NOT NULL").groupBy("concept_id", "unit").agg(F.count(F.lit(1)).alias("n"))
    return files.fold_repeated_rows(units.join(r["concept"], "concept_id"), ["concept_id", "concept_name"], ["unit", "n"])


@query(
    "s12_task_grid",
    sql(
        """o AS (SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS i FROM (SELECT DISTINCT concept_id FROM procedure_occurrence))""",
        "f AS (SELECT unnest(['cond_proc', 'labs', 'drugs', 'all']) AS feature_set, unnest([0, 1, 2, 3]) AS j)",
        select="""SELECT concept_id, feature_set, i * 4 + j AS task_index, CAST(floor((i * 4 + j) / 5) AS BIGINT) AS batch FROM o, f""",
    ),
)
def _(r):
    return files.task_grid(r["procedure_occurrence"], "concept_id", ["cond_proc", "labs", "drugs", "all"])


@query(
    "s12_task_grid_names",
    sql(
        "o AS (SELECT concept_name, row_number() OVER (ORDER BY concept_name) - 1 AS i FROM (SELECT DISTINCT concept_name FROM concept))",
        "f AS (SELECT unnest(['cond_proc', 'all']) AS feature_set, unnest([0, 1]) AS j)",
        select="""SELECT concept_name, feature_set, i * 2 + j AS task_index, CAST(floor((i * 2 + j) / 5) AS BIGINT) AS batch FROM o, f""",
    ),
)
def _(r):
    return files.task_grid(r["concept"], "concept_name", ["cond_proc", "all"])
