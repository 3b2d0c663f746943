"""Bind the given star-schema tables to the relations that the operators read.

Each relation is one plain SQL text, used unchanged for Spark and for the SQL
checks. Braces mark the relations a text reads from.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import materialize
from tidemark.sources.tables import read_tables

FIRST_DATE = dt.date(1996, 1, 1)
LAST_DATE = dt.date(2000, 12, 1)
YEARS = tuple(range(FIRST_DATE.year, LAST_DATE.year + 1))

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

RELATIONS = {
    "person": """
        SELECT c_custkey AS person_id, CAST(1920 + c_custkey % 80 AS INT) AS year_of_birth,
               CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender_source_value,
               CAST(c_nationkey % 5 AS INT) AS race_concept_id,
               CASE WHEN c_custkey % 11 = 0 THEN CAST(m.last_order AS DATE) END AS death_date
        FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM {orders} GROUP BY o_custkey) m
        ON c_custkey = m.o_custkey""",
    "observation_period": """
        SELECT o_custkey AS person_id, CAST(min(o_orderdate) AS DATE) AS period_start,
               CAST(max(o_orderdate) AS DATE) AS period_end
        FROM {orders}
        GROUP BY o_custkey, CASE WHEN o_custkey % 5 = 0 AND o_orderdate >= TIMESTAMP '1998-06-01 00:00:00' THEN 1 ELSE 0 END""",
    "condition_occurrence": """
        SELECT o_custkey AS person_id, l_partkey % 25 AS concept_id, CAST(l_shipdate AS DATE) AS event_date
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "procedure_occurrence": """
        SELECT o_custkey AS person_id, 100 + l_suppkey % 20 AS concept_id, CAST(o_orderdate AS DATE) AS event_date
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "drug_exposure": """
        SELECT o_custkey AS person_id, 200 + l_partkey % 15 AS concept_id, CAST(l_shipdate AS DATE) AS event_date
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "measurement": """
        SELECT o_custkey AS person_id, 300 + l_partkey % 12 AS concept_id, CAST(l_shipdate AS DATE) AS event_date,
               CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity <= 2 THEN 0.0E0
                    WHEN l_partkey % 12 >= 10 THEN l_quantity - 20 ELSE l_quantity END AS value,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN 'mg/dl' ELSE '%' END AS unit,
               CASE WHEN l_linenumber <= 2 AND l_partkey % 12 NOT IN (3, 4) THEN round(l_discount * 100) END AS range_low,
               CASE WHEN l_linenumber <= 2 AND l_partkey % 12 NOT IN (3, 4) THEN 30 + round(l_tax * 100) END AS range_high
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "visit_occurrence": """
        SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS visit_start_date, o_orderkey % 10 AS provider_id
        FROM {orders}""",
    "provider": """
        SELECT s_suppkey AS provider_id, 400 + s_nationkey AS specialty_concept_id FROM {supplier}""",
    "payer_plan_period": """
        SELECT person_id, period_start, period_end, CAST(500 + person_id % 3 AS INT) AS payer_concept_id
        FROM {observation_period}""",
    "concept": """
        SELECT DISTINCT concept_id, concat('Condition ', CAST(concept_id AS STRING)) AS concept_name FROM {condition_occurrence}
        UNION ALL SELECT DISTINCT concept_id, concat('Procedure ', CAST(concept_id AS STRING)) FROM {procedure_occurrence}
        UNION ALL SELECT DISTINCT concept_id, concat('Drug ', CAST(concept_id AS STRING)) FROM {drug_exposure}
        UNION ALL SELECT DISTINCT concept_id, concat('Serum level ', CAST(concept_id % 3 AS STRING), ' assay ', CAST(concept_id AS STRING)) FROM {measurement}
        UNION ALL SELECT DISTINCT 400 + CAST(n_nationkey AS BIGINT), n_name FROM {nation}""",
    "scores": """
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
                         CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING)) AS sample_id,
               o_custkey AS person_id, CAST(year(l_shipdate) AS INT) AS year,
               CASE WHEN o_custkey % 5 = 0 THEN 'test' WHEN o_custkey % 5 = 1 THEN 'valid' ELSE 'train' END AS split,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
               (l_quantity + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END) / 65.0E0 AS s_prev,
               (l_quantity + CASE WHEN l_returnflag = 'R' THEN 5 + (year(l_shipdate) % 3) * 5 ELSE 0 END) / 65.0E0 AS s_curr
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # Small reference tables in the shape of the threshold files.
    "source_thresholds": """
        SELECT * FROM (VALUES (300, 5.0E0, 40.0E0, 6.0E0, 38.0E0),
                              (303, CAST(NULL AS DOUBLE), 35.0E0, CAST(NULL AS DOUBLE), 35.0E0))
        AS v(concept_id, male_range_low, male_range_high, female_range_low, female_range_high)""",
    "unit_thresholds": """
        SELECT * FROM (VALUES (301, 'mg/dl', 4.0E0, 30.0E0, 5.0E0, 28.0E0),
                              (304, '%', 2.0E0, CAST(NULL AS DOUBLE), 2.0E0, CAST(NULL AS DOUBLE)))
        AS v(concept_id, unit, male_range_low, male_range_high, female_range_low, female_range_high)""",
    "units_to_drop": """
        SELECT * FROM (VALUES (302, '%'), (309, 'mg/dl')) AS v(concept_id, unit)""",
    "out_of_range": """
        SELECT * FROM (VALUES (305, 'mg/dl', 2.0E0, 45.0E0), (306, '%', CAST(NULL AS DOUBLE), 40.0E0),
                              (310, '%', -10.0E0, CAST(NULL AS DOUBLE)))
        AS v(concept_id, unit, lower_bound, upper_bound)""",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def relation_ctes() -> list[str]:
    """The relations as named CTEs, in an order in which each only reads earlier ones."""
    return [f"{name} AS ({_REFERENCE.sub(lambda m: m.group(1), text)})" for name, text in RELATIONS.items()]


class Bound:
    """The relations over one folder of tables: ``Bound(spark, folder)["person"]``."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}
        self._stages: dict[str, DataFrame] = {}

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several later steps read: built and written once."""
        if name not in self._stages:
            self._stages[name] = materialize(build())
        return self._stages[name]

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A plan that several steps use, built once but not written."""
        if name not in self._stages:
            self._stages[name] = build()
        return self._stages[name]

    def stored(self, name: str) -> DataFrame:
        """A relation as a stored table, for pipelines that scan it many times."""
        return self.stage(f"stored_{name}", lambda: self[name])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in RELATIONS:
                text = RELATIONS[name]
                reads = {used: self[used] for used in _REFERENCE.findall(text)}
                frame = self.spark.sql(text, **reads)
                # the concept dimension is read many times and is small: written once
                self._frames[name] = materialize(frame) if name == "concept" else frame
            else:
                self._frames[name] = read_tables(self.spark, self.folder, [name])[name]
        return self._frames[name]
