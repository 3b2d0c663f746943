"""SQL text of the measurement cleaning and reference-range stages."""

from __future__ import annotations

from tidemark.functions.expressions import AGE_BANDS

CELL = "concept_id, unit, age_range, gender_source_value"


def band(age: str) -> str:
    return (
        f"CASE WHEN {age} <= 30 THEN '{AGE_BANDS[0]}' WHEN {age} <= 50 THEN '{AGE_BANDS[1]}' "
        f"WHEN {age} <= 70 THEN '{AGE_BANDS[2]}' ELSE '{AGE_BANDS[3]}' END"
    )


SQL_MEASURED = """measured AS (
    SELECT DISTINCT c.concept_id, c.concept_name FROM concept c
    WHERE EXISTS (SELECT 1 FROM measurement m WHERE m.concept_id = c.concept_id))"""

SQL_BANDED = f"""banded AS (
    SELECT m.*, p.gender_source_value, {band('(year(m.event_date) - p.year_of_birth)')} AS age_range
    FROM measurement m JOIN person p ON m.person_id = p.person_id)"""

SQL_CELLS = f"""cells AS (
    SELECT b.*, c.concept_name FROM (SELECT DISTINCT {CELL} FROM banded) b JOIN measured c ON b.concept_id = c.concept_id)"""


def general(d: str) -> tuple[str, ...]:
    way = "ASC" if d == "low" else "DESC"
    r = f"range_{d}"
    return (
        f"counts_{d} AS (SELECT concept_id, {r}, count(*) AS reference_count FROM measurement WHERE {r} IS NOT NULL GROUP BY ALL)",
        f"""mode_{d} AS (SELECT concept_id, {r}, reference_count FROM (
            SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY reference_count DESC, {r} {way}) AS rn
            FROM counts_{d} WHERE reference_count >= 5) WHERE rn = 1)""",
        f"own_{d} AS (SELECT m.*, c.concept_name FROM mode_{d} m JOIN measured c ON m.concept_id = c.concept_id)",
        f"need_{d} AS (SELECT c.* FROM measured c WHERE NOT EXISTS (SELECT 1 FROM own_{d} r WHERE r.concept_id = c.concept_id))",
        f"""pairs_{d} AS (SELECT n.concept_id, n.concept_name, r.concept_id AS similar_concept_id,
            r.concept_name AS similar_concept_name, r.{r}, r.reference_count
            FROM need_{d} n JOIN own_{d} r ON lower(left(n.concept_name, 15)) = lower(left(r.concept_name, 15)))""",
        f"averages_{d} AS (SELECT concept_id, avg(value) AS avg_value FROM measurement WHERE value IS NOT NULL AND value <> 0 GROUP BY concept_id)",
        f"""near_{d} AS (SELECT p.* FROM pairs_{d} p JOIN averages_{d} a ON a.concept_id = p.concept_id
            JOIN averages_{d} b ON b.concept_id = p.similar_concept_id WHERE abs(a.avg_value - b.avg_value) <= 5)""",
        f"""borrowed_{d} AS (SELECT concept_id, concept_name, similar_concept_id, similar_concept_name, {r} FROM (
            SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY reference_count DESC, {r} {way}, similar_concept_id) AS rn
            FROM near_{d}) WHERE rn = 1)""",
        f"""general_{d} AS (SELECT concept_id, concept_name, NULL AS similar_concept_id, NULL AS similar_concept_name, {r} FROM own_{d}
            UNION SELECT * FROM borrowed_{d})""",
    )


def cells(d: str) -> tuple[str, ...]:
    way = "ASC" if d == "low" else "DESC"
    r = f"range_{d}"

    def same(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("concept_id", "unit", "age_range", "gender_source_value"))

    def shifted(column: str) -> str:
        over = "OVER (PARTITION BY m.concept_id, m.unit, m.concept_name, m.gender_source_value ORDER BY m.age_range)"
        steps = [f"lag({column}, {i}) {over}" for i in (1, 2, 3)] + [f"lead({column}, {i}) {over}" for i in (1, 2, 3)]
        return f"coalesce({column}, {', '.join(steps)})"

    return (
        f"""cell_mode_{d} AS (SELECT {CELL}, {r}, reference_count FROM (
            SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY reference_count DESC, {r} {way}) AS rn FROM (
                SELECT {CELL}, {r}, count(*) AS reference_count FROM banded WHERE {r} IS NOT NULL GROUP BY ALL)
            WHERE reference_count >= 5) WHERE rn = 1)""",
        f"cell_own_{d} AS (SELECT m.*, c.concept_name FROM cell_mode_{d} m JOIN measured c ON m.concept_id = c.concept_id)",
        f"cell_need_{d} AS (SELECT c.* FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cell_own_{d} r WHERE {same('c', 'r')}))",
        f"cell_avg_{d} AS (SELECT {CELL}, avg(value) AS avg_value FROM banded WHERE value IS NOT NULL GROUP BY ALL)",
        f"""cell_near_{d} AS (SELECT n.*, s.concept_id AS similar_concept_id, s.concept_name AS similar_concept_name, s.{r}, s.reference_count
            FROM cell_need_{d} n JOIN cell_own_{d} s ON lower(left(n.concept_name, 15)) = lower(left(s.concept_name, 15))
            AND n.unit = s.unit AND n.age_range = s.age_range AND n.gender_source_value = s.gender_source_value
            JOIN cell_avg_{d} a ON {same('a', 'n')} JOIN cell_avg_{d} b ON {same('b', 's')}
            WHERE abs(a.avg_value - b.avg_value) <= 10)""",
        f"""cell_similar_{d} AS (SELECT {CELL}, concept_name, similar_concept_id, similar_concept_name, {r} FROM (
            SELECT *, row_number() OVER (PARTITION BY {CELL} ORDER BY reference_count DESC, {r} {way}, similar_concept_id) AS rn
            FROM cell_near_{d}) WHERE rn = 1)""",
        f"""so_far_{d} AS (SELECT {CELL}, concept_name, -1 AS similar_concept_id, '' AS similar_concept_name, {r} FROM cell_own_{d}
            WHERE unit IS NOT NULL OR unit IS NULL
            UNION SELECT * FROM cell_similar_{d})""",
        f"""opposite_{d} AS (SELECT c.*, r.similar_concept_id, r.similar_concept_name, r.{r}, 1 AS from_opposite_gender
            FROM cell_need_{d} c JOIN so_far_{d} r ON c.concept_id = r.concept_id AND c.unit = r.unit AND c.age_range = r.age_range
            WHERE NOT EXISTS (SELECT 1 FROM cell_similar_{d} s WHERE {same('c', 's')})
            UNION SELECT {CELL}, concept_name, similar_concept_id, similar_concept_name, {r}, 0 FROM so_far_{d})""",
        f"""bands_{d} AS (SELECT m.concept_id, m.unit, m.age_range, m.gender_source_value, m.concept_name,
            {shifted('r.similar_concept_id')} AS similar_concept_id,
            {shifted('r.similar_concept_name')} AS similar_concept_name,
            {shifted('r.' + r)} AS {r}, r.from_opposite_gender,
            CASE WHEN r.{r} IS NOT NULL THEN 0 ELSE 1 END AS from_different_age_range
            FROM cells m LEFT JOIN opposite_{d} r ON {same('m', 'r')})""",
        f"""cell_refs_{d} AS (SELECT {CELL}, concept_name,
            CASE WHEN similar_concept_id = -1 THEN NULL ELSE similar_concept_id END AS similar_concept_id,
            CASE WHEN similar_concept_id = -1 THEN NULL ELSE similar_concept_name END AS similar_concept_name,
            {r}, from_opposite_gender, from_different_age_range, 0 AS from_general_reference
            FROM bands_{d} WHERE {r} IS NOT NULL
            UNION SELECT b.concept_id, b.unit, b.age_range, b.gender_source_value, b.concept_name,
            g.similar_concept_id, g.similar_concept_name, g.{r}, 0, 0, 1
            FROM bands_{d} b JOIN general_{d} g ON b.concept_id = g.concept_id WHERE b.{r} IS NULL)""",
        f"""refs_{d} AS (SELECT DISTINCT c.* REPLACE (
            CASE WHEN c.gender_source_value = 'M' THEN coalesce(us.male_{r}, s.male_{r}, c.{r})
                 ELSE coalesce(us.female_{r}, s.female_{r}, c.{r}) END AS {r})
            FROM cell_refs_{d} c LEFT JOIN unit_thresholds us ON c.concept_id = us.concept_id AND c.unit = us.unit
            LEFT JOIN source_thresholds s ON c.concept_id = s.concept_id WHERE c.gender_source_value IN ('M', 'F'))""",
    )


SQL_ZERO = """zero_concepts AS (
    SELECT DISTINCT concept_id FROM (
        SELECT concept_id FROM general_low WHERE range_low >= 5
        UNION SELECT concept_id FROM measurement m WHERE value > 0
        AND NOT EXISTS (SELECT 1 FROM general_low g WHERE g.concept_id = m.concept_id)
        GROUP BY concept_id HAVING avg(value) >= 5) h
    WHERE NOT EXISTS (SELECT 1 FROM measurement n WHERE n.concept_id = h.concept_id AND n.value < 0))"""

SQL_ZEROED = """zeroed AS (
    SELECT * FROM measurement m WHERE NOT EXISTS (SELECT 1 FROM zero_concepts z WHERE z.concept_id = m.concept_id)
    UNION ALL SELECT * FROM measurement m
    WHERE EXISTS (SELECT 1 FROM zero_concepts z WHERE z.concept_id = m.concept_id) AND (value > 0 OR value IS NULL)
    UNION ALL SELECT * REPLACE (CAST(NULL AS DOUBLE) AS value) FROM measurement m
    WHERE EXISTS (SELECT 1 FROM zero_concepts z WHERE z.concept_id = m.concept_id) AND value = 0)"""

SQL_UNITS_OK = """units_ok AS (
    SELECT * FROM zeroed m WHERE NOT EXISTS (SELECT 1 FROM units_to_drop d WHERE d.concept_id = m.concept_id AND d.unit = m.unit))"""

SQL_CLEAN = """clean AS (
    SELECT * FROM units_ok m WHERE NOT EXISTS (
        SELECT 1 FROM out_of_range r WHERE r.concept_id = m.concept_id AND r.unit = m.unit
        AND (m.value > r.upper_bound OR m.value < r.lower_bound)))"""

GENERAL_LOW = (SQL_MEASURED, *general("low"))
CLEAN = (*GENERAL_LOW, SQL_ZERO, SQL_ZEROED, SQL_UNITS_OK, SQL_CLEAN)
CELLS = (SQL_MEASURED, SQL_BANDED, SQL_CELLS)
REFS = (*CLEAN, *general("high"), SQL_BANDED, SQL_CELLS, *cells("low"), *cells("high"))
