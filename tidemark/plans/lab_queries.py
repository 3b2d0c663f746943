"""Queries on measurement cleaning and reference ranges."""

from __future__ import annotations

from tidemark.operators import labs
from tidemark.plans import lab_sql as ls
from tidemark.plans.registry import query, sql

_MEAS = "person_id, concept_id, CAST(event_date AS VARCHAR) AS event_date, value, unit, range_low, range_high"
_LOW = ls.GENERAL_LOW
_CELL_LOW = (*ls.CELLS, *ls.general("low"), *ls.cells("low"))


def clean(r):
    return labs.standardized_measurements(r.stored("measurement"), r["concept"], r["units_to_drop"], r["out_of_range"])


def references(r, direction):
    return r.shared(
        f"references_{direction}",
        lambda: labs.standardized_references(
            r.stored("measurement"),
            r.stored("person"),
            r["concept"],
            r["unit_thresholds"],
            r["source_thresholds"],
            direction,
        ),
    )


def own_low(r):
    concepts = labs.measured_concepts(r["concept"], r["measurement"])
    own = labs.most_frequent_reference(labs.reference_counts(r["measurement"], "low"), "low")
    return concepts, own.join(concepts, "concept_id")


@query("l01_measured_concepts", sql(ls.SQL_MEASURED, select="SELECT * FROM measured"))
def _(r):
    return labs.measured_concepts(r["concept"], r["measurement"])


@query("l02_reference_counts", sql(*_LOW, select="SELECT * FROM counts_low"))
def _(r):
    return labs.reference_counts(r["measurement"], "low")


@query("l03_most_frequent_reference", sql(*_LOW, select="SELECT * FROM mode_low"))
def _(r):
    return labs.most_frequent_reference(labs.reference_counts(r["measurement"], "low"), "low")


@query(
    "l03_most_frequent_reference_high",
    sql(ls.SQL_MEASURED, *ls.general("high"), select="SELECT * FROM mode_high"),
)
def _(r):
    return labs.most_frequent_reference(labs.reference_counts(r["measurement"], "high"), "high")


@query("l04_without_reference", sql(*_LOW, select="SELECT * FROM need_low"))
def _(r):
    concepts, own = own_low(r)
    return labs.without_reference(concepts, own)


@query(
    "l05_similar_by_prefix",
    sql(
        *_LOW,
        select="""SELECT concept_id, concept_name, lower(left(concept_name, 15)) AS prefix,
        count(DISTINCT similar_concept_id) AS candidates, min(similar_concept_id) AS first_candidate
        FROM pairs_low GROUP BY ALL""",
    ),
)
def _(r):
    concepts, own = own_low(r)
    need = labs.without_reference(concepts, own)
    return labs.similar_by_prefix(need, own).select("concept_id", "concept_name", "prefix", "candidates", "first_candidate")


@query(
    "l06_similar_by_mean",
    sql(*_LOW, select="SELECT concept_id, concept_name, count(*) AS candidates FROM near_low GROUP BY ALL"),
)
def _(r):
    concepts, own = own_low(r)
    need = labs.without_reference(concepts, own)
    return labs.similar_by_mean(need, own, labs.value_averages(r["measurement"]))


@query("l07_borrow_reference", sql(*_LOW, select="SELECT * FROM borrowed_low"))
def _(r):
    concepts, own = own_low(r)
    need = labs.without_reference(concepts, own)
    return labs.borrow_reference(need, own, labs.value_averages(r["measurement"]), "low")


@query("l08_general_references", sql(*_LOW, select="SELECT * FROM general_low"))
def _(r):
    return labs.general_references(r["measurement"], r["concept"], "low")


@query("l09_zero_is_missing", sql(*_LOW, ls.SQL_ZERO, select="SELECT * FROM zero_concepts"))
def _(r):
    return labs.zero_is_missing(r["measurement"], labs.general_references(r["measurement"], r["concept"], "low"))


def zeroed(r):
    low = labs.general_references(r["measurement"], r["concept"], "low")
    return labs.null_out_zeros(r["measurement"], labs.zero_is_missing(r["measurement"], low))


@query("l10_null_out_zeros", sql(*_LOW, ls.SQL_ZERO, ls.SQL_ZEROED, select=f"SELECT {_MEAS} FROM zeroed"))
def _(r):
    return zeroed(r)


@query("l11_age_band", sql(ls.SQL_BANDED, select=f"SELECT {_MEAS}, gender_source_value, age_range FROM banded"))
def _(r):
    return labs.banded_measurements(r["measurement"], r["person"])


@query("l12_required_cells", sql(*ls.CELLS, select="SELECT * FROM cells"))
def _(r):
    return labs.required_cells(labs.banded_measurements(r["measurement"], r["person"]), r["concept"])


def cell_stages(r, direction="low"):
    banded = labs.banded_measurements(r.stored("measurement"), r.stored("person"))
    cells = labs.required_cells(banded, r["concept"])
    own = labs.cell_references(banded, direction)
    averages = labs.value_averages(banded, labs.CELL, exclude_zero=False)
    similar = labs.cell_similar_references(cells, own, averages, direction)
    return cells, own, similar


@query("l13_cell_references", sql(*_CELL_LOW, select="SELECT * FROM cell_mode_low"))
def _(r):
    return cell_stages(r)[1]


@query("l14_cell_similar_references", sql(*_CELL_LOW, select="SELECT * FROM cell_similar_low"))
def _(r):
    return cell_stages(r)[2]


@query("l15_fill_from_other_gender", sql(*_CELL_LOW, select="SELECT * FROM opposite_low"))
def _(r):
    cells, own, similar = cell_stages(r)
    return labs.fill_from_other_gender(cells, labs.references_so_far(cells, own, similar, "low"), "low")


@query("l16_fill_from_adjacent_band", sql(*_CELL_LOW, select="SELECT * FROM bands_low"))
def _(r):
    cells, own, similar = cell_stages(r)
    found = labs.fill_from_other_gender(cells, labs.references_so_far(cells, own, similar, "low"), "low")
    return labs.fill_from_adjacent_band(cells, found, "low")


@query(
    "l17_fill_from_general",
    sql(*_CELL_LOW, select="SELECT * FROM cell_refs_low WHERE from_general_reference = 1"),
)
def _(r):
    cells, own, similar = cell_stages(r)
    found = labs.fill_from_other_gender(cells, labs.references_so_far(cells, own, similar, "low"), "low")
    general = labs.general_references(r["measurement"], r["concept"], "low")
    filled = labs.fill_from_general(labs.fill_from_adjacent_band(cells, found, "low"), general, "low")
    return filled.where("from_general_reference = 1")


@query("l18_cell_reference_table", sql(*_CELL_LOW, select="SELECT * FROM cell_refs_low"))
def _(r):
    measurement = r.stored("measurement")
    general = labs.general_references(measurement, r["concept"], "low")
    return labs.cell_reference_table(measurement, r.stored("person"), r["concept"], general, "low")


@query("l19_standardize_references", sql(*_CELL_LOW, select="SELECT * FROM refs_low"))
def _(r):
    return references(r, "low")


@query("l19_standardize_references_high", sql(*ls.REFS, select="SELECT * FROM refs_high"))
def _(r):
    return references(r, "high")


@query(
    "l20_drop_bad_units",
    sql(*_LOW, ls.SQL_ZERO, ls.SQL_ZEROED, ls.SQL_UNITS_OK, select=f"SELECT {_MEAS} FROM units_ok"),
)
def _(r):
    return labs.drop_bad_units(zeroed(r), r["units_to_drop"])


@query("l21_drop_out_of_range", sql(*ls.CLEAN, select=f"SELECT {_MEAS} FROM clean"))
def _(r):
    return clean(r)
