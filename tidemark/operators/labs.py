"""Measurement cleaning and reference ranges with their ordered fallbacks.

``direction`` is 'low' or 'high' and names the range column. Concept-level and
cell-level tables (a cell is concept x unit x age band x gender) are small next
to the measurements; every pass over measurements is one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import age_band
from tidemark.functions.ranking import join_on
from tidemark.session import materialize

CELL = ("concept_id", "unit", "age_range", "gender_source_value")

# Least count of a usable range, prefix length, and thresholds on averages.
MIN_REFERENCE_COUNT = 5
PREFIX_CHARS = 15
MEAN_THRESHOLD = 5.0
CELL_MEAN_THRESHOLD = 10.0
ZERO_THRESHOLD = 5.0


def _tie(direction: str) -> Column:
    """Larger wins among equal counts: the lowest low bound, the highest high bound."""
    bound = F.col(f"range_{direction}")
    return -bound if direction == "low" else bound


def measured_concepts(concept: DataFrame, measurement: DataFrame) -> DataFrame:
    """Concepts that some measurement has; only distinct ids of the measurements are shuffled."""
    measured = measurement.select("concept_id").distinct()
    return concept.select("concept_id", "concept_name").distinct().join(measured, "concept_id", "left_semi")


def reference_counts(measurement: DataFrame, direction: str, keys: Sequence[str] = ("concept_id",)) -> DataFrame:
    bound = f"range_{direction}"
    given = measurement.where(F.col(bound).isNotNull())
    return given.groupBy(*keys, bound).agg(F.count(F.lit(1)).alias("reference_count"))


def most_frequent_reference(
    counts: DataFrame,
    direction: str,
    keys: Sequence[str] = ("concept_id",),
    min_count: int = MIN_REFERENCE_COUNT,
) -> DataFrame:
    """The most frequent range per key: one maximum over (count, bound)."""
    bound = f"range_{direction}"
    best = F.max(F.struct("reference_count", _tie(direction).alias("tie"), F.col(bound).alias("bound"))).alias("best")
    picked = counts.where(F.col("reference_count") >= min_count).groupBy(*keys).agg(best)
    return picked.select(*keys, F.col("best.bound").alias(bound), F.col("best.reference_count").alias("reference_count"))


def without_reference(concepts: DataFrame, references: DataFrame, keys: Sequence[str] = ("concept_id",)) -> DataFrame:
    """Rows with no reference; a null unit never matches, so its rows stay."""
    return concepts.join(references.select(*keys).distinct(), list(keys), "left_anti")


def name_prefix(chars: int = PREFIX_CHARS) -> Column:
    return F.lower(F.substring("concept_name", 1, chars))


def similar_by_prefix(
    need: DataFrame, donors: DataFrame, keys: Sequence[str] = (), chars: int = PREFIX_CHARS
) -> DataFrame:
    """For each concept in need, how many donors share its name prefix.

    Donors are counted per prefix first, so no pair of concepts is ever formed.
    """
    prefixed = donors.withColumn("prefix", name_prefix(chars))
    sizes = prefixed.groupBy(*keys, "prefix").agg(
        F.countDistinct("concept_id").alias("candidates"), F.min("concept_id").alias("first_candidate")
    )
    return need.withColumn("prefix", name_prefix(chars)).join(sizes, [*keys, "prefix"])


def value_averages(
    measurement: DataFrame, keys: Sequence[str] = ("concept_id",), exclude_zero: bool = True
) -> DataFrame:
    valued = measurement.where(F.col("value").isNotNull())
    if exclude_zero:
        valued = valued.where(F.col("value") != 0)
    return valued.groupBy(*keys).agg(F.avg("value").alias("avg_value"))


def _near_donors(
    need: DataFrame, donors: DataFrame, averages: DataFrame, keys: Sequence[str], chars: int, threshold: float
) -> tuple[DataFrame, Window]:
    """Needy and donor concepts in one frame, with the window of the donors close to each needy one.

    Averages are cut into steps as wide as the threshold. A donor is copied to
    its own and both neighbouring steps, so each window holds one step and no
    pairs are formed. Null keys never match and leave here.
    """
    other = [k for k in keys if k != "concept_id"]
    scaled = F.col("avg_value") / F.lit(float(threshold))
    step = F.floor(scaled)

    def placed(df: DataFrame, is_donor: bool) -> DataFrame:
        around = F.explode(F.array(step - 1, step, step + 1)) if is_donor else step
        return (
            df.join(averages, list(keys))
            .withColumn("prefix", name_prefix(chars))
            .withColumn("is_donor", F.lit(is_donor))
            .withColumn("scaled", scaled)
            .withColumn("step", around)
        )

    both = placed(need, False).unionByName(placed(donors, True), allowMissingColumns=True)
    window = Window.partitionBy(*other, "prefix", "step").orderBy("scaled").rangeBetween(-1, 1)
    return both, window


def similar_by_mean(
    need: DataFrame,
    donors: DataFrame,
    averages: DataFrame,
    keys: Sequence[str] = ("concept_id",),
    chars: int = PREFIX_CHARS,
    threshold: float = MEAN_THRESHOLD,
) -> DataFrame:
    """For each concept in need, the number of same-prefix donors with a close average."""
    both, window = _near_donors(need, donors, averages, keys, chars, threshold)
    near = F.count(F.when(F.col("is_donor"), F.lit(1))).over(window)
    return both.select(*keys, "concept_name", "is_donor", near.alias("candidates")).where(
        ~F.col("is_donor") & (F.col("candidates") > 0)
    ).drop("is_donor")


def borrow_reference(
    need: DataFrame,
    donors: DataFrame,
    averages: DataFrame,
    direction: str,
    keys: Sequence[str] = ("concept_id",),
    chars: int = PREFIX_CHARS,
    threshold: float = MEAN_THRESHOLD,
) -> DataFrame:
    """The range of the best similar concept: by count, then bound, then smaller concept id."""
    bound = f"range_{direction}"
    both, window = _near_donors(need, donors, averages, keys, chars, threshold)
    offer = F.struct(
        "reference_count",
        _tie(direction).alias("tie"),
        (-F.col("concept_id")).alias("small_id"),
        F.col("concept_id").alias("similar_concept_id"),
        F.col("concept_name").alias("similar_concept_name"),
        F.col(bound).alias("bound"),
    )
    best = F.max(F.when(F.col("is_donor"), offer)).over(window)
    found = both.select(*keys, "concept_name", "is_donor", best.alias("best")).where(
        ~F.col("is_donor") & F.col("best").isNotNull()
    )
    return found.select(
        *keys,
        "concept_name",
        F.col("best.similar_concept_id").alias("similar_concept_id"),
        F.col("best.similar_concept_name").alias("similar_concept_name"),
        F.col("best.bound").alias(bound),
    )


def reference_facts(measurement: DataFrame, direction: str, keys: Sequence[str], exclude_zero: bool) -> DataFrame:
    """One pass over the measurements: rows and value sums per key and given range, written once.

    Keys, range counts and averages are all read from this small table.
    """
    value = F.when(F.col("value") != 0, F.col("value")) if exclude_zero else F.col("value")
    facts = measurement.groupBy(*keys, f"range_{direction}").agg(
        F.count(F.lit(1)).alias("reference_count"), F.sum(value).alias("value_sum"), F.count(value).alias("value_count")
    )
    return materialize(facts)


def fact_counts(facts: DataFrame, direction: str, keys: Sequence[str]) -> DataFrame:
    bound = f"range_{direction}"
    return facts.where(F.col(bound).isNotNull()).select(*keys, bound, "reference_count")


def fact_averages(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = facts.groupBy(*keys).agg(F.sum("value_sum").alias("s"), F.sum("value_count").alias("n"))
    return sums.where("n > 0").select(*keys, (F.col("s") / F.col("n")).alias("avg_value"))


def general_references(
    measurement: DataFrame,
    concept: DataFrame,
    direction: str,
    min_count: int = MIN_REFERENCE_COUNT,
    chars: int = PREFIX_CHARS,
    threshold: float = MEAN_THRESHOLD,
) -> DataFrame:
    """Own ranges per concept, and borrowed ones for the concepts that have none."""
    key = ["concept_id"]
    facts = reference_facts(measurement, direction, key, exclude_zero=True)
    concepts = measured_concepts(concept, facts)
    own = most_frequent_reference(fact_counts(facts, direction, key), direction, min_count=min_count)
    own = own.join(concepts, "concept_id")
    need = without_reference(concepts, own)
    borrowed = borrow_reference(need, own, fact_averages(facts, key), direction, chars=chars, threshold=threshold)
    listed = own.select(
        "concept_id",
        "concept_name",
        F.lit(None).cast("bigint").alias("similar_concept_id"),
        F.lit(None).cast("string").alias("similar_concept_name"),
        f"range_{direction}",
    )
    return materialize(listed.unionByName(borrowed).distinct())


def zero_is_missing(measurement: DataFrame, low_references: DataFrame, threshold: float = ZERO_THRESHOLD) -> DataFrame:
    """Concepts whose zeros cannot be real: no negatives, and a high bound or a high average."""
    value = F.col("value")
    facts = measurement.groupBy("concept_id").agg(
        F.max(F.when(value < 0, 1).otherwise(0)).alias("negative"),
        F.avg(F.when(value > 0, value)).alias("avg_positive"),
    )
    bound = low_references.groupBy("concept_id").agg(F.max("range_low").alias("range_low"), F.lit(1).alias("has_bound"))
    high = F.when(F.col("has_bound").isNotNull(), F.col("range_low") >= threshold).otherwise(
        F.col("avg_positive") >= threshold
    )
    return facts.join(bound, "concept_id", "left").where((F.col("negative") == 0) & high).select("concept_id")


def null_out_zeros(measurement: DataFrame, zero_concepts: DataFrame) -> DataFrame:
    """Rewrite zero to null for the flagged concepts, in one pass over the measurements."""
    flags = zero_concepts.select("concept_id", F.lit(True).alias("_flag"))
    value = F.when(F.col("_flag").isNotNull() & (F.col("value") == 0), F.lit(None)).otherwise(F.col("value"))
    return measurement.join(flags, "concept_id", "left").withColumn("value", value).drop("_flag").select(measurement.columns)


def banded_measurements(measurement: DataFrame, person: DataFrame) -> DataFrame:
    people = person.where("year_of_birth IS NOT NULL").select("person_id", "year_of_birth", "gender_source_value")
    dated = measurement.where("event_date IS NOT NULL").join(people, "person_id")
    return dated.withColumn("age_range", age_band("event_date", "year_of_birth")).drop("year_of_birth")


def required_cells(banded: DataFrame, concept: DataFrame) -> DataFrame:
    cells = banded.select(*CELL).distinct()
    return cells.join(concept.select("concept_id", "concept_name").distinct(), "concept_id")


def cell_references(banded: DataFrame, direction: str, min_count: int = MIN_REFERENCE_COUNT) -> DataFrame:
    return most_frequent_reference(reference_counts(banded, direction, CELL), direction, CELL, min_count)


def cell_similar_references(
    cells: DataFrame,
    own: DataFrame,
    averages: DataFrame,
    direction: str,
    chars: int = PREFIX_CHARS,
    threshold: float = CELL_MEAN_THRESHOLD,
) -> DataFrame:
    """Borrow inside the same unit, band and gender; averages here keep zeros."""
    donors = own.join(cells, list(CELL))
    return borrow_reference(without_reference(cells, own, CELL), donors, averages, direction, CELL, chars, threshold)


def references_so_far(cells: DataFrame, own: DataFrame, similar: DataFrame, direction: str) -> DataFrame:
    bound = f"range_{direction}"
    named = own.join(cells, list(CELL)).select(
        *CELL, "concept_name", F.lit(-1).cast("bigint").alias("similar_concept_id"),
        F.lit("").alias("similar_concept_name"), bound,
    )
    return named.unionByName(similar).distinct()


def fill_from_other_gender(cells: DataFrame, found: DataFrame, direction: str) -> DataFrame:
    """Cells without a range take the one of another gender in the same concept, unit and band."""
    bound = f"range_{direction}"
    shared = ["concept_id", "unit", "age_range"]
    offers = found.select(*shared, "similar_concept_id", "similar_concept_name", bound).distinct()
    filled = without_reference(cells, found, CELL).join(offers, shared)
    names = [*CELL, "concept_name", "similar_concept_id", "similar_concept_name", bound]
    opposite = filled.select(*names, F.lit(1).alias("from_opposite_gender"))
    return opposite.unionByName(found.select(*names, F.lit(0).alias("from_opposite_gender"))).distinct()


def fill_from_adjacent_band(cells: DataFrame, found: DataFrame, direction: str) -> DataFrame:
    """Nearest lower band first, then nearest higher band; a cell group has at most four bands."""
    bound = f"range_{direction}"
    joined = join_on(cells, found.drop("concept_name"), list(CELL), "left")
    # a null unit is a group of its own here, but it never finds a range by equality
    offer = F.when(
        F.col(bound).isNotNull() & F.col("unit").isNotNull(),
        F.struct("similar_concept_id", "similar_concept_name", F.col(bound).alias("bound")),
    )
    bands = Window.partitionBy("concept_id", "unit", "concept_name", "gender_source_value").orderBy("age_range")
    lower = F.last(offer, ignorenulls=True).over(bands.rowsBetween(Window.unboundedPreceding, -1))
    higher = F.first(offer, ignorenulls=True).over(bands.rowsBetween(1, Window.unboundedFollowing))
    picked = joined.select(*CELL, "concept_name", "from_opposite_gender", offer.alias("own"), F.coalesce(offer, lower, higher).alias("pick"))
    return picked.select(
        *CELL,
        "concept_name",
        F.col("pick.similar_concept_id").alias("similar_concept_id"),
        F.col("pick.similar_concept_name").alias("similar_concept_name"),
        F.col("pick.bound").alias(bound),
        "from_opposite_gender",
        F.when(F.col("own").isNotNull(), 0).otherwise(1).alias("from_different_age_range"),
    )


def fill_from_general(banded_fill: DataFrame, general: DataFrame, direction: str) -> DataFrame:
    """Cells that are still empty take the concept-level range; own filled cells keep theirs."""
    bound = f"range_{direction}"
    unmarked = F.col("similar_concept_id") == -1
    kept = banded_fill.where(F.col(bound).isNotNull()).select(
        *CELL,
        "concept_name",
        F.when(unmarked, None).otherwise(F.col("similar_concept_id")).alias("similar_concept_id"),
        F.when(unmarked, None).otherwise(F.col("similar_concept_name")).alias("similar_concept_name"),
        bound,
        "from_opposite_gender",
        "from_different_age_range",
        F.lit(0).alias("from_general_reference"),
    )
    empty = banded_fill.where(F.col(bound).isNull()).select(*CELL, "concept_name")
    offers = general.select("concept_id", "similar_concept_id", "similar_concept_name", bound)
    filled = empty.join(offers, "concept_id").select(
        *CELL,
        "concept_name",
        "similar_concept_id",
        "similar_concept_name",
        bound,
        F.lit(0).alias("from_opposite_gender"),
        F.lit(0).alias("from_different_age_range"),
        F.lit(1).alias("from_general_reference"),
    )
    return kept.unionByName(filled).distinct()


def cell_reference_table(
    measurement: DataFrame,
    person: DataFrame,
    concept: DataFrame,
    general: DataFrame,
    direction: str,
    min_count: int = MIN_REFERENCE_COUNT,
) -> DataFrame:
    """Reference range of every measured cell, with flags that tell where it came from."""
    facts = reference_facts(banded_measurements(measurement, person), direction, CELL, exclude_zero=False)
    cells = required_cells(facts, concept)
    own = most_frequent_reference(fact_counts(facts, direction, CELL), direction, CELL, min_count)
    similar = cell_similar_references(cells, own, fact_averages(facts, CELL), direction)
    found = materialize(references_so_far(cells, own, similar, direction))
    found = fill_from_other_gender(cells, found, direction)
    return materialize(fill_from_general(fill_from_adjacent_band(cells, found, direction), general, direction))


def standardize_references(
    references: DataFrame, unit_thresholds: DataFrame, thresholds: DataFrame, direction: str
) -> DataFrame:
    """Override by the unit-specific, then the concept-level source threshold of the gender."""
    bound = f"range_{direction}"
    male, female = f"male_{bound}", f"female_{bound}"

    def named(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        return df.select(*keys, F.col(male).alias(f"{prefix}_m"), F.col(female).alias(f"{prefix}_f"))

    joined = references.join(named(unit_thresholds, "us", ["concept_id", "unit"]), ["concept_id", "unit"], "left")
    joined = joined.join(named(thresholds, "s", ["concept_id"]), "concept_id", "left")
    gender = F.col("gender_source_value")
    value = F.when(gender == "M", F.coalesce("us_m", "s_m", bound)).when(
        gender == "F", F.coalesce("us_f", "s_f", bound)
    )
    return joined.where(gender.isin("M", "F")).withColumn(bound, value).select(references.columns).distinct()


def drop_bad_units(measurement: DataFrame, bad: DataFrame) -> DataFrame:
    return measurement.join(bad, ["concept_id", "unit"], "left_anti").select(measurement.columns)


def drop_out_of_range(measurement: DataFrame, bounds: DataFrame) -> DataFrame:
    b = bounds.select(
        F.col("concept_id").alias("_concept"), F.col("unit").alias("_unit"), "lower_bound", "upper_bound"
    )
    outside = (F.col("value") > F.col("upper_bound")) | (F.col("value") < F.col("lower_bound"))
    same = (F.col("concept_id") == F.col("_concept")) & (F.col("unit") == F.col("_unit"))
    return measurement.join(b, same & outside, "left_anti")


def standardized_measurements(
    measurement: DataFrame, concept: DataFrame, bad_units: DataFrame, bounds: DataFrame
) -> DataFrame:
    """Zeros nulled where they cannot be real, bad units and out-of-range values dropped."""
    low = general_references(measurement, concept, "low")
    cleaned = null_out_zeros(measurement, zero_is_missing(measurement, low))
    return drop_out_of_range(drop_bad_units(cleaned, bad_units), bounds)


def standardized_references(
    measurement: DataFrame,
    person: DataFrame,
    concept: DataFrame,
    unit_thresholds: DataFrame,
    thresholds: DataFrame,
    direction: str,
) -> DataFrame:
    general = general_references(measurement, concept, direction)
    table = cell_reference_table(measurement, person, concept, general, direction)
    return standardize_references(table, unit_thresholds, thresholds, direction)
