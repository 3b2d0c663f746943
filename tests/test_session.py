"""Tables that several queries of a session share."""

from tidemark.session import release_stages, shared_stage


def test_a_shared_table_is_built_once_until_it_is_released(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert [shared_stage(spark, ("folder", "x"), build).count() for _ in range(3)] == [3, 3, 3] and len(built) == 1
    assert shared_stage(spark, ("other", "x"), build).count() == 3 and len(built) == 2
    release_stages(spark)
    assert shared_stage(spark, ("folder", "x"), build).count() == 3 and len(built) == 3
