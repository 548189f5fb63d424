"""Every registered plan with SQL against DuckDB on the smallest tables, and plan checks."""

import pytest

from gridloom.plans import all_plans, registry  # noqa: F401

from .compare import assert_same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_plan_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, FOLDER), registry.ORACLES[name], FOLDER)


def test_no_python_in_pixel_plans(spark):
    for name in registry.QUERIES:
        if name[0] in "paw" and name[1:3].isdigit():
            plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Pandas" not in plan, name


def test_m14_votes_in_every_tile(spark, monkeypatch):
    from gridloom.plans import grid

    made, dihedral = [], grid.op.dihedral
    monkeypatch.setattr(grid.op, "dihedral", lambda df, size: made.append(dihedral(df, size)) or made[-1])
    pixels = spark.range(25000).selectExpr("cast(id % 100 as int) x", "cast(id div 100 as int) y", "cast(id % 5 as int) gt_class")
    got = {tuple(r) for r in grid.m14_augmentation_vote(pixels).select("x", "y", "v").collect()}
    assert got == {tuple(r) for r in pixels.collect()}
    assert made[0].filter("vx between 0 and 99 and vy between 0 and 99").count() == 8 * 25000


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
