"""Panel rows of a few months equal those of the whole panel, without its windows."""

import datetime

from panelwright.plans import derived as D


def test_rows_of_chosen_months(spark, tmp_path):
    day = lambda y, m: datetime.datetime(y, m, 9)
    lines = [(p, day(y, m), 100.25 * ((p or 0) + m), flag) for p in (1, 2, 3, None) for y in (1997, 1998, 1999) for m in (6, 7) for flag in ("R", "N", None)]
    lines += [(1, None, 7.5, "R"), (2, day(1998, 7), None, "R"), (4, day(1998, 8), 3.0, "R"), (5, day(1998, 6), None, None)]
    schema = "l_partkey long, l_shipdate timestamp, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = [(p, f"name {p}", "Brand#1", "LARGE") for p in (1, 2, 2, 3, 4, 5, None)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    chosen = D.part_panel(spark, str(tmp_path), D.SNAPSHOTS)
    whole = D.part_panel(spark, str(tmp_path))
    whole = whole.filter(whole.reporting_period.isin(*D.SNAPSHOTS))
    rows = lambda df: sorted(map(str, df.collect()))
    assert chosen.schema == whole.schema and rows(chosen) == rows(whole) and chosen.count() > 9
    plan = D.canonical(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "l_partkey" not in plan


def test_numbers_are_shuffled_instead_of_codes(spark, sf_dir):
    plan = D.monthly_panel(spark, sf_dir, dense=False, months=D.SNAPSHOTS)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(dealt) == 2 and not any("project_code" in line for line in dealt)
