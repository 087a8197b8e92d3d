"""Every registered query against its oracle SQL on the smallest tables."""

import pytest
from shared import SF, same_rows

from wayforge.plans.oracle import SQL
from wayforge.plans.queries import QUERIES

MAY_BE_EMPTY = {"speed_reachability"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    n = same_rows(QUERIES[name](spark, SF), duck, SQL[name])
    assert n or name in MAY_BE_EMPTY


def test_double_lines_is_the_sequential_greedy_pass(spark):
    from pyspark.sql import functions as F

    from wayforge.functions import pixels
    from wayforge.sources import fixtures as fx

    rows = pixels.parallel_pairs(fx.pixel_lines(spark, SF)).where("shorter >= 20 and length_ratio > 0.6").select("image", "i", "j", F.round("score", 6).alias("score")).collect()
    used, want = set(), set()
    for r in sorted(rows, key=lambda r: (-r["score"], r["j"], r["i"])):
        if (r["image"], r["i"]) not in used and (r["image"], r["j"]) not in used:
            used |= {(r["image"], r["i"]), (r["image"], r["j"])}
            want.add((r["image"], r["i"], r["j"]))
    assert {(r["image"], r["i"], r["j"]) for r in QUERIES["double_lines"](spark, SF).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["way_id", "node_id", "seq", "direction", "alt_dir"]
    assert set(e.oracle_sql()) <= set(e.queries())


#: (event_id, user_id) of lines that overlap by 0.6 exactly, or whose overlap is a half in its fourth digit.
HALVES = [(15316, 606), (78943, 606), (19981, 946), (76932, 946), (148876, 2108), (186503, 2108)]


def _at_halves(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(HALVES, "event_id long, user_id long").selectExpr("*", "'click' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    con.execute("create view part as select 1 as p_partkey, 1 as p_size")
    return same_rows(QUERIES[name](spark, str(tmp_path)), con, SQL[name])


def test_parallel_pairs_at_thresholds_and_halves(spark, tmp_path):
    assert _at_halves(spark, tmp_path, "parallel_pairs") == 1


def test_image_summary_at_thresholds(spark, tmp_path):
    assert _at_halves(spark, tmp_path, "image_summary") == 3


def test_double_lines_at_thresholds(spark, tmp_path):
    assert _at_halves(spark, tmp_path, "double_lines") == 1
