"""Dense numbers and the plans behind them."""

import pytest
from pyspark.sql import functions as F

from deskloom.operators import numbering as N
from deskloom.session import shared_dir


def jo(spark, values):
    return spark.createDataFrame([(v,) for v in values], "job_order string")


@pytest.mark.parametrize(
    "existing, expected",
    [
        ([], "jo-0001"),
        (["jo-0012", "draft", None], "jo-0013"),
        (["jo-0999", "jo-1000"], "jo-1001"),
        (["jo-9999"], "jo-10000"),
    ],
)
def test_next_job_order(spark, existing, expected):
    assert N.next_job_order(jo(spark, existing)).first()[0] == expected


def test_sequence_is_dense_in_order(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("k"), F.lit("hot").alias("g"))
    rows = N.with_sequence(df, [F.desc("g"), F.asc("k")], after=5).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(6, 10_006))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_sequence_of_nothing(spark):
    assert N.with_sequence(spark.range(0), [F.asc("id")]).count() == 0


def test_rejected_rows_use_no_number(spark):
    accepted = spark.createDataFrame([(9,), (2,), (4,)], "row_num bigint")
    got = N.allocate_job_orders(accepted, jo(spark, ["jo-0012"]), [F.asc("row_num")]).orderBy("row_num").collect()
    assert [(r["row_num"], r["job_order"]) for r in got] == [(2, "jo-0013"), (4, "jo-0014"), (9, "jo-0015")]


def test_first_per_key_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    first = N.first_per_key(df, [F.col("k")], [F.desc("id")])
    assert sorted(tuple(r) for r in first.collect()) == [(0, 99), (1, 97), (2, 98)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_shared_dir_comes_from_the_session(spark, tmp_path, monkeypatch):
    get = type(spark.conf).get
    answers = {"spark.checkpoint.dir": str(tmp_path)}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: answers.get(key) or get(self, key, *rest))
    assert shared_dir(spark) == str(tmp_path)
    assert N.with_sequence(spark.range(5), [F.asc("id")]).count() == 5
    assert any(tmp_path.iterdir())


def test_no_folder_of_this_machine(spark, monkeypatch):
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: None if key == "spark.checkpoint.dir" else get(self, key, *rest))
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(spark)
