import pytest

from tracewell.operators.skew import even_lookup


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_out_and_nothing_changes(spark, how):
    left = spark.range(30_000).selectExpr("case when id % 3 = 0 then 'hot' when id % 3000 = 1 then null else concat('k', id % 5000) end k", "id")
    right = spark.range(4000).selectExpr("concat('k', id) k", "id v").union(spark.sql("select 'hot', -1L"))
    plain = sorted(map(repr, left.join(right, "k", how).collect()))
    dealt = even_lookup(left, right, "k", how)
    assert sorted(map(repr, dealt.collect())) == plain
    assert "_salt" in dealt._jdf.queryExecution().analyzed().toString() and "_salt" not in dealt.columns


def test_even_and_empty_sides(spark):
    left = spark.range(10).selectExpr("cast(id as string) k")
    assert even_lookup(left, left, "k").count() == 10
    assert even_lookup(left.where("false"), left, "k", "left").count() == 0
    assert even_lookup(left, left.where("false"), "k", "left", "merge").count() == 10
