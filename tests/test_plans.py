from quern.plans import memo
from quern.plans.names import fresh
from quern.plans.shared import prepare


def test_fresh_names():
    assert fresh(["a", "B"], "a", "b", "c", "c") == ["a_", "b_", "c", "c_"]
    assert fresh(["a", "a_"], "A") == ["A__"]


def test_batches_are_bounded(spark):
    prepare(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20
    assert spark.range(3).mapInArrow(lambda batches: batches, "id long").count() == 3


def test_memo_drops_what_others_keep():
    seen = []
    for name in ("x", "x", "y", "x"):
        memo.only(name, lambda name=name: seen.append(name))
    assert seen == ["x", "y"]
    memo._kept.pop("x")
