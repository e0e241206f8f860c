import pytest
from pyspark.sql import functions as F

from photonloom.operators.registry import ChoiceRegister, Variant
from photonloom.operators.windows import stall_epoch
from photonloom.sources import readers, sinks
from photonloom.streaming.incremental import pending


def test_writes_refuse_overwrite_and_foreign_roots(spark, tmp_path):
    df = spark.range(3)
    root = str(tmp_path)
    sinks.guarded_write(df, f"{root}/a", root)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.guarded_write(df, f"{root}/a", root)
    for bad in ("/somewhere/else", f"{root}/../b"):
        with pytest.raises(PermissionError):
            sinks.guarded_write(df, bad, root)


def test_finished_runs_are_skipped(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run string, rmse double")
    sinks.append_runs(runs.limit(1), f"{root}/runs", root, "run")
    sinks.append_runs(runs, f"{root}/runs", root, "run")
    assert spark.read.parquet(f"{root}/runs").count() == 2
    assert pending(runs, spark.read.parquet(f"{root}/runs"), "run").count() == 0


def test_empty_prediction_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_predictions(spark, str(tmp_path), "a string")


def test_register_keeps_the_first_choice(spark, tmp_path):
    root = str(tmp_path)
    reg = ChoiceRegister(spark, f"{root}/choice", root)
    p = spark.createDataFrame([(1, 0.5), (2, 0.25)], "obj long, pred double")
    first = reg.register("blend", p, ["obj"], "pred")
    assert first == ("blend", first[1], False)
    assert reg.register("blend", p.orderBy(F.desc("obj")), ["obj"], "pred") == first
    assert reg.register("other", p.withColumn("pred", F.col("pred") + 1), ["obj"], "pred") == ("blend", first[1], True)


def test_variant_key_and_fallback(spark):
    f = lambda px, k: px.withColumn("flux", F.when(F.col("flux") > k, F.col("flux") * 2))
    a, b = Variant("double", f, {"k": 0}), Variant("double", f, {"k": 1})
    assert a.key != b.key and a.key == Variant("double", f, {"k": 0}).key
    rows = {r["flux"]: (r["failed"], r["reason"]) for r in a.apply(spark.createDataFrame([(3.0,), (-1.0,)], "flux double")).collect()}
    assert rows == {6.0: (False, None), -1.0: (True, "value not finite")}


def test_stall_rule(spark):
    loss = [1.0, 0.9, 0.8999, 0.8998, 0.5, 0.6, 0.7, 0.8]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(loss)], "run string, epoch int, loss double")
    assert stall_epoch(df, "run", "loss", ["epoch"], 1e-3, 3).first()["stop_epoch"] == 7
    assert stall_epoch(df, "run", "loss", ["epoch"], 1e-3, 2).first()["stop_epoch"] == 3
    assert stall_epoch(df, "run", "loss", ["epoch"], 1e-3, 9).first()["stop_epoch"] is None
