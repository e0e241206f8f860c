import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from photonloom.operators.registry import Variant
from photonloom.sources import pixel_cache as PC

LAYOUT = PC.CubeLayout(6, 4, ("g", "r"))


def cubes(spark, n, change=None):
    rows = [(i, [float(100 * i + p) for p in range(36)], [float(p % 5) for p in range(36)]) for i in range(n)]
    return spark.createDataFrame([change(r) if change else r for r in rows], LAYOUT.schema)


def stored(spark, out):
    return {r["obj_id"]: r for r in PC.read_cache(spark, out, LAYOUT).collect()}


def test_centres_and_zero_shares(spark, tmp_path):
    root = str(tmp_path)
    faint = lambda r: (r[0], [1e-60] * 36 if r[0] == 2 else r[1], r[2])
    cubes(spark, 5, faint).repartition(4).write.parquet(f"{root}/in")
    done = PC.build_cache(spark, f"{root}/in", f"{root}/out", root, LAYOUT, files_per_chunk=1)
    assert done.agg(F.sum("n_objects")).first()[0] == 5 and done.count() > 1
    rows = stored(spark, f"{root}/out")
    want = [6 * y + x for y in range(1, 5) for x in range(1, 5)]
    assert sorted(rows) == list(range(5)) and rows[3]["g"] == [300.0 + p for p in want]
    assert rows[3]["zero_r"] == pytest.approx(sum(p % 5 == 0 for p in want) / 16)
    assert rows[2]["g"] == [0.0] * 16 and rows[2]["zero_g"] == 0.0  # below the smallest float, yet not a zero
    PC.build_cache(spark, f"{root}/in", f"{root}/out", root, LAYOUT, files_per_chunk=1)
    assert len(PC.read_cache(spark, f"{root}/out", LAYOUT).collect()) == 5  # a second run adds nothing
    with pytest.raises(ValueError, match="other settings"):
        PC.build_cache(spark, f"{root}/in", f"{root}/out", root, PC.CubeLayout(6, 2, ("g", "r")))


@pytest.mark.parametrize("fault", ["size of g", "values of r not finite", "no id"])
def test_cubes_that_fail_the_controls_stop_the_run(spark, tmp_path, fault):
    root = str(tmp_path)
    spoilt = {"size of g": lambda r: (r[0], r[1][:35], r[2]), "values of r not finite": lambda r: (r[0], r[1], r[2][:14] + [float("nan")] + r[2][15:]),
              "no id": lambda r: (None, r[1], r[2])}[fault]
    cubes(spark, 4, lambda r: spoilt(r) if r[0] == 1 else r).coalesce(1).write.parquet(f"{root}/in")
    with pytest.raises(Exception, match="fail the controls"):
        PC.build_cache(spark, f"{root}/in", f"{root}/out", root, LAYOUT)
    assert [r["reason"] for r in spark.read.parquet(f"{root}/out/errors").collect()] == [fault]
    assert stored(spark, f"{root}/out") == {} and PC.manifest(spark, f"{root}/out").count() == 0


def test_values_outside_the_crop_are_not_judged(spark, tmp_path):
    root = str(tmp_path)
    cubes(spark, 2, lambda r: (r[0], [None] + r[1][1:], [float("inf")] + r[2][1:])).write.parquet(f"{root}/in")
    PC.build_cache(spark, f"{root}/in", f"{root}/out", root, LAYOUT)
    assert len(stored(spark, f"{root}/out")) == 2


def halved(share):
    return Variant("halved", lambda px: px.withColumn("flux", F.when((F.col("obj_id") != 1) | (F.col("band") != "r"), F.col("flux") / 2)), max_failed_share=share)


def test_a_failed_pixel_keeps_the_whole_cube_raw_within_the_budget(spark, tmp_path):
    root = str(tmp_path)
    cubes(spark, 4).repartition(4).write.parquet(f"{root}/in")
    with pytest.raises(Exception, match="could not be prepared"):
        PC.build_cache(spark, f"{root}/in", f"{root}/strict", root, LAYOUT, halved(0.2), files_per_chunk=1)
    assert PC.build_cache(spark, f"{root}/in", f"{root}/out", root, LAYOUT, halved(0.25), files_per_chunk=1).agg(F.sum("n_fallback")).first()[0] == 1
    rows = stored(spark, f"{root}/out")
    assert [rows[i]["fallback"] for i in range(4)] == [False, True, False, False]
    assert rows[1]["g"][0] == 107.0 and rows[2]["g"][0] == 103.5 and rows[2]["r"][0] == 1.0


KILLED = """
import os, sys
sys.path.insert(0, sys.argv[1])
from photonloom.operators.registry import Variant
from photonloom.session import build_session
from photonloom.sources import pixel_cache as PC
seen = []
def fn(px):
    seen.append(1)
    if len(seen) == 3:
        os._exit(9)
    return px
root = sys.argv[2]
PC.build_cache(build_session("local[2]", 2), root + "/in", root + "/out", root, PC.CubeLayout(6, 4, ("g", "r")), Variant("same", fn), files_per_chunk=1)
"""


def test_a_killed_driver_resumes_with_its_unfinished_chunk(spark, tmp_path):
    root = str(tmp_path)
    for i in range(5):
        cubes(spark, 5).where(F.col("obj_id") == i).coalesce(1).write.parquet(f"{root}/in/part{i}")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", KILLED, repo, root], cwd=root, capture_output=True, timeout=180).returncode == 9
    assert PC.manifest(spark, f"{root}/out").count() == 2 and len(stored(spark, f"{root}/out")) == 2
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/out/chunks/*/*.parquet")}
    PC.build_cache(spark, f"{root}/in", f"{root}/out", root, LAYOUT, Variant("same", lambda px: px), files_per_chunk=1)
    assert sorted(stored(spark, f"{root}/out")) == list(range(5))
    assert before and all(os.stat(f).st_mtime_ns == m for f, m in before.items())
