"""Plan shapes that must hold at scale."""

import itertools
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w01_growth_curve", "r12_gaussian_smoothing", "r38_half_light_radius", "r33_mean_of_symmetries"])
def test_images_are_shuffled_once(spark, name):
    p = plan(spark, name)
    assert len(re.findall(r"Exchange hashpartitioning\(obj_id", p)) == 1 and p.count("Exchange hashpartitioning") == 1


def test_top_n_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "w08_worst_per_group").split("Exchange hashpartitioning(family")[1]


def test_scans_read_only_what_is_used(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(spark, "a14_group_describe")).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_extendedprice", "l_returnflag", "l_linestatus"}
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan(spark, "j07_membership_filter")


@pytest.mark.parametrize("name", ["a01_regression_metrics", "a40_train_quartile_groups", "e04_apply_weights", "j18_train_standardizer"])
def test_no_cartesian_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_join_broadcasts_exploded_rows(spark):
    """The size of a scan says nothing about rows exploded from it: only tables known to be small are broadcast."""
    for name in ("j10_paired_models", "a06_object_loss", "a21_change_against_baseline", "a41_subgroup_regimes"):
        p = plan(spark, name).splitlines()
        deep = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i, line in enumerate(p):
            if "BroadcastExchange" in line:
                below = list(itertools.takewhile(lambda x: deep(x) > deep(line), p[i + 1:]))
                assert not any("Generate" in x for x in below), name


def test_small_tables_are_counted_before_they_are_broadcast(spark, monkeypatch):
    from photonloom import session

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(session.small(spark.range(10)))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 9)
    assert not hinted(session.small(spark.range(10)))


def test_tasks_grow_with_the_table(spark, monkeypatch):
    """What one task reads stays the same on larger tables."""
    from photonloom.plans import bindings, registry

    t = registry.Tables(spark, SF)
    monkeypatch.setattr(registry, "ROWS_PER_TASK", 100)
    assert t.spread("orders", "o_orderkey").rdd.getNumPartitions() == -(-t.orders.count() // 100) > 8
    monkeypatch.setattr(bindings, "IMAGES_PER_TASK", 1)
    images = -(-t.embeddings.count() // 25)
    assert images > 8 and bindings.images(t).rdd.getNumPartitions() == images


def test_shuffles_are_put_together_by_size(spark):
    entry.queries()["a41_subgroup_regimes"](spark, SF)
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= 1000
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_family_means_are_taken_before_the_targets_are_unpivoted(spark):
    """every target of a member was a row of its own below the aggregation."""
    from photonloom.plans import bindings, registry

    p = bindings.family_mean(registry.Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate inline.*?Aggregate", p, re.S) and p.count("Generate") == 2


def test_ablation_fits_join_nothing(spark):
    """the random 85 % were joined anew for each of the eight fits; now all read one stored table with a flag per seed."""
    p = entry.queries()["m06_feature_set_ablation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in p and p.count("Relation") == 8


def test_family_residuals_are_those_of_the_long_table(spark, tmp_path):
    """one row per object of the same residuals, also where an object has several rows and its members lie in different ones."""
    from photonloom.plans.bindings import FAMILIES, TARGETS, Tables, family_mean, family_residuals
    from photonloom.session import tune

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    again = orders.where("o_orderkey % 7 = 0").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice + 20000 AS o_totalprice", "o_orderdate", "o_orderpriority")
    orders.union(again).write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(tune(spark), str(tmp_path))
    long = {(*(r[c] for c in ("obj_id", "split", "kind", "redshift")), f"r_{r.family}_{r.target}"): r.r for r in family_mean(t).selectExpr("*", "pred - y AS r").where("r IS NOT NULL").collect()}
    wide = family_residuals(t).collect()
    got = {(*r[:4], c): r[c] for r in wide for c in (f"r_{f}_{x}" for f in FAMILIES for x in TARGETS) if r[c] is not None}
    assert got.keys() == long.keys() and all(abs(got[k] - long[k]) < 1e-12 for k in got) and len(wide) > 1500
