"""What a task sorts must not grow with the rows it reads."""

import pytest

from fleetfold.operators import conf as C


def below_exchanges(df) -> str:
    """The part of the physical plan that runs before the first shuffle."""
    return df._jdf.queryExecution().executedPlan().toString().rpartition("Exchange hashpartitioning")[2]


def conf_rows(spark):
    rows = [(f"a{i % 7}", "spark.app.name" if i % 3 else "spark.driver.port", str(i)) for i in range(90)]
    return spark.createDataFrame([*rows, ("only", "other", "x"), (None, "spark.driver.port", "5")], "app_id string, key string, value string")


@pytest.mark.parametrize("query", [
    lambda conf: C.settings_by_app(conf, ["spark.driver.port"]),
    lambda conf: C.resolve_conf(conf),
    lambda conf: C.check_options(conf, [("not_both", "spark.driver.port", "spark.app.name")]),
    lambda conf: C.effective_settings(conf, conf),
])
def test_settings_are_dealt_out_before_they_are_sorted(spark, query):
    below = below_exchanges(query(conf_rows(spark)))
    assert "Aggregate" not in below and "Sort" not in below


def test_settings_of_an_app_on_many_tasks(spark):
    conf = conf_rows(spark).repartition(20)
    got = {r.app_id: r.conf for r in C.settings_by_app(conf, ["spark.driver.port"]).collect()}
    want = {f"a{a}": {"spark.driver.port": max(str(i) for i in range(0, 90, 3) if i % 7 == a)} for a in range(7)}
    assert got == want | {"only": {}, None: {"spark.driver.port": "5"}}
    placed = conf.selectExpr("*", "int(value) as line").filter("value <> 'x'")
    got = {r.app_id: r.conf for r in C.settings_by_app(placed, ["spark.driver.port"], order="line").collect()}
    want = {f"a{a}": {"spark.driver.port": str(max(i for i in range(0, 90, 3) if i % 7 == a))} for a in range(7)}
    assert got == want | {None: {"spark.driver.port": "5"}}


def test_options_of_apps_without_the_keys_are_not_shuffled(spark):
    conf = spark.createDataFrame([("a", "k1", "1"), ("a", "x", "1"), ("b", "x", "1"), ("c", "k2", "1")], "app_id string, key string, value string")
    found = C.check_options(conf.repartition(2), [("both_or_neither", "k1", "k2")])
    assert sorted(r.app_id for r in found.collect()) == ["a", "c"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter key#" in plan.rpartition("Exchange hashpartitioning")[2]


@pytest.mark.parametrize("query", [
    lambda conf: C.settings_by_app(conf, ["spark.driver.port"]),
    lambda conf: C.resolve_conf(conf),
    lambda conf: C.effective_settings(conf, conf),
])
def test_rows_without_a_named_key_are_not_shuffled(spark, query):
    below = below_exchanges(query(conf_rows(spark).repartition(2)))
    assert "Filter" in below and "slot" in below


def test_effective_settings_deal_rows_out_once(spark):
    conf = spark.createDataFrame(
        [("a", "spark.local.dir", "/x,/y,"), ("b", "other", "1"), ("c", "spark.local.dir", "/z"), (None, "spark.driver.port", "5")],
        "app_id string, key string, value string")
    env = spark.createDataFrame([(None, "SPARK_LOCAL_DIRS", "/n"), ("d", "OTHER", "1")], conf.schema)
    mounted = spark.createDataFrame(
        [("c", 1, "/m"), ("c", 2, "/m"), ("only", 1, "/o"), (None, 1, "/p")], "app_id string, idx int, path string")
    found = C.effective_settings(conf, env, mounted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "slot" in line for line in plan.splitlines()) == 1
    rows = [tuple(r) for r in found.select("app_id", "setting", "value", "source", "legal").collect()]
    assert sorted((r for r in rows if r[1].startswith("local_dir_")), key=repr) == sorted([
        ("a", "local_dir_1", "/x", "conf", None), ("a", "local_dir_2", "/y", "conf", None),
        ("b", "local_dir_1", "/var/data/spark-b", "default", None), ("d", "local_dir_1", "/var/data/spark-d", "default", None),
        ("c", "local_dir_1", "/m", "mounted", None), ("c", "local_dir_2", "/m", "mounted", None),
        ("only", "local_dir_1", "/o", "mounted", None),
        (None, "local_dir_1", "/p", "mounted", None), (None, "local_dir_1", "/n", "env", None)], key=repr)
    ports = {r[0]: r[2:] for r in rows if r[1] == "driver_port"}
    assert ports == dict.fromkeys("abcd", ("7078", "default", True)) | {None: ("5", "conf", False)}
    assert len([r for r in rows if r[1] == "app_type"]) == 5
