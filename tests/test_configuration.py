import pytest
from helpers import rows

from fleetfold import schema as S
from fleetfold.operators import conf as C
from fleetfold.operators import names as N
from fleetfold.operators import sizing as Z
from fleetfold.operators import volumes as V

P = "spark.kubernetes.executor.volumes."
SIZE = ("app_id string, memory_mib bigint, factor double, kind string, overhead_mib bigint, offheap_mib bigint, "
        "pyspark_mib bigint, cores int, request_cores string, limit_cores string")


def conf(spark, **apps):
    return spark.createDataFrame([(a, k, v) for a, d in apps.items() for k, v in d.items()], S.CONF)


def test_env_keys(spark):
    keys = ["env1", "env-2", "_.x", "2env", "a*b", "end\n"]
    df = conf(spark, a={f"spark.executorEnv.{k}": "v" for k in keys})
    assert [r[0] for r in rows(C.valid_env(df), "key")] == ["_.x", "env-2", "env1"]
    assert sorted(r[0] for r in rows(C.invalid_env(df), "key")) == ["2env", "a*b", "end\n"]


def test_labels_reject_reserved_keys(spark):
    df = conf(spark, a={"spark.kubernetes.executor.label.team": "x", "spark.kubernetes.executor.label.spark-role": "y"})
    members = spark.createDataFrame([("a", 1, 0), ("a", 2, 3)], "app_id string, exec_id bigint, profile_id int")
    out = rows(C.merge_labels(df, members, "executor").filter("exec_id = 2"), "key", "value", "source", "rejected")
    assert out == [
        ("spark-app-selector", "a", "preset", False), ("spark-exec-id", "2", "preset", False),
        ("spark-exec-resourceprofile-id", "3", "preset", False), ("spark-role", "executor", "preset", False),
        ("spark-role", "y", "custom", True), ("team", "x", "custom", False)]


def test_resolve_conf(spark):
    df = conf(spark, a={
        "spark.kubernetes.allocation.batch.size": "0", "spark.kubernetes.allocation.batch.delay": "2m",
        "spark.kubernetes.container.image": "img", "spark.kubernetes.memoryOverheadFactor": "1.0",
        "spark.kubernetes.appKillPodDeletionGracePeriod": "90s", "spark.kubernetes.pyspark.pythonVersion": "2",
    }, b={"other": "1"})
    got = {(r.app_id, r.key.removeprefix("spark.kubernetes.")): r for r in C.resolve_conf(df).collect()}
    assert len(got) == 2 * len(C.SETTINGS)
    assert got["a", "allocation.batch.size"].violation == "not positive"
    assert got["a", "allocation.batch.delay"].number == 120_000 and got["a", "allocation.batch.delay"].violation is None
    assert got["a", "driver.container.image"][3:5] == ("img", "fallback")
    assert got["a", "memoryOverheadFactor"].violation == "not in [0, 1)"
    assert got["a", "appKillPodDeletionGracePeriod"].number == 90
    assert got["a", "pyspark.pythonVersion"].violation == "not allowed"
    assert got["b", "allocation.executor.timeout"].number == 600_000
    assert got["b", "driver.container.image"][3:5] == (None, "none")
    assert {r.violation for k, r in got.items() if k[0] == "b"} == {None}
    extra = C.batch_settings("sched")
    assert {r.value for r in C.resolve_conf(df, extra).collect()} == {"false", "default", "sched", "3", "true"}


def test_duplicate_settings_do_not_break_the_map(spark):
    df = conf(spark, a={"spark.kubernetes.namespace": "n"})
    df = df.unionByName(df)
    assert rows(C.settings_by_app(df, ["spark.kubernetes.namespace"]), "app_id") == [("a",)]


def test_check_options(spark):
    rules = [("not_both", "x", "y"), ("both_or_neither", "x", "z"), ("second_if_first", "y", "z")]
    df = conf(spark, a={"x": "1", "y": "1"}, b={"z": "1"}, c={"q": "1"})
    assert rows(C.check_options(df, rules), "app_id", "rule") == [
        ("a", "both_or_neither"), ("a", "not_both"), ("a", "second_if_first"), ("b", "both_or_neither")]


def test_effective_settings(spark):
    df = conf(spark, a={"spark.blockManager.port": "80", "spark.local.dir": "/x,/y"}, b={"k": "v"})
    env = conf(spark, b={"PYSPARK_PYTHON": "py"})
    mounted = spark.createDataFrame([("b", 1, "/m")], "app_id string, idx int, path string")
    got = {(r.app_id, r.setting): (r.value, r.source, r.legal) for r in C.effective_settings(df, env, mounted).collect()}
    assert got["a", "driver_block_manager_port"] == ("80", "shared", False)
    assert got["a", "service_block_manager_port"] == ("7079", "default", True)
    assert got["a", "executor_block_manager_port"] == ("80", "conf", False)
    assert got["a", "driver_port"] == ("7078", "default", True)
    assert got["a", "local_dir_2"] == ("/y", "conf", None)
    assert got["b", "driver_python"] == ("py", "shared_env", None)
    assert got["b", "local_dir_1"] == ("/m", "mounted", None)
    assert ("a", "executor_python") not in got


def test_volumes(spark):
    df = conf(spark, a={
        P + "hostPath.h.mount.path": "/data", P + "hostPath.h.options.path": "/host", P + "hostPath.h.mount.readOnly": "true",
        P + "persistentVolumeClaim.p.mount.path": "/data", P + "persistentVolumeClaim.p.options.claimName": "OnDemand",
        P + "persistentVolumeClaim.p.options.storageClass": "gp", P + "persistentVolumeClaim.p.options.sizeLimit": "1Gi",
        P + "emptyDir.e.mount.path": "/e", P + "emptyDir.e.mount.subPath": "s",
        P + "nfs.n.mount.path": "/n", P + "nfs.n.options.path": "/share",
        P + "hostPath.bad.mount.path": "/b", P + "hostPath.none.options.path": "/b", P + "tape.t.mount.path": "/t",
        P + "persistentVolumeClaim.q.mount.path": "/q",
    })
    vols = V.parse_volumes(df, P)
    errors = dict(rows(vols, "name", "error"))
    assert errors == {
        "h": None, "p": None, "e": None,
        "n": "nfs.n.options.server is required for nfs",
        "bad": "hostPath.bad.options.path is required for hostPath",
        "none": "hostPath.none.mount.path is required for hostPath",
        "t": "Volume type `tape` is not supported",
        "q": "persistentVolumeClaim.q.options.claimName is required for persistentVolumeClaim",
    }
    assert rows(vols.filter("error is null"), "name", "sub_path", "read_only") == [
        ("e", "s", False), ("h", "", True), ("p", "", False)]
    assert rows(V.volume_claims(vols), "name", "storage_class", "size", "access_mode") == [("p", "gp", "1Gi", "ReadWriteOnce")]
    assert rows(V.duplicate_mounts(vols.filter("error is null")), "mount_path", "n") == [("/data", 2)]


def test_placeholders(spark):
    df = spark.createDataFrame(
        [("a", "pre", "OnDemand", 0, 1, "/d/SPARK_APPLICATION_ID/SPARK_EXECUTOR_ID"), ("a", "pre", "pvc-spark-SPARK_EXECUTOR_ID", 1, 1, "")],
        "app_id string, prefix string, claim_name string, idx bigint, exec_id bigint, dirs string")
    assert rows(V.substitute_placeholders(df, "executor"), "claim_name", "dirs") == [
        ("pre-exec-1-pvc-0", "/d/a/1"), ("pvc-spark-1", "")]
    assert rows(V.substitute_placeholders(df, "driver"), "claim_name") == [
        ("pre-driver-pvc-0",), ("pvc-spark-SPARK_EXECUTOR_ID",)]


DRIVERS = [(7680, None, "java", 8448), (7680, None, "python", 10752), (7680, 0.9, "python", 14592), (7680, None, "r", 10752)]


def test_driver_sizes(spark):
    df = spark.createDataFrame(
        [(str(i), m, f, k, None, None, None, 2, None, None) for i, (m, f, k, _) in enumerate(DRIVERS)], SIZE)
    assert [t for _, t in rows(Z.size_driver(df), "app_id", "total_mib")] == [d[3] for d in DRIVERS]
    assert rows(Z.size_driver(df), "cpu_request") == [("2",)] * 4


def test_executor_sizes(spark):
    apps = [
        ("plain", 1024, None, "java", None, None, None, 1, None, None, 1408),
        ("pyspark", 1024, 0.1, "python", None, None, 42, 1, None, None, 1450),
        ("pyspark on jvm", 1024, None, "java", None, None, 42, 1, None, None, 1408),
        ("offheap", 1024, None, "java", None, 42, None, 1, None, None, 1450),
        ("non-jvm", 1024, None, "r", None, None, None, 1, None, None, 1433),
        ("factor", 1024, 0.8, "java", None, None, None, 1, None, None, 1843),
        ("factor pyspark", 1024, 0.8, "python", None, None, 200, 1, None, None, 2043),
    ]
    df = spark.createDataFrame([a[:-1] for a in apps], SIZE)
    prof = "app_id string, profile_id int, memory_mib bigint, overhead_mib bigint, offheap_mib bigint, pyspark_mib bigint, cores int"
    base = spark.createDataFrame([(a[0], 0, None, None, None, None, None) for a in apps], prof)
    assert dict(rows(Z.size_executor(df, base), "app_id", "total_mib")) == {a[0]: a[-1] for a in apps}
    own = spark.createDataFrame([("pyspark", 1, 2048, 1024, None, 3072, 4)], prof)
    assert rows(Z.size_executor(df, own), "total_mib", "quantity", "cpu_request") == [(6144, "6144Mi", "4")]


def test_custom_resources(spark):
    df = spark.createDataFrame([("a", "gpu", "nvidia.com", 2), ("a", "fpga", None, 1), ("a", "x", "", 1)],
                               "app_id string, name string, vendor string, amount int")
    assert rows(Z.custom_resources(df).filter("error is null"), "resource", "amount") == [("nvidia.com/gpu", 2)]
    assert Z.custom_resources(df).filter("error is not null").count() == 2
    with pytest.raises(Exception, match="vendor was not specified"):
        Z.custom_resources(df, strict=True).collect()


def test_names(spark):
    df = spark.createDataFrame(
        [("a", "\t My  App.v2 (x)--y ", "77", 3, "jp"), ("b", "long " * 20, "8", 4, "jp")],
        "app_id string, app_name string, run_id string, exec_id bigint, job_prefix string")
    got = {r.app_id: r for r in N.derive_names(df).collect()}
    a, b = got["a"], got["b"]
    assert a.prefix == "my-app-v2-x-y-77"
    assert (a.pod_name, a.driver_name, a.job_name, a.job_driver_name) == (
        "my-app-v2-x-y-77-exec-3", "my-app-v2-x-y-77-driver", "jp-3", "jp-driver-0")
    assert a.host_name == a.pod_name and a.service_name == "my-app-v2-x-y-77-driver-svc"
    assert len(b.host_name) <= 63 and b.host_name.endswith("-exec-4") and b.host_name[0] != "-"
    assert b.service_name == "spark-8-driver-svc" and b.bundle_name == b.prefix[:54] + "-conf-map"
    members = spark.createDataFrame([("a", "p-exec-1"), ("a", "p-exec-2"), ("b", "p-exec-1"), ("b", "q-exec-1")], "app_id string, name string")
    assert rows(N.name_prefixes(members), "app_id", "n_prefixes", "ok") == [("a", 1, True), ("b", 2, False)]
