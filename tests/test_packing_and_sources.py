import random

import pytest
from helpers import pod, pods, rows
from pyspark.sql import functions as F

from fleetfold import schema as S
from fleetfold.operators import packing as K
from fleetfold.sources import conf_files as CF
from fleetfold.sources import documents as D
from fleetfold.sources.scratch import materialize, scratch_dir


def units(text):
    return len(text.encode("utf-16-le")) // 2


def brute(files, budget):
    out = []
    for app in {f[0] for f in files}:
        mine = [(units(n) + len(c.encode()), n, units(n) + units(c)) for a, n, c in files if a == app]
        total = 0
        for size, name, cost in sorted(mine):
            if size <= budget and total + cost < budget:
                out.append((app, name))
                total += cost
    return sorted(out)


def frame(spark, files):
    return spark.createDataFrame([(a, n, len(c.encode()), c) for a, n, c in files], S.CONF_FILES)


def test_budget_examples(spark):
    many = [("a", f"testConf.{i}", "test123456") for i in range(1, 10_001)]
    df = frame(spark, many)
    assert rows(K.pack_by_budget(df, 60), "file_name") == [("testConf.1",), ("testConf.2",)]
    assert K.pack_by_budget(df, 250_000).count() == 10_000
    nine = frame(spark, [("a", f"file-{i}", "x" * 14) for i in range(1, 10)])
    assert rows(K.pack_by_budget(nine, 80), "file_name") == [("file-1",), ("file-2",), ("file-3",)]


def test_later_files_that_fit_are_still_taken(spark):
    # three-byte letters: large on disk, few characters
    files = [("a", "f1", "x" * 40), ("a", "f2", "x" * 47), ("a", "f3", "中" * 17), ("a", "f4", "中" * 18), ("a", "f5", "中" * 20)]
    assert brute(files, 88) == [("a", "f1"), ("a", "f3"), ("a", "f4")]
    assert rows(K.pack_by_budget(frame(spark, files), 88), "app_id", "file_name") == brute(files, 88)


def test_packing_matches_a_plain_loop(spark):
    rng = random.Random(3)
    alphabets = ["ab", "aé", "中文a", "😀a中"]
    files = []
    for a in range(60):
        for i in range(rng.randrange(1, 30)):
            letters = rng.choice(alphabets)
            files.append((f"app{a}", f"n{rng.randrange(10**6)}-{i}", "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))))
    df = frame(spark, files)
    for budget in (60, 150, 333):
        assert rows(K.pack_by_budget(df, budget), "app_id", "file_name") == brute(files, budget)


def test_bundle(spark):
    files = frame(spark, [("a", "b.conf", "2"), ("a", "a.conf", "1"), ("a", "big", "x" * 200)])
    labels = spark.createDataFrame([("a", "team", "t"), ("a", "other", "o")], S.CONF)
    row = K.sorted_keys(K.write_conf_bundle(files, labels, ["team"], budget=50)).first()
    assert row["name"] == "a-conf-map" and row["data"] == {"a.conf": "1", "b.conf": "2"}
    assert row["labels"] == {"team": "t"} and row["keys"] == ["a.conf", "b.conf"]


def test_conf_files(spark, tmp_path):
    folder = tmp_path / "in" / "app1"
    folder.mkdir(parents=True)
    (tmp_path / "in" / "empty").mkdir()
    names = ("test.txt", "sample.conf", "_test", ".dot", "x.zip", "y.jar", "z.template", "spark-defaults.conf", "spark.properties", "c.gz", "d.tar")
    for name in names:
        (folder / name).write_text(name)
    (folder / "latin.txt").write_bytes(b"\xff\xfe\xfd")
    (folder / "large.txt").write_text("x" * 500)
    got = CF.read_conf_files(spark, str(tmp_path / "in"), budget=100)
    assert rows(got, "app_id", "file_name", "content") == [("app1", n, n) for n in (".dot", "_test", "sample.conf", "test.txt")]
    every = CF.read_conf_files(spark, f"file://{tmp_path}/in", budget=100, rejected=True)
    why = dict(rows(every, "file_name", "reason"))
    assert why["latin.txt"] == "encoding" and why["large.txt"] == "size" and why["test.txt"] is None
    assert [n for n, r in sorted(why.items()) if r == "name"] == sorted(names[4:])
    assert every.filter("reason is not null and content is not null").count() == 0


def test_conf_files_are_written_and_read_back(spark):
    path = scratch_dir(spark, "conf")
    texts = [("a", ".hidden", "é\n" * 3), ("a", "_u", ""), ("b", "long.conf", "x" * 200_000)]
    df = spark.createDataFrame(texts, "app_id string, file_name string, content string")
    for _ in range(2):  # a repeated write leaves the same files
        CF.write_conf_files(df, path)
    assert rows(CF.read_conf_files(spark, path), "app_id", "file_name", "content") == sorted(texts, key=repr)


ODD = ["plain", "a=b", " lead", "trail ", "tab\there", "line\nbreak", 'quote"s', "back\\slash", "\\\"", "#x", "!y", "ü中😀", "", "c:d", "\\\\", "a\\"]


def test_properties_round_trip(spark):
    entries = [("1", f"key {i}{v}", v) for i, v in enumerate(ODD)]
    path = scratch_dir(spark, "props")
    CF.write_properties(spark.createDataFrame(entries, S.CONF), path)
    assert rows(CF.read_properties(spark, path), "app_id", "key", "value") == sorted(entries, key=repr)
    assert all(ord(c) < 127 for r in spark.read.text(path).collect() for c in r["value"])


def test_properties_syntax(spark):
    lines = ["# note", "! note", "", "  k1 = v1", "k2: v2", "k3 v3", "k4", "k\\ 5=\\u00fc x", "k6==x"]
    df = spark.createDataFrame([("a", x) for x in lines], "app_id string, value string")
    assert rows(CF.from_properties(df), "key", "value") == [
        ("k 5", "ü x"), ("k1", "v1"), ("k2", "v2"), ("k3", "v3"), ("k4", ""), ("k6", "=x")]


PHYSICAL = [
    "a = one\\", "   two\\", "\t three", "# note that does not go on \\", "b: 1\\\\", "c 2", "d = x\\", "", "e = \\b\\t\\u00e9\\ud83d\\ude00",
    "f = \\u12", "  ! note", "g\\", "h\\=i = j k ", "k = y\\", "# part of the value\\", " end", "last = z\\",
]
LOGICAL = [
    ("a", "onetwothree", False), ("b", "1\\", False), ("c", "2", False), ("d", "x", False), ("e", "b\té😀", False), (None, None, True),
    ("gh=i", "j k ", False), ("k", "y# part of the valueend", False), ("last", "z", False),
]


@pytest.mark.parametrize("chunk", [1, 2, 3, 4096])
def test_logical_records_over_physical_lines(spark, chunk):
    lines = [("a", "f", i // 5 * 100, i % 5, x) for i, x in enumerate(PHYSICAL)]
    lines += [("a", "g", 0, i, x) for i, x in enumerate(["k\\", "v = 1"])]
    df = spark.createDataFrame(lines, "app_id string, file string, block bigint, at bigint, value string").repartition(4)
    got = CF.from_properties(CF.logical_records(df, ["app_id", "file"], "block", "at", chunk))
    of_f = got.filter("file = 'f'").orderBy("place").collect()
    assert [(r.key, r.value, r.error is not None) for r in of_f] == LOGICAL
    assert "malformed" in of_f[5].error and "u12" in of_f[5].error
    assert rows(got.filter("file = 'g'"), "key", "value") == [("kv", "1")]


def test_properties_of_files_in_many_blocks(spark, tmp_path):
    """A file that is split between tasks, with records over every border."""
    folder = tmp_path / "app_id=x"
    folder.mkdir()
    with open(folder / "part.txt", "w") as f:
        for i in range(3000):
            f.write(f"key{i} = first \\\n    {i} \\\n\tlast\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        got = CF.read_properties(spark, str(tmp_path))
        assert rows(got, "key", "value") == sorted([(f"key{i}", f"first {i} last") for i in range(3000)], key=repr)
        order = [r.key for r in got.orderBy("place").collect()]
        assert order == [f"key{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_staging_plan(spark):
    uris = ["/opt/a.jar", "file:///x/b.jar", "file:/x/c.zip#arch", "local:///d.jar", "s3a://b/e.jar", "rel/f.jar", "g.zip#n"]
    df = spark.createDataFrame([("a", "archives", "7", u) for u in uris], "app_id string, kind string, upload_id string, uri string")
    got = {r.uri: (r.is_local, r.target) for r in CF.staging_plan(df, "hdfs:/up").collect()}
    up = "hdfs:/up/spark-upload-7/"
    assert got == {
        "/opt/a.jar": (True, up + "a.jar"), "file:///x/b.jar": (True, up + "b.jar"), "file:/x/c.zip#arch": (True, up + "c.zip#arch"),
        "local:///d.jar": (False, "local:///d.jar"), "s3a://b/e.jar": (False, "s3a://b/e.jar"),
        "rel/f.jar": (True, up + "f.jar"), "g.zip#n": (True, up + "g.zip#n")}


def test_documents(spark):
    off = pod(2)
    off["labels"] = {**off["labels"], S.INACTIVE_LABEL: "true"}
    driver = pod(3)
    driver["labels"] = {S.ROLE_LABEL: S.DRIVER_ROLE}
    path = scratch_dir(spark, "docs")
    D.write_documents(pods(spark, pod(1), off, driver, pod(4, sync_ts=5), dict(off, exec_id=5, sync_ts=5)), path)
    assert rows(D.read_changes(spark, path), "exec_id") == [(1,), (2,)]
    assert rows(D.read_listing(spark, path), "exec_id") == [(4,)]
    assert D.read_changes(spark, path, streaming=True).isStreaming


def test_documents_of_a_batch_scheduler(spark):
    """Known jobs whatever the role; tests on plain columns reach the scan."""
    def of(exec_id, job, **more):
        row = pod(exec_id, **more)
        row["labels"] = {"job": job} if job else {}
        return row

    off = of(3, "j1")
    off["labels"][S.INACTIVE_LABEL] = "true"
    docs = [of(1, "j1"), of(2, "j9"), off, of(4, None), of(5, "j2", sync_ts=7), dict(off, exec_id=6, sync_ts=7), of(7, "j1", app="b")]
    jobs = spark.createDataFrame([("a", "j1"), ("a", "j2"), ("a", "j1")], "app_id string, job_name string")
    for format in ("json", "parquet"):
        path = scratch_dir(spark, "job-docs")
        D.write_documents(pods(spark, *docs), path, job_label="job", format=format)
        assert rows(D.read_changes(spark, path, jobs=jobs, format=format), "exec_id") == [(1,), (3,)]
        assert rows(D.read_listing(spark, path, jobs=jobs, format=format), "exec_id") == [(5,)]
        assert rows(D.read_listing(spark, path, format=format), "exec_id") == []
    plan = D.read_listing(spark, path, jobs=jobs, format="parquet")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "IsNotNull(sync_ts)" in pushed and "inactive" in pushed and "IsNotNull(job_name)" in pushed
    plan = D.read_changes(spark, path, format="parquet")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,executor)" in plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]


def test_scratch_stays_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)
    kept = materialize(spark.range(3).select(F.col("id"), F.lit(None).cast("int").alias("n")), "kept")
    assert kept.count() == 3 and kept.columns == ["id", "n"]


@pytest.mark.parametrize("name,ok", [("a.conf", True), ("sparkly.conf", False), ("x.template", False), ("spark.txt", True), ("a.tar.txt", True)])
def test_bundle_names(spark, name, ok):
    assert spark.range(1).select(CF.is_bundle_name(F.lit(name))).first()[0] is ok
