import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from minuteworks.plans.sidecars import jdbc_source
from minuteworks.sources import files as S
from minuteworks.streaming import live as K


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_manifests_and_backups(spark, tmp_path):
    put(tmp_path / "a.processing.json", {"schemaVersion": 1, "jobId": "j1", "status": "failed", "timingsMs": {"save": 2.5}, "updatedAt": "2"})
    put(tmp_path / "b.processing.json", "{broken")
    got = S.read_manifests(spark, str(tmp_path)).collect()
    assert [(r.jobId, r.timingsMs) for r in got] == [("j1", {"save": 2.5})]
    rows = [("/d/a.json", False), ("/d/.a.json.backup", True), ("/d/b.json", True), ("/d/b.json.backup", True), ("/d/c.json.backup", False), ("/d/e.json.backup", True), ("/d/f.json", False), ("/d/f.json.backup", True), ("/d/.g.json.backup", False), ("/d/g.json.backup", True)]
    kept = S.reconcile_backups(spark.createDataFrame(rows, "path string, valid boolean"))
    assert sorted(r.path for r in kept.collect()) == ["/d/.a.json.backup", "/d/.g.json.backup", "/d/b.json", "/d/c.json.backup", "/d/e.json.backup", "/d/f.json"]


def test_recovery_from_the_files(spark, tmp_path):
    good = lambda job: {"schemaVersion": 1, "jobId": job, "audioPath": "a.mp3", "status": "saving", "source": "import"}
    put(tmp_path / "x/a.processing.json", "{broken")
    put(tmp_path / "x/.a.processing.json.backup", good("a"))
    put(tmp_path / "x/deep/er/.b.processing.json.backup", good("b"))
    put(tmp_path / "c.processing.json.backup", good("c"))
    put(tmp_path / "d.processing.json", good("d"))
    put(tmp_path / "d.processing.json.backup", good("old"))
    put(tmp_path / "e.processing.json", "{broken")
    put(tmp_path / "e.processing.json.backup", good("too old to be used beside a primary"))
    put(tmp_path / "f.processing.json", good(" "))
    put(tmp_path / "f.txt", "no manifest")
    got = {r.job_path: (r.kind, r.primary_valid, r.reject_reason, r.jobId) for r in S.recovered_manifests(spark, f"file://{tmp_path}").collect()}
    assert got == {
        "x/a.processing.json": ("backup", False, None, "a"), "x/deep/er/b.processing.json": ("backup", None, None, "b"), "c.processing.json": ("legacy", None, None, "c"), "d.processing.json": ("primary", True, None, "d"),
        "e.processing.json": ("primary", False, "json", None), "f.processing.json": ("primary", False, "job_id", " "),
    }
    assert S.recovered_manifests(spark, f"file://{tmp_path}/nothing").count() == 0


def test_a_database_table_is_read_in_parts(spark):
    """Uneven keys, nulls among them: parts of equal rows, filter and columns in the database, same rows."""
    source = {"url": "jdbc:derby:memory:parts;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k**3, f"n{k}", k % 5) for k in range(1, 400)] + [(None, "none", 1), (None, "none", 2)]
    spark.createDataFrame(rows, "id long, name string, kind int").write.format("jdbc").options(**source, dbtable="things", createTableColumnTypes="name VARCHAR(20)").save()
    table = S.read_table(spark, source, "things", "id", tasks=4)
    assert sorted(map(tuple, table.collect()), key=str) == sorted(rows, key=str)
    sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * len(rows) / 4
    some = table.where("kind = 3").select("name")
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(kind,3)" in plan.split("PushedFilters")[1].splitlines()[0] and "ReadSchema: struct<name:string>" in plan
    assert some.count() == sum(r[2] == 3 for r in rows)
    empty = spark.createDataFrame([], "id long, name string")
    empty.write.format("jdbc").options(**source, dbtable="none_at_all").save()
    assert S.read_table(spark, source, "none_at_all", "id").count() == 0


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,4,10240]"])
def test_executors_elsewhere_need_the_url_of_a_database(master):
    """Nothing is connected to: only the options are asked for."""
    session = lambda master, url=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: url or default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.minuteworks.jdbc.url"):
        jdbc_source(session(master))
    assert jdbc_source(session(master, "jdbc:postgresql://host/db")) == {"url": "jdbc:postgresql://host/db"}
    assert all("memory" in jdbc_source(session(m))["url"] for m in ("local", "local[*]", "local[4,2]"))


def test_parts_attempts_assets(spark, tmp_path):
    put(tmp_path / "r1.parts/chunk-9999.txt", "early\nline")
    put(tmp_path / "r1.parts/chunk-10000.txt", "late")
    put(tmp_path / "r1.parts/notes.txt", "no")
    got = S.read_parts(spark, str(tmp_path)).orderBy("chunk_index").collect()
    assert [(r.recording_id, r.chunk_index, r.text) for r in got] == [("r1", 9999, "early\nline"), ("r1", 10000, "late")]
    put(tmp_path / "x/r1.asr/chunk-0001-attempt-a.json", {"runId": "q", "createdAt": "t", "chunkIndex": 1, "response": {"text": "hi", "words": [{"id": 1, "start": 0, "end": 1, "text": "hi"}]}})
    put(tmp_path / "x/r1.asr/chunk-0002-attempt-a.json", "nope")
    (row,) = S.read_asr_attempts(spark, str(tmp_path / "x")).collect()
    assert (row.recording_id, row.chunk_index, row.segments, row.words[0].text) == ("r1", 1, [], "hi")
    put(tmp_path / "y/r2.assets.json", {"assets": [{"path": "a.png", "elapsed_ms": 5}, {"path": "gone.png", "elapsed_ms": 1}]})
    present = spark.createDataFrame([("a.png",)], "path string")
    assert [tuple(r) for r in S.read_assets(spark, str(tmp_path / "y"), present).collect()] == [("r2", "a.png", 5)]


def test_quality_glossary_logs(spark, tmp_path):
    put(tmp_path / "q/r.quality.json", {"windows": [{"chunkIndex": 0, "micBytes": 5}], "warnings": ["w"], "sourceArtifacts": [{"kind": "mic", "bytes": 3}]})
    reports, windows, artifacts = S.read_quality(spark, str(tmp_path / "q"))
    assert windows.first().system_rms_dbfs == -120.0 and reports.first().requires_review is False and artifacts.first().kind == "mic"
    put(tmp_path / "g/r.glossary.json", {"schemaVersion": 1, "terms": ["a", "b"]})
    put(tmp_path / "g/s.glossary.json", {"schemaVersion": 2, "terms": ["c"]})
    assert sorted(tuple(r) for r in S.read_glossaries(spark, str(tmp_path / "g")).collect()) == [("r", 0, "a"), ("r", 1, "b")]
    lines = [{"timestamp": "2024-01-01T00:00:00Z", "level": "INFO", "fields": {"message": "m", "request_id": "1"}}, {"timestamp": "2024-01-01T00:00:01Z", "level": "WARN", "message": "n", "requestId": "2", "duration_ms": "7"}]
    put(tmp_path / "l/day.log", "\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = sorted((r.message, r.request_id, r.duration_ms) for r in S.read_logs(spark, str(tmp_path / "l")).collect())
    assert got == [("m", "1", None), ("n", "2", 7.0)]
    streamed = K.drained(spark, S.stream_logs(spark, str(tmp_path / "l")))
    assert streamed.count() == 2


def test_chunks_tables_sinks(spark, tmp_path):
    (tmp_path / "r.raw").mkdir()
    (tmp_path / "r.raw" / "mic_0003.raw").write_bytes(b"\x00\x7f" * 4)
    (tmp_path / "r.raw" / "other.raw").write_bytes(b"1")
    got = S.read_chunks(spark, str(tmp_path)).collect()
    assert [(r.recording_id, r.track, r.chunk_index, r.bytes) for r in got] == [("r", "microphone", 3, 8)]
    df = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    out = str(tmp_path / "out")
    S.write_reports(df, out)
    S.write_reports(spark.createDataFrame([("d2", 3)], "day string, n int"), out)
    assert sorted(r.n for r in spark.read.json(out).collect()) == [1, 3]
    assert S.read_table(spark, "/root/testdata/sf0.001", "nation").count() == 25


def test_live_transcripts_two_batches(spark, tmp_path):
    schema = "recording_id string, chunk_index int, n_expected int, failed boolean, text string, ts timestamp"
    stamp = lambda s: F.timestamp_seconds(F.lit(1_704_067_200 + s))
    source = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, "recording_id string, chunk_index int, n_expected int, failed boolean, text string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_704_067_200)).drop("s").coalesce(1).write.mode("append").parquet(source)

    add([("a", 1, None, False, "four five six seven eight", 10), ("b", 0, 1, True, "x", 10), ("c", 0, 2, False, "open", 10)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: K.live_transcripts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    add([("a", 0, 2, False, "one two three four five six seven", 20), ("z", 0, 1, False, "clock", 4000)])
    run()
    add([("y", 0, 1, False, "clock", 9000)])
    run()
    got = {r.recording_id: (r.status, r.transcript) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a"] == ("complete", "one two three four five six seven eight") and got["b"] == ("failed", None) and got["c"][0] == "open"


def test_claims(spark, tmp_path):
    rows = [(1, "claim", "r1"), (2, "claim", "r2"), (3, "release", "r2"), (4, "claim", " "), (5, "release", "r1"), (6, "claim", "r2")]
    spark.createDataFrame([("p", s, a, r, s) for s, a, r in rows], "path string, seq long, action string, run_id string, t int").withColumn("ts", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, seq long, action string, run_id string, t int, ts timestamp").parquet(str(tmp_path / "in"))
    got = K.drained(spark, K.claims(stream)).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["accepted", "rejected", "ignored", "invalid", "released", "accepted"]


def test_trace_stream(spark, tmp_path):
    rows = [("1", "c", "ipc.command.received", 0), ("1", "c", "ipc.command.failed", 5), ("2", "c", "ipc.command.received", 0), ("-", "c", "ipc.command.received", 0), ("9", "c", "ipc.command.received", 9000)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "request_id string, command string, message string, t int").withColumn("logged_at", F.timestamp_seconds(F.col("t") + 1_704_067_200)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("request_id string, command string, message string, t int, logged_at timestamp").parquet(source)
    got = {r.request_id: r.outcome for r in K.drained(spark, K.command_traces_stream(stream)).collect()}
    assert got["1"] == "failed" and "-" not in got


def test_parse_response_rejects(spark):
    df = spark.createDataFrame([("{bad",), ('{"text":"a","words":[{"start":"x"}]}',), ('{"text":"a","segments":null}',)], "json string")
    assert [r.error for r in S.parse_asr_response(df, "json").collect()] == ["text", "words", None]


@pytest.fixture(autouse=True)
def small_shuffles(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_files_of_one_small_table_are_work_for_all_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from minuteworks.sources import files as S

    rows = spark.range(40).coalesce(1).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"), F.lit("x").alias("content"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = S.write_files(rows, f"file://{tmp_path}")
    assert tasks > 1 and written.rdd.getNumPartitions() == tasks and written.count() == 40
    assert S.file_texts(rows, f"file://{tmp_path}").rdd.getNumPartitions() == tasks


def test_sidecars_are_listed_and_read_in_tasks(spark, tmp_path):
    """The driver holds no list of files; what is read of them is the same as by Spark's own reader."""
    good = {"schemaVersion": 1, "jobId": "j", "generation": 3}
    for name in ("a", "d e/f", "x/y/z/g"):
        put(tmp_path / f"{name}.processing.json", good | {"jobId": name})
    for name, content in {
        "utf8-sig": json.dumps(good | {"jobId": "ü"}).encode("utf-8-sig"), "utf16": json.dumps(good | {"jobId": "ü16"}, ensure_ascii=False).encode("utf-16"), "lines": b'{"jobId":\n "l",\n "new": [1]}\n', "empty": b"", "null": b"null", "latin": b'{"jobId": "\xfc"}',
        "kind": b'{"jobId": "k", "generation": "three"}', "broken": b"{broken", ".hidden": json.dumps(good).encode(), "_hidden": json.dumps(good).encode(), "_a=b": json.dumps(good | {"jobId": "part"}).encode(),
    }.items():
        (tmp_path / f"{name}.processing.json").write_bytes(content)
    put(tmp_path / "_folder/a.processing.json", good)
    put(tmp_path / ".folder/a.processing.json", good)
    put(tmp_path / "a.processing.json.backup", good)
    own = S.read_manifests(spark, f"file://{tmp_path}")
    assert not any(f.endswith(".processing.json") for f in own.inputFiles())
    theirs = S.read_manifests(spark, f"file://{tmp_path}*")  # a pattern: Spark lists it
    assert any(f.endswith(".processing.json") for f in theirs.inputFiles()) and own.columns == theirs.columns
    rows = lambda df: sorted(map(str, df.drop("path").collect()))
    assert rows(own) == rows(theirs) and sorted(r.jobId for r in own.collect()) == ["a", "d e/f", "l", "part", "x/y/z/g", "ü", "ü16"]
    assert {r.path for r in own.collect() if r.generation and r.jobId.startswith("d")} == {f"file://{tmp_path}/d e/f.processing.json"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_manifests(spark, f"file://{tmp_path}/nothing").collect()


def test_a_large_folder_is_listed_in_batches(tmp_path, monkeypatch):
    """One name of a folder is held at a time, and a folder that is not there has none."""
    for k in range(30):
        put(tmp_path / f"f{k}", "x")
    (tmp_path / "folder").mkdir()
    monkeypatch.setattr(S.pafs, "FileSelector", lambda *_, **__: pytest.fail("listed as a whole"))
    fs = S.pafs.LocalFileSystem()
    assert sorted(S.entries(fs, str(tmp_path))) == sorted([(f"f{k}", False) for k in range(30)] + [("folder", True)])
    assert list(S.entries(fs, f"{tmp_path}/nothing")) == []
