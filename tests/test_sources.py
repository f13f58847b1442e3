"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from orrery.operators import events as ev
from orrery.sources import files, sinks
from orrery.streaming import streams

SOURCE = '''import os
from a.b import c

def outer(x, y):
    def inner(z):
        return z
    for i in x:
        if i:
            while y:
                y = inner(y)
    open("f")
    with open("g") as g:
        return g

def wide(a, b, c, d, e, f):
    return a
'''


def test_python_items(spark):
    frame = spark.createDataFrame([("p.py", SOURCE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    rows = files.python_items(frame).collect()
    got = {r["item"]: r for r in rows if r["item"]}
    assert list(got) == ["inner", "outer", "wide"]
    assert (got["outer"].n_args, got["outer"].max_depth, got["outer"].n_lines) == (2, 3, 10)
    assert got["outer"].kappa > got["inner"].kappa > 3
    assert got["outer"].cyclomatic == 5
    assert got["outer"].notes == ["9:CRITICAL:LILITH", "11:WARNING:SUTURE", "15:WARNING:SOUVERAINETE"] or set(got["outer"].notes) == {"9:CRITICAL:LILITH", "11:WARNING:SUTURE", "15:WARNING:SOUVERAINETE"}
    assert [r.failed for r in rows if r.path == "bad.py"] == ["SyntaxError"]
    assert {(r.path, r.module) for r in files.imports(frame).collect()} == {("p.py", "os"), ("p.py", "a.b")}


def test_listing(spark, tmp_path):
    for name in ("a/x.py", "a/x.egg-info/y.py", ".git/z.py", "b/readme.weird"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = files.with_language(files.listing(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: r.language for r in found.collect()} == {"x.py": "python", "readme.weird": None}
    assert files.listing(spark, str(tmp_path), excluded=[]).count() == 3  # the file source passes over folders that begin with a dot
    assert files.unsupported(found.drop("language")).count() == 1


def test_event_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = spark.createDataFrame([("2024-01-01", "a", "view", "m" * 501, [str(k) for k in range(13)])], "t string, agent string, type string, msg string, tags array<string>")
    ev.append_log(frame, path, vocabulary=["view"])
    ev.append_log(frame.withColumn("agent", F.lit("b")), path)
    with open(next((tmp_path / "log").glob("part-*")), "a") as f:
        f.write("{corrupt\n" + json.dumps({"t": "x", "agent": "c", "type": "odd"}) + "\n")
    for crc in (tmp_path / "log").glob(".*.crc"):
        crc.unlink()
    rows = files.event_log(spark, path, "t string, agent string, type string, msg string, tags array<string>", vocabulary=["view"]).collect()
    assert sorted(r.agent for r in rows) == ["a", "b"] and len(rows[0].msg) == 500 and len(rows[0].tags) == 12


def test_change_log(spark):
    text = "abcdef1|2024-01-01T10:00:00+00:00|first|part\n3\t1\tf.py\n-\t-\timage.png\nabcdef2|2024-01-02T10:00:00+00:00|second\n0\t4\tg.py"
    got = files.change_log(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.commit, r.subject, r.file, r.added, r.removed) for r in got] == [("abcdef1", "first|part", "f.py", 3, 1), ("abcdef2", "second", "g.py", 0, 4)]


def test_markdown_rows(spark):
    text = "# One\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\ntext\n## Two\n| c |"
    got = files.markdown_rows(spark.createDataFrame([(1, text)], "doc int, text string"), "text", ["doc"]).collect()
    assert [(r.section, r.cells, r.malformed) for r in got] == [("One", ["a", "b"], False), ("One", ["1", "2"], False), ("One", ["3"], True), ("Two", ["c"], False)]


def test_sinks(spark, tmp_path):
    notes = spark.createDataFrame([("f", 3, "CRITICAL", "R1", "m"), ("f", 1, "INFO", "R2", "n")], "path string, line int, level string, rule string, message string")
    doc = json.loads(sinks.sarif(notes).first().sarif)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["level"] for r in run["results"]] == ["note", "error"] and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["R1", "R2"]
    assert sinks.markdown(notes.select("path", "line")).splitlines()[0] == "| path | line |"
    a = notes.repartition(3)
    assert sinks.fingerprint(a, []) == sinks.fingerprint(notes, []) != sinks.fingerprint(notes.limit(1), [])
    sinks.write_snapshot(notes, notes.select("path"), str(tmp_path / "s"), "1")
    symbols, _, meta = sinks.read_snapshot(spark, str(tmp_path / "s"))
    assert symbols.count() == 2 and meta["version"] == "1"
    kept, archived = sinks.rotated(notes, ["path"], "line", 1)
    assert (kept.first().line, archived.first().line) == (3, 1)
    assert [r.kappa for r in files.kappas(spark, "10, 10,1000").collect()] == [10.0, 10.0, 1000.0]


def test_late_events_are_dropped(spark, tmp_path):
    path, check = str(tmp_path / "in"), str(tmp_path / "check")
    for k, (a, t) in enumerate([("x", "2024-01-01 00:10:00"), ("x", "2024-01-03 00:00:00"), ("x", "2024-01-01 00:20:00"), ("x", "2024-01-05 00:00:00")]):
        spark.createDataFrame([(a, t)], "k string, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
        rows = streams.stream(spark, path, "k string, ts timestamp")
        query = streams.tumbling(rows, ["k"], width="1 hour", late="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((str(r.start), r.n) for r in got) == [("2024-01-01 00:00:00", 1), ("2024-01-03 00:00:00", 1)]


def test_audit(spark):
    from orrery.plans import audit

    frame = spark.createDataFrame([("p.py", SOURCE), ("q.py", "# only a comment\n"), ("r.py", "def wide():\n    return 1\n")], "path string, text string")
    rows = {r.path: r for r in audit.audit(frame).collect()}
    assert (rows["p.py"].n, rows["p.py"].n_imports, rows["p.py"].n_anomalies, rows["p.py"].largest_item.item) == (3, 2, 3, "outer")
    assert (rows["q.py"].radiance, rows["q.py"].kurt, rows["q.py"].comment_ratio) == (60.0, 3.0, 1.0)
    assert {r.path for r in audit.check(audit.audit(frame), gate="nb_anomalies == 0 and nb_fonctions > 0").collect()} == {"p.py", "q.py"}
    assert {r.path for r in audit.check(audit.audit(frame), gate="1/(nb_fonctions) > 0").collect()} == {"q.py"}
    assert {r.path: r.value for r in audit.evaluated(audit.audit(frame), "nb_fonctions * 2").collect()}["p.py"] == 6
    assert audit.overview(audit.audit(frame)).first().n_sources == 3
    assert [r.item for r in audit.same_names(frame).collect()] == ["wide"]
