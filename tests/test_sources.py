"""Readers, writers, the HTTP source and streams."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from dimstar.sources import readers, schemas, writers
from dimstar.functions import rules
from dimstar.sources import http
from dimstar.sources.http import HttpCsv
from dimstar.streaming import sweep


def test_checkpoint_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "TIC 5", 0.9, float("nan"), "x"), (2, "TIC 6", None, 1.5, "y")], "sector int, target string, score double, bls_period double, other string")
    writers.append_results(rows, f"{tmp_path}/r")
    writers.append_results(rows.filter("sector = 1"), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 3
    assert readers.finished_targets(spark, f"{tmp_path}/r").count() == 2
    assert readers.finished_targets(spark, f"{tmp_path}/none").count() == 0
    writers.write_csv(writers.conformed(rows, schemas.CHECKPOINT), f"{tmp_path}/csv")
    back = {r["target"]: r for r in readers.read_checkpoint(spark, f"{tmp_path}/csv").collect()}
    assert back["TIC 5"]["bls_period"] is None and back["TIC 6"]["bls_period"] == 1.5 and back["TIC 6"]["score"] is None


def test_candidates_need_their_columns(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([("TIC 1", 1)], "target string, sector int"), f"{tmp_path}/c")
    with pytest.raises(ValueError, match="bls_period"):
        readers.read_candidates(spark, f"{tmp_path}/c")
    full = spark.createDataFrame([("TIC 1", 1, 0.9, 2.0, 0.1, 0.2), ("TIC 2", 1, 0.95, 2.0, 0.1, 0.2)], "target string, sector int, score double, bls_period double, bls_t0 double, bls_duration double")
    writers.write_csv(full, f"{tmp_path}/d")
    assert [r["tic_id"] for r in readers.read_candidates(spark, f"{tmp_path}/d", 1).collect()] == [2]


def test_settings_are_written_when_absent(spark, tmp_path):
    path = f"{tmp_path}/settings"
    assert readers.read_settings(spark, path).first()["candidate_threshold"] == 0.86
    assert readers.exists(spark, path)
    writers.write_json(spark.createDataFrame([(0.5,)], "candidate_threshold double"), path)
    row = readers.read_settings(spark, path).first()
    assert row["candidate_threshold"] == 0.5 and row["window_len"] == 301


def test_catalog(spark):
    rows = spark.createDataFrame([("b", 1, 2.0, "TESS"), ("c", None, 2.0, "TESS"), ("d", 3, float("nan"), "TESS"), ("e", 4, 13.8, "TESS"), ("f", 5, 1.0, "tess x"), ("g", 6, 1.0, "Kepler")], "pl_name string, tic_id bigint, pl_orbper double, disc_facility string")
    assert [r["tic_id"] for r in readers.usable_planets(rows, facility="TESS").collect()] == [5, 1]
    text = spark.createDataFrame([("TIC 1234567",), ("x",)], "id string")
    assert {r["id"] for r in readers.numbers_or_digits(text, "id").collect()} == {1234567, None}
    assert {r["id"] for r in readers.numbers_or_digits(text.unionByName(text.select(F.lit("7").alias("id"))), "id").collect()} == {7, None}


def test_fallback_ladder(spark):
    spark.createDataFrame([(1, 2.0)], "tic_id int, period double").createOrReplaceTempView("planets_b")
    found = readers.first_readable(spark, ["planets_a", "planets_b"], [["tic_id", "pl_orbper"], ["tic_id", "period"]], ["default_flag = 1", "true"])
    assert found.columns == ["tic_id", "period"]


def test_products_and_pool(spark):
    p = spark.createDataFrame([("a", 1, "QLP", 20), ("a", 1, "SPOC", 20), ("a", 1, "SPOC", 120), ("b", 1, "QLP", 600)], "target string, sector int, author string, exptime int")
    assert {(r["target"], r["author"], r["exptime"]) for r in readers.preferred_products(p).collect()} == {("a", "SPOC", 120), ("b", "QLP", 600)}
    pool = readers.patch_pool([p, p.select(F.lit("z").alias("target"))], 2, 10)
    assert pool.count() == 2 and pool.collect() == readers.patch_pool([p, p.select(F.lit("z").alias("target"))], 2, 10).collect()


def test_http_source_retries(spark):
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            bad = asked.count(self.path) == 1
            self.send_response(503 if bad else 200)
            self.end_headers()
            self.wfile.write(b"" if bad else f"tidstr,tfopwg_disp,more\n{self.path[1:]},CP,x\nnan,CP,\n".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        spark.dataSource.register(HttpCsv)
        df = spark.read.format("http_csv").schema(schemas.OBJECTS).option("urls", f"{base}/11 {base}/22").option("backoff", "0.01").load()
        assert sorted(r["tidstr"] for r in readers.confirmed_objects(df).collect()) == ["11", "22"]
    finally:
        server.shutdown()


def test_sweep_resumes(spark, tmp_path):
    def put(name, keys):
        spark.createDataFrame([(k, f"v{k}") for k in keys], "k int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = sweep.events_stream(spark, f"{tmp_path}/in/*", "k int, v string")
        return sweep.sweep(stream, lambda b: b.withColumn("w", F.upper("v")), f"{tmp_path}/out", f"{tmp_path}/state", ["k"])

    put("a", [1, 2])
    assert run()
    put("b", [2, 3])
    assert run()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {1: 1, 2: 1, 3: 1}


def test_failure_alarm(spark, tmp_path):
    def put(name, flags, start):
        spark.createDataFrame([("s", start + i, f) for i, f in enumerate(flags)], "source string, seq int, failed boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    put("a", [False, True, True], 0)
    stream = spark.readStream.schema("source string, seq int, failed boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = sweep.failure_alarm(stream, limit=4).writeStream.format("memory").queryName("alarms").outputMode("update").option("checkpointLocation", f"{tmp_path}/s").start()
    query.processAllAvailable()
    put("b", [True, True, False], 3)
    query.processAllAvailable()
    query.stop()
    got = [(r["streak"], r["alarm"]) for r in spark.sql("SELECT * FROM alarms").collect()]
    assert got == [(2, False), (0, True)]


def serving(answer):
    """A server that calls answer(path) for each request, and the paths it was asked for."""
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer(self.path).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}", asked


def test_http_fields_and_filters(spark):
    rows = "id,period,name,ok,day,more\n1,2.5,a,true,2024-01-02,x\n2,bad,,F,,y\n3.0,7,c,maybe,nonsense,z\n9999999999,nan,d,1,2024-02-30,\n"
    server, base, asked = serving(lambda path: rows)
    spark.dataSource.register(HttpCsv)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("http_csv").options(urls=f"{base}/q?table=toi", columns="select", where="where")
        found = read.schema("id int, period double, name string, ok boolean, day date").load()
        got = {r.id: (r.period, r.name, r.ok, str(r.day)) for r in found.filter("id is not null").collect()}
        assert got == {1: (2.5, "a", True, "2024-01-02"), 2: (None, None, False, "None"), 3: (7.0, "c", None, "None")}
        assert asked[-1] == "/q?table=toi&select=id%2Cperiod%2Cname%2Cok%2Cday"
        assert [r.id for r in found.filter("period >= 3.5 and name = 'c' and id in (1, 3)").collect()] == [3]
        assert "where=period+%3E%3D+3.5+and+name+%3D+%27c%27" in asked[-1] or "where=name+%3D+%27c%27+and+period+%3E%3D+3.5" in asked[-1]
        with pytest.raises(Exception, match="no text becomes"):
            read.schema("id int, parts array<int>").load().collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
        server.shutdown()


def test_no_more_patches_than_needed(spark, tmp_path):
    server, base, asked = serving(lambda path: "target_name\n" + "".join(f"TIC {k}\n" for k in range(10 * int(path[1:]), 10 * int(path[1:]) + 15)))
    spark.dataSource.register(HttpCsv)
    key = lambda rows: rows.select(rules.target_number(F.col("target_name")).alias("target"))
    try:
        options = (key, f"{tmp_path}/patches", "target_name string")
        urls = [f"{base}/{k}" for k in range(6)]
        first = http.patches_until(spark, urls, 20, *options)
        assert first.count() == 25 and sorted(set(asked)) == ["/0", "/1"]
        again = http.patches_until(spark, urls, 40, *options)
        assert sorted(set(asked)) == ["/0", "/1", "/2", "/3"] and again.count() == 45 and len(asked) == 4
        assert {r.patch: r["count"] for r in again.groupBy("patch").count().collect()} == {0: 15, 1: 10, 2: 10, 3: 10}
    finally:
        server.shutdown()
