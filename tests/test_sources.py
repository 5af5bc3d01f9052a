import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from ebbline.session import detect_environment, object_store_conf, session_conf
from ebbline.sources import ApiExtractor, RateLimiter, RestPages, fetch_with_retry, generate_events, read_table, validate_records, write_features, write_optimized, write_staging
from ebbline.sources.files import file_count, messages, wait_for_path
from ebbline.sources.rest import Response, retry_with_backoff


def test_validate_records():
    good, dead = validate_records({"data": [{"event_id": 1, "event_type": "x"}, {"event_id": 2}, 7]})
    assert len(good) == 1 and [d["_rejection_reason"] for d in dead] == ["missing: event_type", "missing: event_id, event_type"]
    assert validate_records({"results": [{"event_id": 1, "event_type": "x"}]})[0] and validate_records({"data": []}) == ([], []) and validate_records(None) == ([], [])


def test_retry_policy():
    waits, answers = [], iter([Response(500), Response(429, None, {"Retry-After": "7"}), Response(200, {})])
    assert fetch_with_retry(lambda: next(answers), sleep=waits.append).status == 200 and waits == [1.5, 7.0]
    assert fetch_with_retry(lambda: Response(404), sleep=waits.append) is None

    def broken():
        raise OSError

    waits.clear()
    assert fetch_with_retry(broken, sleep=waits.append) is None and waits == [1.5, 2.5, 4.5]
    calls = []

    def third():
        calls.append(1)
        return Response(500 if len(calls) < 3 else 200)

    assert retry_with_backoff(third, 3, sleep=lambda _: None).status == 200 and len(calls) == 3
    with pytest.raises(RuntimeError):
        retry_with_backoff(lambda: Response(500), 1, sleep=lambda _: None)


def test_rate_limiter():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = RateLimiter(10, lambda: now[0], sleep)
    for _ in range(3):
        limiter.wait()
    assert slept == pytest.approx([0.1, 0.1])


def test_extractor_stops():
    pages = {1: {"data": [{"i": 1}, {"i": 2}], "pagination": {"has_more": True}}, 2: {"data": [{"i": 3}], "meta": {"has_more": False}}}
    x = ApiExtractor("u", 2, rate=0, get=lambda url, p: Response(200, pages[p["page"]]))
    assert [r["i"] for r in x.extract("2024-01-01")] == [1, 2, 3] and x.metrics.pages == 2
    x = ApiExtractor("u", 2, max_pages=1, rate=0, get=lambda url, p: Response(200, {"data": [{}, {}]}))
    assert len(x.extract()) == 2
    x = ApiExtractor("u", rate=0, get=lambda url, p: Response(404))
    assert x.extract() == [] and x.metrics.failed_pages == 1


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        page = int(parse_qs(urlparse(self.path).query)["page"][0])
        body = json.dumps({"data": [{"n": page * 10 + i} for i in range(2)] if page <= 5 else [], "pagination": {"has_more": page < 5}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_rest_data_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RestPages)
    df = spark.read.format("rest_pages").options(url=f"http://127.0.0.1:{server.server_port}/", pages=6, pages_per_task=2, page_size=2, rate=0).load()
    rows = df.collect()
    server.shutdown()
    assert sorted(json.loads(r["record"])["n"] for r in rows) == [p * 10 + i for p in range(1, 6) for i in range(2)]


def test_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, d string")
    path = str(tmp_path / "a")
    assert write_staging(df, path, ["d"]) == 2 and write_staging(df.limit(0), path, ["d"]) == 0
    assert read_table(spark, path, "2024-01-02", "d").count() == 1
    assert write_optimized(df.where("id = 2").selectExpr("id + 10 as id", "d"), path, ["d"]) == 1
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 12]
    assert write_features(df, str(tmp_path / "f"), "2024-02-01") == 2
    assert file_count(10) == 1 and file_count(10**9) == 200
    key = messages(df, df["id"].cast("string")).first()
    assert key["key"] == "1" and json.loads(key["value"])["d"] == "2024-01-01"


def test_wait_for_path():
    tries = iter([False, False, True])
    assert wait_for_path(lambda _: next(tries), "p", 100, 1, lambda _: None)
    now = iter(range(0, 1000, 10))
    assert not wait_for_path(lambda _: False, "p", 15, 1, lambda _: None, lambda: next(now))


def test_generator_is_reproducible(spark):
    a, b = generate_events(spark, 500), generate_events(spark.newSession(), 500).repartition(5)
    assert a.exceptAll(b).isEmpty() and a.count() == 500 and a.where("event_type is null or device_type is null").isEmpty()


def test_session_settings():
    assert detect_environment({"PIPELINE_ENV": "Prod", "SPARK_ENV": "dev"}) == "prod" and detect_environment({}) == "local"
    assert detect_environment({"SPARK_ENV": "moon"}) == "local" and session_conf("prod")["spark.sql.broadcastTimeout"] == "600"
    assert session_conf("prod", {"spark.sql.shuffle.partitions": "9"})["spark.sql.shuffle.partitions"] == "9"
    assert object_store_conf("s3a", endpoint="e")["spark.hadoop.fs.s3a.endpoint"] == "e"
