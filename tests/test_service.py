"""Command line, HTTP service, stage driver, REST retry, outside stores, vector table, streams."""

import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from papyria import cli, service
from papyria.operators import repair
from papyria.plans import asking, stages
from papyria.sources import rest, tables
from papyria.streaming import ingest


class Fake:
    name = "vectors-1"

    def __init__(self, refused=False, fail=None):
        self.refused, self.fail, self.seen = refused, fail, []

    def ask(self, **asked):
        self.seen.append(asked)
        if self.fail:
            raise self.fail
        return {"question": asked["question"], "answer": "a [d, p.1]", "refused": self.refused, "model": asked["model"], "hits": [], "usage": {"input_tokens": 0, "output_tokens": 0, "estimated_cost_usd": 0.0}}


def post(body, asker=None):
    return service.respond("POST", "/ask", json.dumps(body).encode(), asker or Fake())


def test_health_asks_nothing():
    asker = Fake(fail=RuntimeError("down"))
    assert service.respond("GET", "/health", b"", asker) == (200, {"status": "ok", "index": "vectors-1"}) and not asker.seen
    assert service.respond("POST", "/health", b"", asker)[0] == 405 and service.respond("GET", "/ask", b"", asker)[0] == 405
    assert service.respond("GET", "/nowhere", b"", asker)[0] == 404


@pytest.mark.parametrize("body", [{}, {"question": ""}, {"question": "x" * 1001}, {"question": 5}, {"question": "q", "top_k": 0}, {"question": "q", "top_k": 21}, {"question": "q", "top_k": "3"}, {"question": "q", "top_k": True}, {"question": "q", "threshold": -0.1}, {"question": "q", "threshold": 1.1}, {"question": "q", "doc_kind": "poem"}, [], None])
def test_bad_requests_are_422_and_reach_nothing(body):
    asker = Fake()
    assert post(body, asker)[0] == 422 and not asker.seen
    assert service.respond("POST", "/ask", b"{", asker)[0] == 422


def test_answers_refusals_and_failures():
    asker = Fake()
    assert post({"question": "who?", "top_k": 7, "threshold": 0.5, "doc_kind": "memo", "more": 1}, asker)[0] == 200
    assert asker.seen == [{"question": "who?", "top_k": 7, "threshold": 0.5, "model": "offline", "doc_kind": "memo"}]
    post({"question": "x" * 1000}, asker)
    assert asker.seen[1]["top_k"] == 5 and asker.seen[1]["threshold"] == 0.3 and asker.seen[1]["doc_kind"] is None
    status, out = post({"question": "who?"}, Fake(refused=True))
    assert status == 200 and out["refused"]
    status, out = post({"question": "who?"}, Fake(fail=RuntimeError("no host")))
    assert status == 502 and "no host" in out["detail"]
    for kind in ("newspaper", "court-opinion", "loose", "form", "deletion-sheet", "teletype", "legal", "cover", "memo"):
        assert post({"question": "q", "doc_kind": kind})[0] == 200


def test_server_over_a_socket():
    s = service.server(Fake(), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    assert json.load(urllib.request.urlopen(f"{base}/health"))["status"] == "ok"
    r = urllib.request.Request(f"{base}/ask", json.dumps({"question": "who?"}).encode(), method="POST")
    assert json.load(urllib.request.urlopen(r))["answer"] == "a [d, p.1]"
    s.shutdown()


PAGES = [
    ("bank", 1, "The robber fled north in a stolen green truck after the bank alarm rang. Witnesses saw him turn at the mill.", 91.0),
    ("bank", 2, "Agents found the green truck abandoned near the mill. Its plates had been removed by someone.", 88.0),
    ("bank", 3, "~~ ** ((", 20.0),
    ("court", 1, "The jury convicted the defendant of fraud after nine days. The judge set the sentence for June.", 75.0),
]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("collection"))
    d = spark.createDataFrame(PAGES, "source_stem string, page_no int, raw_text string, ocr_confidence double")
    tables.write_pages(d, f"{path}/pages")
    return path


def test_stages_pause_resume_and_dry_run(spark, root):
    said = []
    assert stages.run_stages(spark, root, dry_run=True, threshold=60, say=said.append).done == stages.STAGES and len(said) == 5
    assert not tables.path_exists(spark, f"{root}/score")
    run = stages.run_stages(spark, root, say=said.append)
    assert run.paused and run.done == ["score"] and sum(r["pages"] for r in run.report.collect()) == 4
    with pytest.raises(FileNotFoundError):
        stages.run_stages(spark, root, start="clean", threshold=60, say=said.append)
    with pytest.raises(ValueError):
        stages.steps_from("polish")
    assert stages.run_stages(spark, root, threshold=60, say=said.append).done == stages.STAGES
    assert stages.run_stages(spark, root, start="chunk", say=said.append).report.first()["records"] == 3  # again: the same ids


def test_ask_search_and_eval(spark, root, tmp_path, capsys):
    stages.run_stages(spark, root, threshold=60, say=lambda _: None)
    run = lambda *argv: cli.main(list(argv), session=lambda: spark)
    assert run("ask", root, "green truck near the mill", "--json", "--threshold", "0.1") == 0
    out = json.loads(capsys.readouterr().out)
    assert not out["refused"] and out["hits"][0]["doc_id"].startswith("bank") and "text" not in out["hits"][0]
    assert run("ask", root, "zebra quantum", "--json") == 0 and json.loads(capsys.readouterr().out)["refused"]
    assert run("search", root, "jury fraud", "--json", "--top-k", "1") == 0
    assert json.loads(capsys.readouterr().out)["doc_id"].startswith("court")
    asked = asking.Asker(spark, asking.vectors_of(tables.VectorTable(spark, f"{root}/embed").read("chunks")))
    with pytest.raises(ValueError):
        asked.ask("")
    assert asked.ask("truck", doc_kind="memo")["refused"]
    entries = [("1", "zebra quantum", "c", "refuse", [], ""), ("2", "jury convicted the defendant of fraud", "c", "answer", ["court__doc-001"], "")]
    spark.createDataFrame(entries, tables.EVAL_ENTRY).write.json(f"{tmp_path}/set")
    assert run("eval", root, f"{tmp_path}/set", "--only", "1") == 0
    spark.createDataFrame([("3", "zebra quantum", "c", "answer", [], "")], tables.EVAL_ENTRY).write.mode("append").json(f"{tmp_path}/set")
    assert run("eval", root, f"{tmp_path}/set") == 1
    broken = Fake(fail=RuntimeError("down"))
    scored, total = cli.evaluate_set(spark, broken, tables.read_eval_set(spark, f"{tmp_path}/set"))
    assert total["passed"] == 0 and total["total"] == 3 and {r["error"] for r in scored.collect()} == {"no answer"}


def test_rest_waits_and_retries():
    slept = []

    def fetch_of(*answers):
        left = list(answers)

        def fetch(url, token):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return fetch

    ok = (200, {}, b'{"id": 1}')
    get = lambda *a: rest.get_json("u", None, fetch_of(*a), slept.append)
    assert get(ok) == {"id": 1} and slept == []
    assert get((429, {"Retry-After": "7"}, b""), (429, {}, b""), ok) == {"id": 1} and slept == [8.0, 61.0]
    slept.clear()
    assert get((500, {}, b""), OSError("reset"), ok) == {"id": 1} and slept == [2, 4]
    slept.clear()
    with pytest.raises(rest.RequestFailed):
        get((404, {}, b""))
    with pytest.raises(rest.RequestFailed):
        get(*[(503, {}, b"")] * 4)
    assert slept == [2, 4, 8]
    with pytest.raises(rest.RequestFailed):
        get(*[(429, {}, b"")] * 9)


def test_batches_for_an_outside_store(spark):
    slept, sent = [], []

    def flaky(records):
        sent.append(len(records))
        if len(sent) < 3:
            raise OSError("reset")

    assert tables.send_batch([{}], flaky, slept.append) == 3 and slept == [2, 4]
    with pytest.raises(tables.Rejected):
        tables.send_batch([{}], lambda r: (_ for _ in ()).throw(tables.Rejected("bad")), slept.append)
    slept.clear()
    with pytest.raises(OSError):
        tables.send_batch([{}], lambda r: (_ for _ in ()).throw(OSError("down")), slept.append)
    assert slept == [2, 4, 8]
    out = tables.upsert_remote(spark.range(0, 1000, 1, 3), lambda r: None).collect()
    assert sum(r["batches"] for r in out) == sum(r["attempts"] for r in out) == 12
    polls = iter([False, False, True])
    assert tables.wait_ready(lambda: next(polls), sleep=slept.append) == 2
    with pytest.raises(TimeoutError):
        tables.wait_ready(lambda: False, 3, slept.append)


def test_vector_table_versions(spark, tmp_path):
    t = tables.VectorTable(spark, str(tmp_path / "v"))
    assert t.read() is None and t.version() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "_id string, x int")
    assert t.upsert(rows, "one") == 1 and t.upsert(rows.withColumn("x", F.lit(2)).where("_id = 'a'"), "one") == 2 and t.upsert(rows, "two") == 3
    assert {(r["_id"], r["x"], r["namespace"]) for r in t.read().collect()} == {("a", 2, "one"), ("b", 1, "one"), ("a", 1, "two"), ("b", 1, "two")}
    assert t.verify("one", 2) == 2
    with pytest.raises(RuntimeError):
        t.verify("one", 3)
    t.create(recreate=True)
    assert t.read() is None


def test_reports_leave_nothing_out(spark):
    assert tables.markdown_table(spark.range(2), "t").count("\n") == 6
    with pytest.raises(ValueError):
        tables.markdown_table(spark.range(5), "t", most=4)
    assert "id" in tables.preview(spark.range(9)) and tables.preview(spark.range(9)).count("{") == 3
    assert [r["v"] for r in tables.by_count(spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string"), "v").collect()] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        tables.read_chunks(spark, _empty(spark))


def _empty(spark):
    path = tables.shared_folder(spark, "empty")
    spark.createDataFrame([], tables.CHUNK).write.json(path)
    return path


def test_grouping_stream_over_two_batches(spark, tmp_path):
    cols = "page_no int, raw_text string, template string, bucket string"
    for i, rows in enumerate([[(1, "FD-36 (Rev. 1-1-75)\nnote 88-6895", "FD-36", "clean"), (2, "PAGE TWO DN 88-6895 CLEAR", "FD-36-cont", "clean")], [(3, "PAGE THREE DN 88-6895", "FD-36-cont", "clean"), (4, "A new form.", "FD-xxx", "clean")]]):
        spark.createDataFrame(rows, cols).coalesce(1).write.json(f"{tmp_path}/in/s/{i}")
    d = spark.readStream.schema(tables.PAGE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/s").withColumn("source_stem", F.lit("s"))
    q = ingest.group_stream(d).writeStream.format("memory").queryName("grouped_stream").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["page_no"], r["doc_id"], r["doc_page_index"]) for r in spark.table("grouped_stream").collect())
    assert got == [(1, "s__doc-001", 1), (2, "s__doc-001", 2), (3, "s__doc-001", 3), (4, "s__doc-002", 1)]


def test_repairs_take_repeated_names_and_all_placeholders(spark):
    docs = spark.createDataFrame([("s", "d1", "loose", [1, 2], 2, "FD-36", ["1"]), ("s", "d2", "form", [3], 1, None, ["2"])], "source_stem string, doc_id string, kind string, page_nos array<int>, page_count int, first_template string, case_nums array<string>")
    pages = spark.createDataFrame([("s", i, "d1" if i < 3 else "d2", "loose", 1, 1) for i in (1, 2, 3)], "source_stem string, page_no int, doc_id string, doc_kind string, doc_page_index int, doc_page_count int")
    d, p, unknown = repair.reclassify(docs, pages, spark.createDataFrame([("d1", "memo"), ("d1", "memo"), ("x", "memo")], "doc_id string, new_kind string"))
    assert d.count() == 2 and p.count() == 3 and [r["doc_id"] for r in unknown.collect()] == ["x"]
    spec = spark.createDataFrame([("d1", ["d1", "d2"], [3, 9], "teletype", "FD-36", "joined")], repair.SPEC)
    merged, _ = repair.merge_documents(docs, pages, spec)
    assert [(r["page_nos"], r["withheld_page_nos"], r["case_nums"]) for r in merged.collect()] == [([1, 2, 3], [3, 9], ["1", "2"])]
