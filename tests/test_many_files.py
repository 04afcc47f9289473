"""Sinks whose number of files must not grow with the rows."""

import json
import os

from pyspark.sql import functions as F

from papyria.sources import tables as io


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if not f.startswith(("_", "."))]


def test_page_texts_come_back_whole_from_few_files(spark, tmp_path):
    texts = ["plain", "two\nlines\n", "\r\n\x00zero\x01b\x01a\x01\x00", "\n", "é\x00" * 3]
    rows = [(s, i + 1, texts[i % len(texts)]) for s in ("a b", "007") for i in range(1200)] + [("a b", 1201, ""), ("a b", 1202, None)]
    io.write_page_texts(spark.createDataFrame(rows, "source_stem string, page_no int, t string").repartition(3), str(tmp_path / "o"), "t")
    got = io.read_page_texts(spark, str(tmp_path / "o")).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted((s, f"{n:03d}", t) for s, n, t in rows if t)
    assert len(files(tmp_path / "o")) <= 6  # one for each page before


def test_opinion_lines_say_what_opinion_files_say(spark, tmp_path):
    objects = {f"s-{i}": {"opinion": {"id": i, "plain_text": "" if i % 2 else "plain\nNo. 1-2.", "html": f"<p>\u2028{i}</p>" if i % 2 else None}, "cluster": {"citations": [{"volume": "1", "reporter": "F.2d", "page": str(i) if i % 3 else None}]}} for i in range(40)}
    os.makedirs(tmp_path / "each")
    for slug, o in objects.items():
        (tmp_path / "each" / f"{slug}.json").write_text(json.dumps(o, indent=2), encoding="utf-8")
    want = sorted(map(str, io.read_opinions(spark, str(tmp_path / "each")).collect()))
    o = spark.createDataFrame([(k, json.dumps(v)) for k, v in objects.items()], "slug string, j string").repartition(2)
    io.write_opinions(o.select("slug", F.from_json("j", io.OPINION).alias("x")).select("slug", "x.*"), str(tmp_path / "lines"))
    assert sorted(map(str, io.read_opinion_lines(spark, str(tmp_path / "lines")).collect())) == want
    assert len(files(tmp_path / "lines")) <= 2  # one for each opinion before
