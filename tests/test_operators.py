"""Small cases of the operators that have no SQL form, against plain Python where there is logic to repeat."""

import random

import pytest
from pyspark.sql import functions as F

from papyria.functions import text as t
from papyria.operators import answer, chunk, clean, evaluate, group, opinions, packing, search
from papyria.streaming import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


def test_sentence_bounds_on_known_counts():
    tok = [200, 200, 200, 50, 60, 450, 10]
    assert packing.sentence_bounds(tok, 500, 100) == [(0, 2), (1, 4), (2, 5), (3, 5), (4, 5), (5, 7)]
    assert packing.sentence_bounds([501], 500, 100) == [(0, 1)]
    assert packing.sentence_bounds([600, 1], 500, 100) == [(0, 1), (1, 2)]
    assert packing.sentence_bounds([], 500, 100) == []


def test_sentence_bounds_cover_everything():
    rng = random.Random(1)
    for _ in range(300):
        tok = [rng.randrange(0, 300) for _ in range(rng.randrange(1, 40))]
        b = packing.sentence_bounds(tok, 500, 100)
        assert b[0][0] == 0 and b[-1][1] == len(tok)
        assert all(i < j for i, j in b) and all(q[0] <= p[1] and q[0] > p[0] for p, q in zip(b, b[1:]))
        assert all(sum(tok[i:j]) <= 500 or j == i + 1 for i, j in b)


def test_block_bounds_follow_each_other():
    b = packing.block_bounds([390, 390, 390], [300, 300, 300], 500, 100)
    assert b == [(0, 1), (1, 2), (2, 3)]
    assert packing.block_bounds([100, 100], [80, 80], 500, 100) == [(0, 2)]
    assert packing.block_bounds([], [], 500, 100) == []


def test_sentences_respect_abbreviations(spark):
    assert one(spark, chunk.sentences, "Dr. Smith arrived at noon. He left later.") == ["Dr. Smith arrived at noon.", "He left later."]
    assert one(spark, chunk.sentences, "") == []


@pytest.mark.parametrize(("text", "n"), [("", 0), ("one", 1), ("a b c d e f g h i j", 13), ("   ", 1)])
def test_token_estimate(spark, text, n):
    assert one(spark, t.token_estimate, text) == n


@pytest.mark.parametrize(("text", "ids"), [("as in [doc-1, p.3]", ["doc-1"]), ("[a_b, pages 2] [c, p. 9]", ["a_b", "c"]), ("[no page]", []), ("plain", [])])
def test_citations(spark, text, ids):
    assert one(spark, t.cited_ids, text) == ids


@pytest.mark.parametrize(("refused", "text", "want"), [(True, "x", True), (False, "The excerpts do not contain that.", True), (False, "They do not contain that [doc-1, p.3].", False), (False, "It was found.", False), (None, None, False)])
def test_refusals(spark, refused, text, want):
    d = spark.createDataFrame([(refused, text)], "r boolean, a string")
    assert d.select(evaluate.is_refusal(F.col("r"), F.col("a")).alias("x")).first()["x"] is want


def test_redaction_labels_join_runs(spark):
    text = "seen @#b {x} by [REDACTED] a@@ then 88-6895 $ 5 (ok) end"
    out = spark.createDataFrame([(text,), ("",), ("plain words",), (None,)], "c string").select(clean.redaction_units(F.col("c")).alias("u")).select(clean.labelled_text(F.col("u")).alias("t"), clean.n_labels(F.col("u")).alias("n")).collect()
    assert (out[0]["t"], out[0]["n"]) == ("seen [REDACTED] by [REDACTED] then 88-6895 $ 5 [REDACTED] end", 2)
    assert (out[1]["t"], out[1]["n"]) == ("", 0)
    assert (out[2]["t"], out[2]["n"]) == ("plain words", 0)


@pytest.mark.parametrize(("line", "want"), [("", None), ("FBI", None), ("~x", "orphan"), ("ae meme ieee ree eee eee ee", "soup"), ("RR SU AT NK NY PH SF", "bureau-codes"), ("aa ee oo uu ii ab xy", "rule-artifact"), ("~~ 12 %% ** (( )) __ ##", "soup"), ("reward of $ 1,500.00", None), ("A plain line of text", None)])
def test_line_classes(spark, line, want):
    got = one(spark, clean.drop_class, line)
    assert got == want or (want == "soup" and got in ("soup", "rule-artifact"))


PAGES = "source_stem string, page_no int, raw_text string, template string, bucket string"


def pages_of(n, seed):
    rng = random.Random(seed)
    bits = ["PAGE TWO DN 88-6895 CLEAR", "continued from A-1", "FD-302 (Rev. 1-1-75)", "FD-36 (Rev. 1-1-75)", "88-6895 noted", "88-1095 noted", "lower start", "Ends here.", "and so on", "4-750 (Rev. 12-14-88)", "THE BEST COPY", ""]
    names = ["unknown", "FD-36", "FD-36-cont", "FD-350", "FD-xxx", "4-750", None]
    return [(f"s{i % 3}", i // 3 + 1, "\n".join(rng.choice(bits) for _ in range(rng.randrange(0, 5))), rng.choice(names), rng.choice(["clean"] * 9 + ["skipped"])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_grouping_equals_a_walk_over_each_source(spark, seed):
    rows = pages_of(240, seed)
    d = spark.createDataFrame(rows, PAGES)
    got = {(r["source_stem"], r["page_no"]): (r["doc_id"], r["doc_page_index"], r["doc_kind"]) for r in group.group_pages(d).collect()}
    assert len(got) == len(rows)
    live = [r.asDict() for r in group.with_signals(d).where(~F.col("empty")).collect()]
    want = {}
    for s in ("s0", "s1", "s2"):
        mine = sorted((r for r in live if r["source_stem"] == s), key=lambda r: r["page_no"])
        out, _ = ingest.decide(iter(mine), (0, None, [], False, 0))
        want |= {(s, page): (f"{s}__doc-{n:03d}", at, kind) for page, n, kind, at in out}
    assert {k: v for k, v in got.items() if v[0]} == want
    docs = group.doc_summaries(group.group_pages(d)).collect()
    assert sum(r["page_count"] for r in docs) == len(want)


def test_grouping_of_no_pages(spark):
    assert group.group_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_star_pages_turn_the_page():
    html = '<div><p>before the mark <span class="star-pagination">*335</span> after it</p></div>'
    [(tag, text, pages)] = opinions.html_blocks(html, 334)
    assert (tag, pages) == ("p", [334, 335]) and "*335" not in text
    assert opinions.html_blocks(None) == [] and opinions.html_blocks("") == []


def test_filters(spark):
    d = spark.createDataFrame([("a", "memo", ["1", "2"], 3), ("b", "form", [], 5), ("c", None, None, None)], "chunk_id string, doc_kind string, case_nums array<string>, n int")
    ids = lambda spec: sorted(r["chunk_id"] for r in search.filtered(d, spec).collect())
    assert ids(None) == ["a", "b", "c"]
    assert ids({"doc_kind": "memo"}) == ["a"]
    assert ids({"case_nums": {"$in": ["2", "9"]}}) == ["a"]
    assert ids({"case_nums": {"$nin": ["2"]}}) == ["b", "c"]
    assert ids({"$or": [{"n": {"$gt": 4}}, {"n": {"$lt": 4}}]}) == ["a", "b"]
    assert ids({"$and": [{"doc_kind": {"$ne": "memo"}}, {"n": {"$in": [5]}}]}) == ["b"]
    for bad in ({"nowhere": 1}, {"n": {"$near": 1}}, {"$not": []}):
        with pytest.raises(ValueError):
            search.filtered(d, bad)
    with pytest.raises(ValueError):
        search.build_filter(raw="{")
    assert search.build_filter("memo", "88", '{"n": 1}') == {"$and": [{"doc_kind": {"$eq": "memo"}}, {"case_nums": {"$in": ["88"]}}, {"n": 1}]}


def test_top_k_breaks_ties_by_id(spark):
    d = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "chunk_id string, embedding array<double>")
    assert [(r["chunk_id"], r["rank"]) for r in search.search(d, [1.0, 0.0], 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id int, q array<double>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.search_many(d, q, 1).collect()}
    assert got == {(1, 1): "c", (2, 1): "a"}


@pytest.mark.parametrize("bad", [dict(question=""), dict(question="x" * 1001), dict(question="q", top_k=21), dict(question="q", threshold=1.5), dict(question="q", doc_kind="poem")])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        answer.validate_request(**bad)


def test_good_request():
    answer.validate_request("who?", 5, 0.3, "memo")
