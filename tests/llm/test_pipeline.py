"""Each stage of the pipeline against a brute-force version on what its predecessor kept, and the whole run."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import cases
import corpus_pipeline
from papyria.llm import classifier, tokens
from test_text_ops import brute_lines, brute_near, lower


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark; odd rows, copies, long lines that many share, and leaks."""
    d = tmp_path_factory.mktemp("corpus")
    texts = [t for t in cases.texts()]
    good = [f"The river crossed the {w} valley before the town was built there, and its bridge stood for {i} years.\nfooter line\n" * 2 for i, w in enumerate("green long deep wide narrow old cold warm".split() * 5)]
    junk = [f"buy cheap {w} now $$$ click {i} click {i} http://{w}.biz free free win {w}" for i, w in enumerate("pills watch casino loan shoes seo coins tokens".split() * 5)]
    leak = ["Which tributary did the surveyors of the northern expedition follow before the winter", "Name the metal that turns green when it stands in salt air for years"]
    texts += good + junk + [f"The river crossed the valley before the town was built there. {x} And its bridge stood for years." for x in leak]
    n = len(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "a row without an id", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    base = n - len(good) - len(junk) - 2
    marks = [(base + i, 1, 0) for i in range(len(good))] + [(base + len(good) + i, 0, 0) for i in range(len(junk))] + [(None, 1, 0), (base, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak[0]), (2, leak[1]), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, model = docs.columns, classifier.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(spark, docs, corpus)
        assert after.columns == columns and after.dtypes == docs.dtypes
        docs = after.cache()
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        known = {k: v for k, v in before.items() if k is not None}
        if name == "quality":
            assert got == {k: v for k, v in before.items() if classifier.score(model, v) >= 0.5}
        elif name == "lines":
            want = brute_lines(list(known.items()), 10, True)
            assert {k: v for k, v in got.items() if k is not None} == {k: want[k][2] for k in known}
        elif name == "near_duplicates":
            want = brute_near(list(known.items()), 5, 80)
            assert set(got) - {None} == {k for k in known if want[k]["kept"]} and all(got[k] == before[k] for k in got)
        else:
            words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
            items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()}
            wins = {k: {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} if w else set() for k, w in items.items()}
            bad = set()
            for k, v in before.items():
                w = words(v)
                if {tuple(w[i : i + 8]) for i in range(len(w) - 7)} & set().union(*wins.values()):
                    bad.add(k)
            assert bad and set(got) == set(before) - bad
        kept.append(len(got))
    assert kept == sorted(kept, reverse=True)
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, corpus), {r["doc_id"]: r["text"] for r in docs.collect()})


def check_packing(packed, texts):
    from tokenizers import Tokenizer

    lib, total, used = Tokenizer.from_file(tokens.default_tokenizer()), defaultdict(int), defaultdict(int)
    for r in packed.collect():
        total[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    assert dict(total) == {k: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    assert all(n == 1024 or n & (n - 1) == 0 for n in used.values())


def test_run_is_the_stages_one_after_the_other(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


def test_stages_take_empty_tables(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_ratio_verdict_by_brute_force(spark):
    """The native log ratio against the same counts in Python, with the same 64-bit hash."""
    import math
    from collections import Counter

    import xxhash

    from papyria.llm import rules

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42))
    docs = {i: t for i, t in enumerate(cases.texts())}
    good = [i for i in docs if i % 4 == 0]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    grams = {}
    for i, t in docs.items():
        h = [word(w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")]
        grams[i] = [x & 0xFFFF for x in h + [pair(a, b) for a, b in zip(h, h[1:])]]
    raw, target = Counter(g for v in grams.values() for g in v), Counter(g for i in good for g in grams[i])
    raws, goods = sum(raw.values()), sum(target.values())
    weight = lambda g: math.log((target[g] + 1) / (goods + 65536)) - math.log((raw[g] + 1) / (raws + 65536))
    for r in rules.quality_rules(cases.documents(spark), labels).collect():
        want = sum(map(weight, grams[r["doc_id"]])) / len(grams[r["doc_id"]]) if grams[r["doc_id"]] else 0.0
        assert r["ngram_score"] == pytest.approx(want, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["ngram_score"] >= rules.THRESHOLD)
