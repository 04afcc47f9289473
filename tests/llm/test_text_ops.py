import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import cases
from papyria.llm import common, decontam, linedup, minhash, packing, rules, substring, tokens, windows

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    rows = rows_of(df)
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).repartition(5).cache()


def test_windows_of_equal_words_have_equal_hashes():
    b = windows.Buffer(b"a b c d\n\nb c\nx a b c\n")
    first, last, many = b.window_starts(3)
    assert many.tolist() == [2, 0, 0, 2]
    h = b.hashes(first, last).tolist()
    assert h[0] == h[3] and len(set(h)) == 3
    assert b.window_starts(3, short=True)[2].tolist() == [2, 0, 1, 2]
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    assert (windows.open_ints(windows.pack_ints(values, True), True) == values).all()
    assert (windows.open_ints(windows.pack_ints(values[::-1])) == values[::-1]).all()


def test_encoder_agrees_with_the_library():
    rng, lib = random.Random(3), library()
    texts = [t or "" for t in cases.texts()] + ["".join(rng.choice("ab é\n\t .' s|<>\x1c") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [a + c + b for c in map(chr, [*range(0x300), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]) for a, b in (("", ""), ("a ", "b"), ("a", " b"), ("", " <|endoftext|>"))]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = tokens.TextEncoder(tokens.default_tokenizer())
    assert encoder.encode(texts) == want
    encoder.MOST = 500  # the cache overflows at every batch
    assert [b for i in range(0, len(texts), 300) for b in encoder.encode(texts[i : i + 300])] == want
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]


@pytest.mark.parametrize("top", [1, 2, 40, 50257, 1 << 32, 1 << 64])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 59, 60, 61, 1000, 5000):
        v = rng.integers(0, top, n, dtype=np.uint64) if top < 1 << 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True)
        words = tokens.simple8b_encode(v)
        assert (tokens.simple8b_decode(words, n) == v).all()
    v = np.array([0, (1 << 64) - 1, 1, 5, 1 << 60, 0, 0], np.uint64)
    assert (tokens.simple8b_decode(tokens.simple8b_encode(v), 7) == v).all()


def test_token_files(spark, docs):
    lib, before = library(), 0
    got = by_id(tokens.token_files(docs))
    for i, t in enumerate(cases.texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == {"doc_id": i, "start": before, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        before += len(ids)
    assert tokens.token_files(cases.empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a"), (1, "b b"), (1, "c"), (1, "b b")], "doc_id long, text string")
    assert sum(r["n_tokens"] for r in rows_of(tokens.token_files(odd))) == 10


def test_damaged_blocks_are_refused():
    block = bytearray(tokens.pack_block([1], [np.arange(9, dtype="<u4").tobytes()]))
    assert tokens.open_block(bytes(block))[2].tolist() == list(range(9))
    block[-1] ^= 1
    with pytest.raises(ValueError):
        tokens.open_block(bytes(block))


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[k] for k, v in got.items())


@pytest.mark.parametrize(("capacity", "pool"), [(1024, 8192), (16, 8)])
def test_packing_is_a_gapless_cut_of_every_document(docs, capacity, pool):
    lib = library()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(packing.pack_documents(docs, capacity=capacity, pool=pool)):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(cases.texts()):
        ids, at = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_decontamination(spark, docs):
    all_texts = cases.texts()
    items = {7: " ".join(all_texts[9].split()[100:130]), 10: "One!", 2: all_texts[50].upper(), 33: "", 34: None, 35: "nowhere to be found in any of these texts", 36: " ".join(all_texts[9].split()[120:150])}
    bench = spark.createDataFrame([*items.items(), (None, all_texts[8]), (7, items[7])], "item_id long, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    wins = defaultdict(set)
    for k, t in items.items():
        w = words(t)
        for i in range(max(1, len(w) - 7) if w else 0):
            wins[tuple(w[i : i + 8])].add(str(k))
    for size, held in ((200_000, 1), (5, 2), (5, 100)):
        got = by_id(decontam.decontaminate(docs, bench, block_windows=size, held=held))
        for i, t in enumerate(all_texts):
            w, hit, found = words(t), set(), set()
            for n in {len(x) for x in wins}:
                for j in range(len(w) - n + 1):
                    if ids := wins.get(tuple(w[j : j + n])):
                        hit |= set(range(j, j + n))
                        found |= ids
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(found), len(found) >= 2)
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert sum(len(words(t[s["start"] : s["end"]])) for s in r["spans"]) == len(hit)
    assert not any(r["n_items"] for r in rows_of(decontam.decontaminate(docs, bench.where("false"))))
    assert decontam.decontaminate(cases.empty(spark), bench).count() == 0
    long = spark.createDataFrame([(1, "x " * 200_000 + items[7] + " y" * 200_000)], "doc_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in rows_of(decontam.decontaminate(long, bench.where("item_id = 7")))] == [(400_030, 30, ["7"])]


def test_one_passage_of_one_item_is_enough_and_a_short_item_is_not(spark):
    item = "what is the capital of the old land beyond the river"
    bench = spark.createDataFrame([(1, item), (2, "one two"), (3, "yes")], "item_id long, text string")
    texts = ["so " + " ".join(item.split()[2:10]) + " then", " ".join(item.split()[2:9]), "yes it is one two of them", "yes " * 7, "", None, item.upper()]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, __n long")
    for size in (200_000, 2):
        out = decontam.uncontaminated(d, bench, block_windows=size)
        assert out.columns == d.columns and {r["doc_id"] for r in out.collect()} == {1, 2, 3, 4, 5}
    assert decontam.uncontaminated(d, bench.where("false")).count() == len(texts)


def brute_substring(texts, n):
    words = {i: WORD.findall(t or "") for i, t in texts}
    seen, out = set(), {}
    for i in sorted(words):
        w, dead = words[i], set()
        for j in range(len(w) - n + 1):
            x = tuple(w[j : j + n])
            if x in seen:
                dead |= set(range(j, j + n))
            seen.add(x)
        kept = " ".join(x for j, x in enumerate(w) if j not in dead)
        out[i] = {"doc_id": i, "n_words": len(w), "n_removed": len(dead), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()}
    return out


@pytest.mark.parametrize("size", [4 << 20, 1500])
def test_substring_dedup(spark, docs, size, monkeypatch):
    if size < 10_000:  # many blocks and shards; the merging functions run with the same constants
        monkeypatch.setattr(substring, "SHARD_WINDOWS", 1 << 22)
    got = by_id(substring.substring_dedup(docs, block_bytes=size))
    assert got == brute_substring(enumerate(cases.texts()), 20)
    if size > 10_000:
        assert substring.substring_dedup(cases.empty(spark)).count() == 0
        odd = spark.createDataFrame([(None, "a " * 30), (1, "a " * 30), (1, "b")], "doc_id long, text string")
        assert sorted(r["n_removed"] for r in rows_of(substring.substring_dedup(odd, with_text=True))) == [0, 29, 30]
        long = " ".join(f"w{i}" for i in range(100_000))
        last = [((1 << 63) - 1, "b " + long), (None, "c " + long), (7, "a " + long), (7, long + " z"), (-5, "unlike " * 3)]
        for parts in (1, 4):  # the same, however the rows are dealt to blocks
            got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in rows_of(substring.substring_dedup(spark.createDataFrame(last, "doc_id long, text string").repartition(parts)))]
            assert sorted(x[1:] for x in got if x[0] != 7) == [(3, 0), (100_001, 100_000), (100_001, 100_000)] and {x[0] for x in got} == {None, 7, -5, (1 << 63) - 1}
            assert sorted(x[2] for x in got if x[0] == 7) == [0, 100_000]


def test_substring_merging_over_many_shards():
    import pandas as pd

    texts = [b"a b c d e f\nq r s t\n", b"x a b c d\nq r s t u\n"]
    import zstandard

    blocks = [substring.Block(zstandard.ZstdCompressor().compress(t), 3, 5) for t in texts]
    back = defaultdict(dict)
    for s in range(5):
        rows = []
        for n, b in enumerate(blocks):
            names, _, counts, bounds = b.cells()
            x, y = bounds[s], bounds[s + 1]
            rows.append((s, n, windows.pack_ints(names[x:y] - np.uint64(s * substring.SHARD_WINDOWS * substring.CELLS), True), np.packbits(counts[x:y] > 1).tobytes()))
        for r in substring.merge_sketches(pd.DataFrame(rows, columns=["shard", "block", "body", "more"])).itertuples():
            back[r.block][s] = r.bits
    assert blocks[0].repeated(back[0]).tolist() == [0, 1, 4, 5]
    assert blocks[1].repeated(back[1]).tolist() == [1, 2, 3, 4]


def brute_near(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: {"doc_id": i, "n_shingles": len(sets[i]), "component_id": find(i), "kept": find(i) == i} for i in sets}


@pytest.mark.parametrize("cluster", [512, 4])
def test_near_duplicates(spark, docs, cluster):
    assert by_id(minhash.near_duplicates(docs, k=3, percent=85, cluster=cluster)) == brute_near(enumerate(cases.texts()), 3, 85)


def test_a_chain_of_near_copies_is_one_component(spark):
    """Neighbours are similar and the ends are not, so the smallest of a bucket does not reach all of it."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(60)] + [(100 + i, " ".join(words[4 * i : 4 * i + 120][::-1])) for i in range(60)]
    want = brute_near(chain, 3, 85)
    assert {r["component_id"] for r in want.values()} == {0, 100}
    for cluster in (512, 5):
        assert by_id(minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), k=3, percent=85, cluster=cluster)) == want


def test_minima_are_of_a_universal_family():
    a, b = minhash._family(4000)
    x, y = np.array([3 << 32], np.uint64), np.array([900 << 32], np.uint64)
    h, g = minhash.minima(x, a, b), minhash.minima(y, a, b)
    assert h.max() < 1 << 32 and abs((h < g).mean() - 0.5) < 0.05 and abs((h >> np.uint64(31)).mean() - 0.5) < 0.05
    sets = [np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(20, 120, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    assert abs((minhash.minima(sets[0], a, b) == minhash.minima(sets[1], a, b)).mean() - 80 / 120) < 0.05
    assert minhash.similar(np.array([1, 2, 3], np.uint64), np.array([2, 3, 4, 9], np.uint64), 40) and not minhash.similar(np.array([1, 2], np.uint64), np.array([3], np.uint64), 1)


def test_near_duplicate_edges(spark, docs):
    assert minhash.near_duplicates(cases.empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "A b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows_of(minhash.near_duplicates(odd))) == [(0, 0, True), (2, 2, True), (2, 2, True), (3, 3, True)]
    kept = minhash.near_dedup(docs, k=3, percent=85)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in brute_near(enumerate(cases.texts()), 3, 85).values())


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 90)]
    got = {r["node"]: r["component"] for r in rows_of(minhash.components(spark.createDataFrame(edges, "a long, b long")))}
    low = {}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low.get(a, a), low.get(b, b))
    assert {n: c for n, c in low.items() if n != c} == got


def brute_lines(texts, min_docs, keep_first=False):
    key = lambda x: lower(x.strip(common.WS))
    holders = defaultdict(set)
    split = {i: (t or "").split("\n") for i, t in texts}
    for i, lines in split.items():
        for x in lines:
            holders[key(x)].add(i)
    out = {}
    for i, lines in split.items():
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= min_docs and not (keep_first and i == min(holders[key(x)])))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, docs, keep_first):
    got = by_id(linedup.line_dedup(docs, keep_first=keep_first))
    want = brute_lines(list(enumerate(cases.texts())), 10, keep_first)
    assert {i: (r["n_lines"], r["n_dropped"], r["kept"]) for i, r in got.items()} == want
    frame = linedup.deduped(docs, keep_first=keep_first, batches=1)  # its columns clash with every name of the operator
    assert frame.columns == docs.columns and frame.dtypes == docs.dtypes
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["n_words"]) for r in rows_of(frame)} == {i: (w[2], len(w[2]), i) for i, w in want.items()}
    assert linedup.line_dedup(cases.empty(spark)).count() == linedup.deduped(cases.empty(spark)).count() == 0


def test_line_dedup_of_hot_keys_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i if i % 7 else None, "\n".join(["Everywhere"] + [f"k{rng.randrange(30)}" for _ in range(rng.randrange(4))])) for i in range(120)] + [(5, "Everywhere\nrare"), (5, "rare")]
    want = brute_lines(list(enumerate(t for _, t in rows)), 10)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (20_000, 5, 1):  # all, some and no keys are hot
        monkeypatch.setattr(linedup, "HOT_SHARE", share)
        got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept"]) for r in rows_of(linedup.line_dedup(d)))
        assert got == sorted((i or 0, *want[n]) for n, (i, _) in enumerate(rows))
    long = spark.createDataFrame([(i, "\n".join(["shared line"] * 20_000 + [f"own {j}" for j in range(20_000)])) for i in range(10)], "doc_id long, text string")
    assert {(r["n_lines"], r["n_dropped"]) for r in rows_of(linedup.line_dedup(long).select("n_lines", "n_dropped"))} == {(40_000, 40_000)}


def test_runs_are_joined_without_exchange_or_sort(spark):
    store = linedup.LineStore(spark)
    for b in range(2):
        store.add(spark.range(500).selectExpr(f"id % 90 + {b * 40} as doc_id", "xxhash64(id) as h1", "xxhash64(7, id) as h2"))
    with linedup._sorted_buckets(spark):
        a, b = (spark.table(n).select("h1", "h2") for n in store.runs()[:2])
        plan = a.join(b.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    store.close()


def test_line_store_over_batches(spark):
    store = linedup.LineStore(spark, fanout=2)
    seen, rng = set(), random.Random(9)
    for b in range(5):
        rows = [(b * 10 + i, "\n".join(f"l{rng.randrange(25)}" for _ in range(3))) for i in range(4)]
        new = {r["h1"] for r in rows_of(linedup.dedup_batch(store, spark.createDataFrame(rows, "doc_id long, text string")))}
        lines = {x for _, t in rows for x in t.split("\n")}
        assert len(new) == len(lines - seen)
        seen |= lines
        assert all(len(level) < 2 for level in store.levels)
    assert store.totals().count() == len(seen)


def test_base_counts(spark, docs):
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 160, 2)], "doc_id long, quality int, toxic int")
    got = by_id(rules.quality_rules(docs, labels))
    for i, t in enumerate(cases.texts()):
        t = t or ""
        w = WORD.findall(t)
        wins = Counter(zip(w, w[1:], w[2:]))
        rep = {p for j, x in enumerate(zip(w, w[1:], w[2:])) if wins[x] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(rep) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert rules.quality_rules(cases.empty(spark), labels.where("false")).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in rows_of(rules.quality_rules(docs, labels.where("false"))))


def test_every_good_document_is_in_the_target(spark):
    """If all documents are labelled good, target and raw corpus are the same, and every score is 0."""
    docs = spark.range(20_050).selectExpr("id as doc_id", "concat('word w', id) as text")
    labels = docs.selectExpr("doc_id", "1 as quality")
    scores = [r["ngram_score"] for r in rules.quality_rules(docs, labels).collect()]
    assert len(scores) == 20_050 and max(map(abs, scores)) < 1e-12


@pytest.mark.parametrize("options", [{}, {"broadcast": 0}])
def test_buckets_grow_with_the_text(spark, options, monkeypatch):
    """Two words of one bucket of 2 ** 16 are told apart in a larger corpus. A large PER_ROOT stands for many bytes."""
    from xxhash import xxh64_intdigest

    monkeypatch.setattr(rules, "PER_ROOT", 12 * 64)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    docs = spark.range(102).selectExpr("id as doc_id", "repeat(case when id < 100 then 'filler ' when id = 100 then 'GOODWRD ' else 'BADWORD ' end, 54) as text")
    buckets = rules.bucket_count(docs)
    assert 1 << 17 < buckets < 1 << 18 and rules.bucket_count(docs.limit(1)) == 1 << 16 == rules.bucket_count(docs.where("false"))
    assert abs(rules.bucket_count(docs.unionAll(docs).unionAll(docs).unionAll(docs)) - 2 * buckets) < 3
    seen, pair = {}, None
    for i in range(10_000):
        w = f"w{i:05d}x"
        h = signed(xxh64_intdigest(w.encode(), seed=42))
        if h % (1 << 16) in seen and seen[h % (1 << 16)][1] % buckets != h % buckets:
            pair = seen[h % (1 << 16)][0], w
            break
        seen[h % (1 << 16)] = (w, h)
    docs = docs.selectExpr("doc_id", f"replace(replace(text, 'GOODWRD', '{pair[0]}'), 'BADWORD', '{pair[1]}') as text")
    labels = docs.selectExpr("doc_id", "int(doc_id <> 101) as quality")
    d = by_id(rules.quality_rules(docs, labels, **options))
    # the bad word and its pair are never in the target
    assert d[100]["ngram_score"] > 0 > d[101]["ngram_score"] + 3


@pytest.mark.parametrize("size", [3, 50, 20_000])
def test_automaton_over_word_codes(size):
    """Windows of one to three words, over vocabularies that take codes of two and of three letters."""
    rng = random.Random(size)
    words = [b"w%d" % i for i in range(size)]
    windows_ = {tuple(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))): ["x"] for _ in range(15_000 if size > 1000 else 12)}
    a = decontam.Automaton(windows_)
    assert a.length == (3 if len(a.code) > 14_400 else 2) and len(set(a.code.values())) == len(a.code)
    for _ in range(100):
        text = [rng.choice([*words[:500], b"unknown"]) for _ in range(40)]
        hit = {p for n in (1, 2, 3) for j in range(len(text) - n + 1) if tuple(text[j : j + n]) in windows_ for p in range(j, j + n)}
        assert {p for x, y in a.scan(text)[0] for p in range(x, y)} == hit
