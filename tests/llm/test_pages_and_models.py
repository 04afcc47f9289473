import html as entities
import math
import os
import random
import re
import zlib

import pytest

import cases
import corpus_pipeline
from papyria.llm import classifier, common, html, licenses, minhash
from test_text_ops import brute_lines, brute_near, by_id, rows_of

MENU = '<nav><ul><li><a href="/a">A</a></li></ul></nav>'


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{MENU}<div class="box">Seen everywhere {extra}</div><article><h1>Head &amp; line</h1>{body}</article><footer>&copy; x</footer></body></html>'


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<p><b>one<br><p>two  \n three</p>", "Head & line\none\ntwo three"),
        ("<p>a<div class='cookie-notice'>no</div><p>b<aside>no</aside>", "Head & line\na\nb"),
        ("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table>", "Head & line\nx\ny\n1\n2"),
        ("<p>&#x41;&eacute;&amp;lt; 1 < 2 &am</p><!-- no --><![CDATA[z]]>", "Head & line\nAé&lt; 1 < 2 &am\nz"),
        ('<p title="a > b">t</p><section id="comments"><p>no</p></section><form>no</form><p hidden>no</p>', "Head & line\nt"),
        ("<p>cut <a href='x", "Head & line\ncut"),
        ("<header><h2>kept</h2></header><header>by x</header><p></p>", "Head & line\nkept"),
    ],
)
def test_markup(body, text):
    whole = page(body) if "cut" not in body else page(body).split("</article>")[0]
    assert html.extract(whole) == text


def test_article_in_an_oddly_named_wrapper():
    assert html.extract('<div class="with-sidebar"><article>a</article></div><div class="sidebar">b</div>') == "a"
    assert html.extract('<div class="comments"><article>c</article></div><article>a</article>') == "a"
    assert html.extract("plain <p>text") == "plain\ntext"


def test_hosts():
    assert [html.host_of(u) for u in ("https://A.b:80/x", "//u@c.d?q", "e.f/g", None, "", "/path", "mailto:x")] == ["a.b", "c.d", "e.f", "", "", "", ""]


@pytest.mark.parametrize("most", [500_000, 0])
def test_templates_are_counted_per_host(spark, most):
    rng = random.Random(1)
    plain = lambda i: f"<body><div class='x'>Site wide</div><div>own {i}</div><p>Site line</p><p>text {rng.random()}</p></body>"
    story = lambda i, extra="": f"<body><article><p>Sign up today</p><p>story {i}</p><div><p>box</p> of {i % 10}</div><p>quoted by {i % 10}</p>{extra}</article></body>"
    rows = [(i, f"http://one.x/{i}", plain(i)) for i in range(30)] + [(100, "http://two.x/1", plain(0)), (101, None, None), (102, "http://one.x", ""), (103, "http://one.x", page("<p>Site line</p>"))]
    rows += [(200 + i, f"http://three.x/{i}", story(i)) for i in range(60)] + [(300, "http://four.x", story(0))]
    rows += [(400 + i, f"http://five.x/{i}", "<p>copied</p><p>to many addresses</p>") for i in range(9)] + [(409, "http://five.x/9", "<p>copied</p>")]
    got = {r["page_id"]: r for r in rows_of(html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_most=most))}
    assert len(got) == len(rows)
    assert all(got[i]["text"].startswith(f"own {i}\ntext") for i in range(30))
    assert got[100]["text"].startswith("Site wide\nown 0\nSite line\ntext")
    assert got[101]["text"] == got[102]["text"] == ""
    assert got[103]["text"] == "Head & line"  # on more than half of that host's pages
    # inside an article: a notice on all pages and a container on six of sixty go, a passage on six stays
    assert all(got[200 + i]["text"] == f"story {i}\nquoted by {i % 10}" for i in range(60))
    assert got[300]["text"] == "Sign up today\nstory 0\nbox\nof 0\nquoted by 0"
    assert got[400]["text"] == "copied\nto many addresses" and got[409]["text"] == "copied"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
    # without the templates the same pages give another text
    assert html.extract(story(3)) == "Sign up today\nstory 3\nbox\nof 3\nquoted by 3"


def test_template_counts_by_brute_force(spark):
    rng = random.Random(4)
    pages = [(i, f"http://h{i % 3}.x/{i}", "".join(f"<div>{rng.choice('abcdefgh')}<p>{rng.choice('uvw')}</p></div>" for _ in range(rng.randrange(5)))) for i in range(150)]
    want = {}
    texts = {}
    for _, url, page_ in pages:
        blocks, found = html.text_blocks(html.article_roots(page_)) if page_ else ([], [])
        texts.setdefault(url[:12], set()).add(tuple(blocks))
        for h, *_ in found:
            want.setdefault((url[:12], h), set()).add(tuple(blocks))
    rows = html.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = sorted(r["wide"] for r in rows_of(html.site_templates(rows, 5, 50)))
    assert got == sorted(2 * len(v) >= len(texts[u]) for (u, _), v in want.items() if len(v) >= 5)


@pytest.mark.parametrize("body", ["<b>" * 100_000 + "deep", "<b>word " * 100_000, "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<p>x</i>" * 100_000, "<article>" * 100_000 + "deep", "<article>" + "<header><h1>a" * 20_000 + "deep", "<ul><li>" * 50_000 + "deep", "<" * 100_000, "word " * 1_000_000])
def test_deep_and_long_pages(body):
    text = html.extract(body)
    assert text and len(text) <= len(body) and "<b>" not in text
    if "deep" in body:
        assert text.endswith("deep")


def labelled(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    good = lambda: " ".join(rng.choice(words) for _ in range(80))
    bad = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(80))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(1000, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")


def test_classifier(spark):
    docs, labels = labelled(spark)
    model = classifier.train(docs, labels)
    got = rows_of(classifier.classify(docs, model))
    assert len(got) == 303
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            assert r["predicted"] == (r["doc_id"] % 3 > 0)
    assert classifier.accepted(docs, model).where("doc_id < 1000").count() == 200
    assert {r["score"] for r in rows_of(classifier.classify(docs, classifier.train(docs, labels.where("false"))))} == {0.5}
    assert classifier.classify(cases.empty(spark), model).count() == 0


def test_labels_of_the_held_out_third_do_not_matter(spark):
    docs, labels = labelled(spark)
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert classifier.train(docs, labels) == classifier.train(docs, other)


def test_licenses(spark):
    words = "lorem ipsum dolor sit amet"
    files = [
        (1, "r", "LICENSE", "Released under the MIT License."),
        (2, "r", "a/b/c.py", f"# Licensed under the Apache License, Version 2.0.\n{words}"),
        (3, "r", "a/b/d.py", words),
        (4, "r", "a/x/e.py", f"{words} the license of this is not known to {words}"),
        (5, "r", "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "q", "a/b/f.py", words),
        (7, None, None, None),
        (8, "r", "top.py", ""),
        (9, "r", "a/bb/z.py", words),
        (9, "r", "a/bb/z.py", words),
        (10, "r", "a/b/LICENSE.2", "This work is licensed under the GNU General Public License, version 3."),
    ]
    rows = rows_of(licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, repo string, path string, text string")))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["origin"], r["from_dir"]) for r in rows}
    assert len(rows) == len(files)
    assert got[1] == ("MIT", "MIT", "own", None)
    assert got[2] == ("Apache-2.0", "Apache-2.0", "own", None)
    assert got[3] == (None, "GPL-3.0", "inherited", "a/b")
    assert got[4] == (None, "MIT", "inherited", "")
    assert got[6] == (None, None, "none", None) == got[7]
    assert got[8] == got[9] == (None, "MIT", "inherited", "")
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, repo string, path string, text string")).count() == 0


def even():
    return licenses.Matcher({t: 1.0 for t in licenses.vocabulary(licenses.TEMPLATES)}, licenses.TEMPLATES)


def test_every_template_is_nearest_to_itself():
    m = even()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            score, found = m.best(t)
            assert found == name and score > 0.999


GPL_HEADER = """#!/usr/bin/env python
# frob - frobs the frobs
# Copyright (C) 2019 Ada Example
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import frob
"""
BSD_HEADER = """/*
Copyright (c) 2011, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
 * Neither the name of Someone nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
*/
int main() {}
"""
APACHE_HEADER = """// Copyright 2020 The Frob Authors
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
package frob
"""


@pytest.mark.parametrize(
    ("path", "text", "name"),
    [
        ("a.py", GPL_HEADER, "GPL-3.0"),
        ("a.py", GPL_HEADER.replace("version 3", "version 2"), "GPL-2.0"),
        ("a.py", GPL_HEADER.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
        ("a.c", BSD_HEADER, "BSD-3-Clause"),
        ("a.go", APACHE_HEADER, "Apache-2.0"),
        ("a.js", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\nx", "MPL-2.0"),
        ("a.c", "/* SPDX-License-Identifier: ISC */\nint x;", "ISC"),
        ("LICENSE", "MIT License\n\nCopyright (c) 2020 A. N. Author\n\n" + licenses.TEMPLATES["MIT"][0].replace(" of ", " of\n"), "MIT"),
        ("a.txt", "Many projects chose a license long ago, and the license of a library matters to those who ship it with a product.", None),
        ("a.txt", "She asked the court for permission to publish, and the copyright holder gave it the next day with some conditions.", None),
        ("a.txt", "The GNU General Public License was much discussed in that year by people who wrote about software and its history.", None),
        ("LICENSE", "", None),
    ],
)
def test_headers_and_files_are_named_and_prose_is_not(path, text, name):
    score, found = even().file(path, text)
    assert (found if score >= 0.75 else None) == name


@pytest.mark.parametrize(("file", "name"), [("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0")])
def test_whole_licence_files(file, name):
    path = f"/usr/share/common-licenses/{file}"
    if not os.path.exists(path):
        pytest.skip("no licence files on this machine")
    score, found = even().file("LICENSE", open(path, encoding="utf-8").read())
    assert found == name and score >= 0.75


def test_cosine_and_frequencies_by_brute_force(spark):
    templates = {"A": ["alpha beta beta license"], "B": ["gamma license two"]}
    texts = ["alpha beta beta license", "beta beta alpha license other", "gamma two", "license two gamma gamma", "", None, "the license alpha"]
    d = spark.createDataFrame([(i, "r", "f", t) for i, t in enumerate(texts)], "doc_id long, repo string, path string, text string")
    words = lambda t: re.findall("[a-z]+", t or "")
    vocabulary = {w for ts in templates.values() for t in ts for w in words(t)}
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in words(t) for t in texts))) + 1 for w in vocabulary}
    assert licenses.inverse_frequencies(d, templates) == pytest.approx(idf)
    other = sum(idf.values()) / len(idf)

    def vector(t):
        return {w: (1 + math.log(words(t).count(w))) * idf.get(w, other) for w in words(t)}

    def cosine(a, b):
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    got = {r["doc_id"]: r for r in rows_of(licenses.scan_licenses(d, templates, threshold=0.6))}
    for i, t in enumerate(texts):
        score, name = max(((cosine(vector(t), vector(x)), n) for n, (x,) in templates.items()), default=(0, "")) if "license" in (t or "") else (0, "")
        assert got[i]["own_score"] == pytest.approx(score) and got[i]["own_license"] == (name if score >= 0.6 else None)


def test_inheritance_against_plain_python(spark, monkeypatch):
    rng = random.Random(6)
    files = []
    for i in range(400):
        path = "/".join([rng.choice("ab") for _ in range(rng.randrange(5))] + [f"f{i}"])
        own = rng.choice(["MIT", "ISC", "GPL-3.0"]) if rng.random() < 0.1 else None
        files.append((i, rng.choice("xyz"), path, own, 0.9 if own else 0.1, bool(own and rng.random() < 0.7)))
    says = {}
    for _, repo, path, own, score, declares in files:
        if declares:
            key = repo, path.rpartition("/")[0]
            says[key] = min(says.get(key, own), own)
    d = common.stored(spark.createDataFrame(files, "doc_id long, repo string, path string, own_license string, own_score double, declares boolean"), "test-scan")
    for hot in (20_000, 3):  # with and without directories that are met by a broadcast
        monkeypatch.setattr(licenses, "join_to_unique", lambda *a, hot=hot: common.join_to_unique(*a, hot_share=hot))
        got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in rows_of(licenses.inherit(d))}
        for i, repo, path, own, _, _ in files:
            up = path.rpartition("/")[0]
            while (repo, up) not in says and up:
                up = up.rpartition("/")[0]
            found = says.get((repo, up))
            assert got[i] == ((own, "own", None) if own else (found, "inherited", up) if found else (None, "none", None))


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark)
    more = [(2000 + i, t) for i, t in enumerate(cases.texts())]
    bench = [(1, " ".join(more[9][1].split()[:20])), (2, " ".join(more[9][1].split()[50:70])), (3, "not here at all")]
    rows = [(r["doc_id"], r["text"], "en", "s", len(r["text"] or "")) for r in docs.where("doc_id is not null").collect()] + [(i, t, "en", "s", len(t or "")) for i, t in more]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, columns = common.table(spark, str(tmp_path), "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = common.stored(stage(spark, now, str(tmp_path)), "test-stage")
        if name == "pack":
            break
        assert now.columns == columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "quality":
            model = classifier.train(common.table(spark, str(tmp_path), "documents"), labels)
            assert after == {i: t for i, t in before.items() if classifier.score(model, t) >= 0.5}
        elif name == "lines":
            assert after == {i: x[2] for i, x in brute_lines(list(before.items()), 10, True).items()}
        elif name == "near_duplicates":
            assert after == {i: before[i] for i, r in brute_near(before.items(), 5, 80).items() if r["kept"]}
        elif name == "decontamination":
            assert set(before) - set(after) == {2009} & set(before)  # the two passages stand in that text alone
    assert {r["doc_id"] for r in now.collect()} == set(after)
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows_of(df))
    assert sum(x[2] for x in key(again)) == sum(x[2] for x in key(now))
