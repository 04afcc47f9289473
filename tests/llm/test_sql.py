"""The queries over the small tables against their DuckDB SQL, or what SQL can say of them."""

import os

import duckdb
import pytest

from papyria.llm import classifier, common, oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(rel):
    names = [c[0] for c in rel.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = rows(duck.execute(oracles.ORACLES[name]))
    assert names == want[0] and sorted(tuple(r[c] for c in names) for r in df.collect()) == want[1]


BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT *, CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS g,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM n),
r AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM u) WHERE c > 1) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(k, 0) > 50 * len(w) AS base_failed FROM n LEFT JOIN r USING (doc_id)"""


def test_base_columns_of_quality_rules(spark, duck):
    df = queries.op8_quality_rules(spark, DATA)
    got = df.collect()
    names = sorted(set(df.columns) - {"kept"})
    assert sorted(tuple(r[c] for c in names) for r in got) == rows(duck.execute(BASE))[1]
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)


def test_classifier_on_labels_it_never_saw(spark, duck):
    """Over sf0.01, the third of the labels that is held out."""
    data = DATA.replace("sf0.001", "sf0.01")
    held = {r["doc_id"]: r["predicted"] for r in queries.op9_quality_classifier(spark, data).where("held_out").collect()}
    labels = common.table(spark, data, "labels").where("quality in (0, 1)").where(classifier.held_out(common.F.col("doc_id"))).collect()
    right = {q: [held[r["doc_id"]] == q for r in labels if r["quality"] == q] for q in (0, 1)}
    assert all(len(v) >= 10 and sum(v) >= 0.9 * len(v) for v in right.values())


def test_every_page_has_one_row_with_its_own_counts(spark):
    got = queries.op1_html_extraction(spark, DATA).collect()
    assert len(got) == common.table(spark, DATA, "pages").count() and all(r["n_chars"] == len(r["text"]) and "<p>" not in r["text"] for r in got)
