"""Command line: python -m papyria.cli ingest | ask | search | eval | serve."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import evaluate, search
from .plans import asking, stages
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="papyria")
    c = p.add_subparsers(dest="command", required=True)
    ingest = c.add_parser("ingest", help="score, clean, group, chunk and embed the pages under ROOT/pages")
    ingest.add_argument("root")
    ingest.add_argument("--from", dest="start", choices=stages.STAGES, help="begin at this stage")
    ingest.add_argument("--threshold", type=float, help="least confidence of a page; without it the run ends after score")
    ingest.add_argument("--dry-run", action="store_true", help="name the stages and run none")
    for name, text in (("ask", "answer a question with its sources"), ("search", "the chunks nearest to a question")):
        one = c.add_parser(name, help=text)
        one.add_argument("root")
        one.add_argument("question")
        one.add_argument("--top-k", type=int, default=search.TOP_K)
        one.add_argument("--doc-kind")
        one.add_argument("--json", action="store_true")
        if name == "ask":
            one.add_argument("--threshold", type=float, default=search.REFUSAL)
            one.add_argument("--model", default="offline")
        else:
            one.add_argument("--case-num")
            one.add_argument("--filter", help="a filter as JSON")
    ev = c.add_parser("eval", help="ask every question of an evaluation set; exit code 1 unless all pass")
    ev.add_argument("root")
    ev.add_argument("questions", help="JSON lines")
    ev.add_argument("--only", help="ids, separated by commas")
    serve = c.add_parser("serve", help="GET /health and POST /ask")
    serve.add_argument("root")
    serve.add_argument("--port", type=int, default=8000)
    return p


def asker_of(spark: SparkSession, root: str) -> asking.Asker:
    records = tables.VectorTable(spark, f"{root.rstrip('/')}/embed").read(stages.NAMESPACE)
    if records is None:
        raise FileNotFoundError(f"{root}: nothing is embedded yet")
    return asking.Asker(spark, asking.vectors_of(records).cache())


def eval_rows(asker, entries: list[dict]) -> list[tuple]:
    """An answer for each entry; a question that fails is a row with an error, and the others go on."""
    rows = []
    for e in entries:
        try:
            a = asker.ask(e["question"])
            rows.append((e["id"], a["answer"], a["refused"], [(h["score"], h["doc_id"]) for h in a["hits"]], a["usage"]["estimated_cost_usd"]))
        except Exception as x:  # noqa: BLE001
            print(f"{e['id']}: {x}", file=sys.stderr)
    return rows


ANSWERS = "id string, answer string, refused boolean, hits array<struct<score:double,doc_id:string>>, cost_usd double"


def evaluate_set(spark: SparkSession, asker, entries: DataFrame) -> tuple[DataFrame, dict]:
    asked = [r.asDict() for r in entries.select("id", "question").orderBy("id").collect()]  # a hand-written set
    scored = evaluate.results(entries, spark.createDataFrame(eval_rows(asker, asked), ANSWERS))
    return scored, evaluate.suite_summary(scored).first().asDict()


def main(argv: list[str] | None = None, session: Callable[[], SparkSession] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = (session or (lambda: SparkSession.builder.appName("papyria").getOrCreate()))()
    if a.command == "ingest":
        run = stages.run_stages(spark, a.root, a.start, a.threshold, a.dry_run)
        if run.report is not None:
            print(tables.markdown_table(run.report.orderBy(run.report.columns[0]), run.done[-1]))
        return 0
    if a.command == "search":
        asker = asker_of(spark, a.root)
        q = [float(x) for x in asker.embed([a.question])[0]]
        hits = search.hit_listing(search.search(asker.vectors, q, a.top_k, search.build_filter(a.doc_kind, a.case_num, a.filter))).orderBy("rank")
        print("\n".join(tables.json_rows(hits)) if a.json else tables.markdown_table(hits, a.question))
        return 0
    if a.command == "ask":
        out = asker_of(spark, a.root).ask(a.question, a.top_k, a.threshold, a.model, a.doc_kind)
        if a.json:
            print(json.dumps(out, indent=2, ensure_ascii=False))
        else:
            sources = "\n".join(f"[{h['rank']}] {h['doc_id']} pages {','.join(map(str, h['page_nos'] or []))} {h['doc_kind']} {h['score']:.3f}" for h in out["hits"])
            print(f"{out['answer']}\n\n{sources}\n{out['usage']}")
        return 0
    if a.command == "eval":
        entries = tables.only(tables.read_eval_set(spark, a.questions), "id", a.only)
        scored, total = evaluate_set(spark, asker_of(spark, a.root), entries)
        print(tables.markdown_table(scored.select("id", *evaluate.CHECKS, "passed", "error").orderBy("id"), "evaluation"))
        print(json.dumps(total))
        return 0 if total["passed"] == total["total"] else 1
    from .service import server

    server(asker_of(spark, a.root), port=a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
