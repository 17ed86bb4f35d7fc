"""Command line over a stored engine: ``python -m tessella --state FOLDER COMMAND``."""

from __future__ import annotations

import argparse
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import tessella
from tessella.engine import Engine, NotPending, UnknownSources
from tessella.scale import session
from tessella.schemas import OPERATION_TYPES
from tessella.sources.state import read_state_json, write_json_lines

DRAFT = (
    "id string, seq long, sources array<string>, "
    "ops array<struct<op_type:string,params:map<string,string>,description:string>>, "
    "proposed_content string, explanation string"
)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella")
    top.add_argument("--state", default=None, help="folder that holds the tables")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("init")
    commands.add_parser("status")
    commands.add_parser("demo")
    load = commands.add_parser("import", help="load a state written as one JSON document")
    load.add_argument("path")
    dump = commands.add_parser("export", help="write JSON lines per table")
    dump.add_argument("path")
    ingest = commands.add_parser("ingest")
    ingest.add_argument("content")
    for name in ("id", "topic", "source", "author"):
        ingest.add_argument(f"--{name}")
    ingest.add_argument("--quality", type=float, default=0.85)
    ingest.add_argument("--tags", nargs="*", default=[])
    for name in ("query", "compose"):
        ask = commands.add_parser(name)
        ask.add_argument("text")
        ask.add_argument("--top-k", type=int, default=5)
    appeal = commands.add_parser("appeal")
    appeal.add_argument("appeal_id")
    appeal.add_argument("--sources", default="")
    appeal.add_argument("--content", required=True)
    appeal.add_argument("--explanation", default="")
    appeal.add_argument("--operation", choices=OPERATION_TYPES)
    appeal.add_argument("--submit", action="store_true")
    approve = commands.add_parser("approve")
    approve.add_argument("appeal_id")
    approve.add_argument("--approver", default="user")
    reject = commands.add_parser("reject")
    reject.add_argument("appeal_id")
    reject.add_argument("--reason", default="")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"tessella {tessella.__version__}")
        return 0
    spark = spark or session("tessella-cli")
    engine = Engine(spark, args.state or tempfile.mkdtemp(prefix="tessella-state-"))
    handler = globals()[f"run_{args.command}"]
    try:
        handler(engine, args)
    except (UnknownSources, NotPending) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


def _ids(engine: Engine, value: str):
    return engine.spark.createDataFrame([(value,)], "id string")


def _question(engine: Engine, text: str):
    return engine.spark.createDataFrame([(1, text)], "qid long, text string")


def run_init(engine: Engine, args) -> None:
    if engine.shelves().isEmpty():
        engine.create_shelf("main")
    print("Shelf 'main' initialised.")


def run_ingest(engine: Engine, args) -> None:
    stored = engine.store.read("fragments").count()
    row = (
        args.id or f"f-{stored + 1}", stored + 1, args.content, args.topic, args.source or "cli",
        args.quality, args.author or "cli-user", args.tags,
    )
    rows = engine.spark.createDataFrame(
        [row],
        "id string, seq long, content string, topic string, source string, quality double, "
        "author string, tags array<string>",
    )
    for outcome in engine.ingest(rows).collect():
        verdict = "accepted" if outcome["accepted"] else f"REJECTED ({outcome['reject_reason']})"
        print(f"Fragment '{outcome['id']}' {verdict}.")


def run_query(engine: Engine, args) -> None:
    hits = engine.search(_question(engine, args.text), args.top_k)
    shown = hits.join(engine.fragments().select("id", "topic", F.substring("content", 1, 100).alias("text")), "id")
    lines = shown.orderBy("rank").collect()  # at most top-k rows
    for hit in lines:
        print(f"[{hit['score']:.3f}] {hit['id']} ({hit['topic'] or 'no topic'}): {hit['text']}")
    if not lines:
        print("No results.")


def run_compose(engine: Engine, args) -> None:
    print(engine.compose(_question(engine, args.text), args.top_k).first()["answer"])


def run_appeal(engine: Engine, args) -> None:
    sources = [s.strip() for s in args.sources.split(",") if s.strip()]
    ops = [(args.operation, {}, f"CLI {args.operation}")] if args.operation else []
    draft = (args.appeal_id, engine.appeals().count() + 1, sources, ops, args.content, args.explanation)
    outcome = engine.propose(engine.spark.createDataFrame([draft], DRAFT)).first()
    if not outcome["accepted"]:
        raise NotPending(f"appeal refused: {outcome['reject_reason']}")
    report = engine.reports(_ids(engine, args.appeal_id)).first()
    print(
        f"Appeal '{args.appeal_id}' created (sources={sources}, coverage={report['coverage']:.2f}, "
        f"risk={report['risk']:.2f}, aggregate={report['aggregate_score']:.2f})."
    )
    print(f"Explanation: {report['report_explanation']}")
    if args.submit:
        engine.submit(_ids(engine, args.appeal_id))
        print(f"Appeal '{args.appeal_id}' submitted for review.")


def run_approve(engine: Engine, args) -> None:
    new = engine.approve(_ids(engine, args.appeal_id), approver=args.approver).first()
    print(f"Appeal '{args.appeal_id}' approved -> fragment '{new['id']}' stored.")


def run_reject(engine: Engine, args) -> None:
    engine.reject(_ids(engine, args.appeal_id).withColumn("reason", F.lit(args.reason)))
    print(f"Appeal '{args.appeal_id}' rejected.")


def run_status(engine: Engine, args) -> None:
    for name, value in engine.statistics().first().asDict().items():
        print(f"{name}: {value}")


def run_import(engine: Engine, args) -> None:
    engine.store.load(read_state_json(engine.spark, args.path))
    print(f"Loaded {args.path}.")


def run_export(engine: Engine, args) -> None:
    names = ("fragments", "appeals", "nodes")
    write_json_lines({n: engine.store.read(n) for n in names}, args.path)
    print(f"Wrote {args.path}.")


def run_demo(engine: Engine, args) -> None:
    """Ingest, query, propose, approve, report on three short texts."""
    rows = engine.spark.createDataFrame(
        [
            ("d-1", 1, "Tides follow the moon and the sun.", "sea", 0.9),
            ("d-2", 2, "Spring tides come at new moon and full moon.", "sea", 0.85),
            ("d-3", 3, "tides?", "sea", 0.2),
        ],
        "id string, seq long, content string, topic string, quality double",
    )
    engine.ingest(rows).show()
    engine.compose(_question(engine, "moon tides")).show(truncate=60)
    draft = ("a-1", 1, ["d-1", "d-2"], [("merge", {}, "")], "Tides follow the moon; spring tides come at new and full moon.", "merge")
    engine.propose(engine.spark.createDataFrame([draft], DRAFT))
    engine.submit(_ids(engine, "a-1"))
    engine.approve(_ids(engine, "a-1")).select("id", "content", "topic").show(truncate=60)
    engine.statistics().show()
