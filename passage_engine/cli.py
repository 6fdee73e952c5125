"""Command line: ingest, ask, chat, evaluate, generate-ground-truth."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from passage_engine import config, providers
from passage_engine.plans.engine import Engine, generate_ground_truth
from passage_engine.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    d = config.DEFAULTS
    top = argparse.ArgumentParser(prog="passage-engine")
    top.add_argument("--data", default=config.data_dir())
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("ingest")
    p.add_argument("--doc", required=True)
    p.add_argument("--doc-id", required=True)
    p.add_argument("--file", action="store_true", help="the path is one file")
    for name, value in (("fixed-size", d.fixed_size), ("fixed-overlap", d.fixed_overlap), ("window", d.window), ("stride", d.stride)):
        p.add_argument(f"--{name}", type=int, default=value)
    for name in ("ask", "chat"):
        p = sub.add_parser(name)
        p.add_argument("--doc-id", required=True)
        p.add_argument("--question", required=True)
        p.add_argument("--top-k", type=int, default=d.top_k)
        if name == "ask":
            p.add_argument("--max-sentences", type=int, default=d.max_sentences)
            for dense in config.DENSE:
                p.add_argument(f"--{dense.replace('_', '-')}", action="store_true", help="ask this dense pipeline too; it is left out, with a warning, without an embedder")
        else:
            p.add_argument("--pipeline", default="fixed")
        p.add_argument("--provider", choices=("ollama", "azure"))
        p.add_argument("--model")
    p = sub.add_parser("evaluate")
    p.add_argument("--doc-id", required=True)
    p.add_argument("--ground-truth", required=True)
    p.add_argument("--top-k", type=int, default=d.top_k)
    p.add_argument("--judge", action="store_true")
    p.add_argument("--use-llm", action="store_true")
    p.add_argument("--provider", choices=("ollama", "azure"), help="with --use-llm: the model that writes the answers")
    p.add_argument("--model")
    p.add_argument("--export")
    p = sub.add_parser("generate-ground-truth")
    p.add_argument("--folder", required=True)
    p.add_argument("--output")
    p.add_argument("--provider", default="ollama", choices=("ollama", "azure"))
    p.add_argument("--model")
    p.add_argument("--url")
    p.add_argument("--questions-per-doc", type=int, default=d.questions_per_doc)
    p.add_argument("--min-chars", type=int, default=d.min_chars)
    p.add_argument("--max-chars", type=int, default=d.max_chars)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, embedders: dict[str, providers.Embedder] | None = None) -> int:
    """``embedders``: of the dense pipelines, which are then built by ingest and asked if their flags are set."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("passage-engine").getOrCreate()
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2))
    try:
        if a.command == "ingest":
            own = replace(config.DEFAULTS, fixed_size=a.fixed_size, fixed_overlap=a.fixed_overlap, window=a.window, stride=a.stride)
            show([r.asDict() for r in Engine(spark, a.data, own, embedders).ingest(a.doc, a.doc_id, folder=not a.file).collect()])
        elif a.command == "ask":
            model = providers.language_model(a.provider, a.model) if a.provider else None
            asked = (*config.CLASSIC, *(p for p in config.DENSE if getattr(a, p)))
            show(Engine(spark, a.data, embedders=embedders).ask_json(a.question, a.doc_id, pipelines=asked, k=a.top_k, max_sentences=a.max_sentences, model=model)["results"])
        elif a.command == "chat":
            found = Engine(spark, a.data, embedders=embedders).chat(a.question, a.doc_id, providers.language_model(a.provider or "ollama", a.model), a.pipeline, a.top_k)
            show(found)
            return int(found["error"] is not None)
        elif a.command == "evaluate":
            judge = providers.OverlapJudge() if a.judge else None
            model = providers.language_model(a.provider, a.model) if a.use_llm and a.provider else None
            show(Engine(spark, a.data).evaluate(readers.numbered_questions(spark, a.ground_truth), a.doc_id, a.top_k, judge=judge, use_llm=a.use_llm, export=a.export, model=model))
        else:
            own = replace(config.DEFAULTS, questions_per_doc=a.questions_per_doc, min_chars=a.min_chars, max_chars=a.max_chars)
            how = {"url": a.url} if a.url else {}
            found = generate_ground_truth(readers.require_pages(readers.pages(spark, a.folder, "ground_truth")), providers.language_model(a.provider, a.model, **how), own)
            writers.json_lines(found, a.output or f"{a.folder.rstrip('/')}_ground_truth.jsonl")
    except (ValueError, LookupError, FileNotFoundError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
