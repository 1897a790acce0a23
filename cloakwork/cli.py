"""Command line: recognizer, llm-recognizer, anonymizer, transformer, reassembly and pipeline jobs; options may stand in
a YAML file."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.keyed import Keys
from cloakwork.operators import llm_spans
from cloakwork.operators.replace import Settings, anonymize
from cloakwork.plans import jobs
from cloakwork.schema import SPANS
from cloakwork.sources import io, note_files
from cloakwork.sources.resources import word_list


#: Lists that replacement can choose from.
LISTS = ("names", "cities", "streets", "facilities", "stopwords")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cloakwork")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("recognizer", "llm-recognizer", "anonymizer", "transformer", "reassembly", "pipeline"):
        s = sub.add_parser(name)
        s.add_argument("-i", "--input", nargs="+", help="Parquet files, folders or globs")
        s.add_argument("--recursive", action="store_true", default=None, help="folders with all below them")
        s.add_argument("--merge-schemas", action="store_true", default=None, help="of files with different columns")
        s.add_argument("-o", "--output")
        s.add_argument("--config", help="YAML with the same names; the command line wins")
        s.add_argument("--entities", nargs="*")
        s.add_argument("--dry-run", action="store_true", default=None, help="check columns and print the plan")
        s.add_argument("--resume", action="store_true", default=None, help="skip rows that the output has")
        s.add_argument("--resolve", action="store_true", default=None)
        if name not in ("transformer", "reassembly"):
            s.add_argument("--viewer", help="folder for a JSON file a note of the output, in recognizer and anonymizer")
        if name in ("anonymizer", "pipeline"):
            s.add_argument("--salt", help="file with 64 hex digits")
            s.add_argument("--key", help="file with 64 hex digits")
            s.add_argument("--year", type=int, help="of dates without one")
            s.add_argument("--jitter-required", action="store_true", default=None)
            for kind in LISTS:
                s.add_argument(f"--{kind}", help=f"file of {kind} to choose from, one a line")
        if name in ("transformer", "reassembly", "pipeline"):
            s.add_argument("--model", help="module:function that makes a model")
            s.add_argument("--chunk", type=int)
            s.add_argument("--overlap", type=int)
        if name in ("llm-recognizer", "pipeline"):
            s.add_argument("--llm", help="module:function that makes a model, a callable from prompt to reply")
            s.add_argument("--prompt", help="file with the prompt that a note's text follows")
        if name == "llm-recognizer":
            s.add_argument("--attempts", type=int)
        if name == "pipeline":
            s.add_argument("--llm-mode", choices=("off", "only", "merge"))
            s.add_argument("--stages", help="folder for the spans of each stage")
            s.add_argument("--skip", nargs="*", choices=jobs.STEPS, help="steps to leave out")
        if name == "reassembly":
            s.add_argument("--notes", help="Parquet with text_hash and note_text")
    return p


def options(argv: list[str]) -> argparse.Namespace:
    """The command line, filled up from its YAML file; a flag that is not given may be set there."""
    args = parser().parse_args(argv)
    if args.config:
        import yaml

        with open(args.config) as f:
            for k, v in (yaml.safe_load(f) or {}).items():
                k = k.replace("-", "_")
                if not hasattr(args, k):
                    raise SystemExit(f"unknown option {k} in {args.config}")
                if getattr(args, k) is None:
                    setattr(args, k, v)
    needed = ["input", "output", *(["salt", "key"] if args.job in ("anonymizer", "pipeline") and "anonymizer" not in (getattr(args, "skip", None) or ()) else []), *(["notes"] if args.job == "reassembly" else []), *(["llm", "prompt"] if args.job == "llm-recognizer" or getattr(args, "llm_mode", None) in ("only", "merge") else [])]
    missing = [n for n in needed if not getattr(args, n)]
    if missing:
        raise SystemExit(f"{args.job} needs {', '.join('--' + m for m in missing)}")
    return args


def _named(path: str):
    """What module:name stands for."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _model(args: argparse.Namespace) -> jobs.ModelConfig | None:
    if not args.model:
        return None
    return jobs.ModelConfig(args.model, _named(args.model), args.chunk or 512, args.overlap or 40)


def _text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8").strip()


def _viewer_files(out: DataFrame, folder: str) -> None:
    """Files named by row_id, or by text_hash if rows are texts."""
    key = "row_id" if "row_id" in out.columns else "text_hash"
    if {"spans", "note_text"} <= set(out.columns):
        note_files.write_recognizer_files(out, f"{folder}/recognizer", key)
    if {"anonymized_note_text", "items"} <= set(out.columns):
        note_files.write_anonymizer_files(out, f"{folder}/anonymizer", key)


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args = options(argv)
    spark = spark or SparkSession.builder.appName("cloakwork").getOrCreate()
    paths = [args.input] if isinstance(args.input, str) else args.input
    df = io.read_pipeline(spark, [p if args.recursive else io.input_pattern(p) for p in paths], recursive=bool(args.recursive), merge_schemas=bool(args.merge_schemas))
    entities = args.entities or list(jobs.ENTITIES)
    settings = None
    if args.job in ("anonymizer", "pipeline") and args.salt:
        settings = Settings(Keys.load(args.salt, args.key), args.year or dt.datetime.now(dt.timezone.utc).year, jitter_required=bool(args.jitter_required), **{k: tuple(word_list(getattr(args, k))) for k in LISTS if getattr(args, k)})
    if args.job == "recognizer":
        required, key = ["text_hash", "note_text"], "text_hash"
        job = lambda d: jobs.recognize(d, entities, bool(args.resolve))
    elif args.job == "llm-recognizer":
        required, key = ["text_hash", "note_text"], "text_hash"
        job = lambda d: llm_spans.recognize(d, _text(args.prompt), _named(args.llm), args.attempts or 3)
    elif args.job == "anonymizer":
        required, key = ["text_hash", "note_text"], "row_id"
        # two patients may share a text, so that a text alone is no row
        if "row_id" not in df.columns and "note_text" in df.columns:
            df = jobs.identified(df)
        if "spans" not in df.columns:
            df = df.withColumn("spans", F.from_json("recognizer_results_json", SPANS))
        job = lambda d: anonymize(d, settings)
    elif args.job == "transformer":
        required, key = ["text_hash", "note_text"], "text_hash"
        if not (model := _model(args)):
            raise SystemExit("transformer needs --model")
        job = lambda d: jobs.tag(d, model)
    elif args.job == "reassembly":
        required, key = ["text_hash", "chunk_id", "entities"], "text_hash"
        model = _model(args) or jobs.ModelConfig("model", list)  # only its name and labels are used
        job = lambda d: jobs.reassemble(d, io.read_pipeline(spark, io.input_pattern(args.notes)), model)
    else:
        required, key = ["note_text"], "row_id"
        if "note_text" in df.columns:
            df = jobs.identified(df)
        ask = {"llm": _named(args.llm), "prompt": _text(args.prompt), "llm_mode": args.llm_mode} if args.llm_mode in ("only", "merge") else {}
        job = lambda d: jobs.pipeline(d, settings, _model(args), entities, stages=args.stages, skip=args.skip or (), **ask)
    if args.dry_run:
        print(jobs.dry_run(df, required, job))
        return 0
    if args.resume:
        rows = jobs.run_resumed(df, job, args.output, key)
    else:
        io.write_parquet(jobs.without_failed(job(df)), args.output)
        rows = spark.read.parquet(args.output).count()
    if not rows and not df.isEmpty():
        raise jobs.EmptyOutput("no rows came out of an input that had some")
    if getattr(args, "viewer", None):
        _viewer_files(spark.read.parquet(args.output), args.viewer.rstrip("/"))
    print(json.dumps({"job": args.job, "rows": rows}))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
