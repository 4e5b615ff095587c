"""Command line: ``python -m sparkveil rewrite|restore|engine|version``.

Tokens live in a Parquet table given by ``--store``, so a later call can restore what an earlier one replaced.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.detectors import default_registry
from .operators import tokens
from .operators.detect import MODES, CustomPattern, rewrite_texts, stats_by_type
from .sources import texts

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkveil")
    top.add_argument("--config", help="a JSON or YAML file of settings")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("rewrite", help="replace what the detectors find")
    one.add_argument("words", nargs="*", help="the text; else --file, else standard input")
    one.add_argument("--file")
    one.add_argument("--mode", default="replace", choices=[*MODES, "encrypt"])
    one.add_argument("--effective-modes", action="store_true", help="let the mode change the text; without this every mode replaces")
    one.add_argument("--key", help="16, 24 or 32 signs, for the mode encrypt")
    one.add_argument("--pattern", action="append", default=[], help="a further pattern, reported as custom")
    one.add_argument("--format", default=None, choices=["text", "json", "yaml"])
    one.add_argument("--output", "-o")
    one.add_argument("--reversible", action="store_true")
    one.add_argument("--ttl", type=int, default=86_400, help="seconds that a token lives")
    one.add_argument("--store")
    one.add_argument("--stats", action="store_true")
    back = sub.add_parser("restore", help="the original text of a token")
    back.add_argument("words", nargs="*")
    back.add_argument("--token")
    back.add_argument("--token-file")
    back.add_argument("--output", "-o")
    back.add_argument("--store", required=True)
    engine = sub.add_parser("engine").add_subparsers(dest="action", required=True)
    for name in ("stats", "cleanup", "rotate-keys"):
        engine.add_parser(name).add_argument("--store")
    engine.add_parser("patterns")
    test = engine.add_parser("test")
    test.add_argument("words", nargs="+")
    test.add_argument("--pattern", help="only this type")
    sub.add_parser("version")
    return top


def put(text: str, path: str | None, end: str = "") -> None:
    """To a file that only its owner can read, or to standard output."""
    if not path:
        sys.stdout.write(text + end)
        return
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
        f.write(text)


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "token string, original_text string, redaction_type string, created timestamp, expires timestamp")


def store_of(spark: SparkSession, path: str | None) -> DataFrame:
    return spark.read.parquet(path) if path and os.path.isdir(path) else empty_store(spark)


def rewrite(spark: SparkSession, a, settings: dict) -> None:
    if a.words:
        source = texts.from_arguments(spark, a.words)
    elif a.file:
        source = texts.from_files(spark, a.file)
    else:
        source = texts.from_lines(spark, sys.stdin.read().splitlines())
    custom = tuple(CustomPattern("custom", p) for p in a.pattern)
    done = rewrite_texts(source, custom=custom, mode=a.mode, effective_modes=a.effective_modes, key=a.key)
    token = ""
    if a.reversible:
        made = tokens.issue(done, "text", F.current_timestamp(), a.ttl).collect()  # one text
        token = made[0]["token"] if made else ""
        if made and a.store:
            spark.createDataFrame(made, empty_store(spark).schema).write.mode("append").parquet(a.store)
    done = done.withColumn("token", F.lit(token))
    form = a.format or settings["cli.default_format"]
    text = (done.select("redacted_text") if form == "text" else texts.as_json(done) if form == "json" else texts.as_yaml(done)).first()[0]
    put(text, a.output, "\n" if form == "text" else "")
    if a.stats:
        rows = stats_by_type(done).orderBy("type").collect()
        print(f"Total: {sum(r['n'] for r in rows)}\nToken: {token}", *[f"  {r['type']}: {r['n']}" for r in rows], sep="\n", file=sys.stderr)


def restore(spark: SparkSession, a) -> int:
    token = a.words[0] if a.words else a.token
    if not token and a.token_file:
        with open(a.token_file) as f:
            token = f.read()
    if not (token or "").strip():
        print("no token: give it as an argument, by --token or by --token-file", file=sys.stderr)
        return 1
    row = tokens.restore(spark.createDataFrame([(token.strip(),)], "token string"), store_of(spark, a.store)).first()
    if row["status"] != "restored":
        print("invalid token", file=sys.stderr)
        return 1
    put(row["original_text"], a.output)
    return 0


def engine(spark: SparkSession, a, settings: dict) -> None:
    if a.action == "patterns":
        for d in default_registry().detectors:
            print(f"{d.kind}\t{d.priority}\t{d.regex}")
    elif a.action == "test":
        registry = default_registry().only([a.pattern]) if a.pattern else default_registry()
        row = rewrite_texts(texts.from_arguments(spark, a.words), registry=registry).first()
        print(row["redacted_text"], *[f"  {r['type']}: {r['original']!r} {r['confidence']:.2f} {r['context']!r}" for r in row["redactions"]], sep="\n")
    elif a.action == "cleanup":
        store = store_of(spark, a.store)
        left = tokens.cleanup(store, F.current_timestamp())
        gone = store.count() - left.count()
        if gone:  # a table can't be overwritten while it is read
            left.write.mode("overwrite").parquet(a.store + ".left")
            spark.read.parquet(a.store + ".left").write.mode("overwrite").parquet(a.store)
        print(f"removed {gone}")
    elif a.action == "rotate-keys":
        tokens.rotate_keys(store_of(spark, a.store))
        print("rotated")
    else:
        row = tokens.summary(store_of(spark, a.store)).first()
        print(f"active_patterns: {row['active_patterns']}\ntotal_tokens: {row['total_tokens']}", *[f"  {k}: {v}" for k, v in sorted((row["tokens_by_type"] or {}).items())], sep="\n")
        for k in ("redaction.engine.confidence_threshold", "redaction.engine.max_tokens", "redaction.engine.token_expiry", "redaction.context.analysis_enabled"):
            print(f"{k}: {settings[k]}")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "version":
        print(VERSION)
        return 0
    settings = texts.load_config(a.config)
    spark = spark or SparkSession.builder.appName("sparkveil").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "restore":
        return restore(spark, a)
    (rewrite if a.command == "rewrite" else engine)(spark, a, settings)
    return 0
