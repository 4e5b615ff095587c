"""Texts in, results out."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Settings and their defaults.
DEFAULTS = {
    "redaction.engine.enabled_types": ["email", "phone", "ssn", "credit_card", "name", "address", "date_time", "link", "zip_code", "po_box", "btc_address", "md5_hex", "sha1_hex", "sha256_hex", "guid", "isbn", "mac_address", "iban", "git_repo"],
    "redaction.engine.confidence_threshold": 0.8,
    "redaction.engine.max_tokens": 1000,
    "redaction.engine.token_expiry": "24h",
    "redaction.context.analysis_enabled": True,
    "redaction.context.domains": ["medical", "financial", "legal", "general"],
    "encryption.key_rotation_interval": "720h",
    "encryption.pbkdf2_iterations": 10000,
    "encryption.key_version": 1,
    "logging.level": "info",
    "logging.format": "json",
    "logging.output": "stdout",
    "cli.default_format": "text",
    "cli.batch_size": 100,
    "cli.progress_enabled": True,
}


def from_arguments(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(" ".join(words),)], "text string")


def from_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """One text a file, or one a line."""
    return spark.read.text(path, wholetext=whole).select(F.col("value").alias("text"))


def from_lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Standard input: all lines are one text."""
    return spark.createDataFrame([("\n".join(lines),)], "text string")


def _quoted(text: Column) -> Column:
    """A string as JSON writes it, which YAML reads too."""
    return F.regexp_replace(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v"))), r'^\{"v":|\}$', "")


def as_json(rewritten: DataFrame, text_col: str = "text") -> DataFrame:
    """A JSON document for each result: original and rewritten text, token (empty without a column of this name), the number of spans and the spans."""
    token = F.col("token") if "token" in rewritten.columns else F.lit("")
    spans = F.transform("redactions", lambda s: F.struct(*[s[k].alias(k) for k in ("type", "original", "replacement", "start", "end", "confidence", "context")]))
    return rewritten.select(F.to_json(F.struct(F.col(text_col).alias("original_text"), "redacted_text", token.alias("token"), F.col("n_spans").alias("redaction_count"), spans.alias("redactions"))).alias("value"))


def as_yaml(rewritten: DataFrame, text_col: str = "text") -> DataFrame:
    """The same as a YAML document."""
    token = F.col("token") if "token" in rewritten.columns else F.lit("")

    def item(s: Column) -> Column:
        fields = [("type", _quoted(s["type"])), ("original", _quoted(s["original"])), ("replacement", _quoted(s["replacement"])), ("start", s["start"].cast("string")), ("end", s["end"].cast("string")), ("confidence", F.format_number(s["confidence"], 2)), ("context", _quoted(s["context"]))]
        return F.concat(F.lit("  - "), F.concat_ws("\n    ", *[F.concat(F.lit(k + ": "), v) for k, v in fields]), F.lit("\n"))

    head = [("original_text", _quoted(F.col(text_col))), ("redacted_text", _quoted(F.col("redacted_text"))), ("token", _quoted(token)), ("redaction_count", F.col("n_spans").cast("string"))]
    body = F.when(F.size("redactions") > 0, F.concat(F.lit("redactions:\n"), F.array_join(F.transform("redactions", item), ""))).otherwise(F.lit("redactions: []\n"))
    return rewritten.select(F.concat(*[F.concat(F.lit(k + ": "), v, F.lit("\n")) for k, v in head], body).alias("value"))


def write(rewritten: DataFrame, path: str, form: str = "text", text_col: str = "text") -> None:
    """Text, JSON, YAML or Parquet files below ``path``."""
    if form == "parquet":
        rewritten.write.parquet(path)
        return
    frames = {"text": lambda d: d.select(F.col("redacted_text").alias("value")), "json": lambda d: as_json(d, text_col), "yaml": lambda d: as_yaml(d, text_col)}
    if form not in frames:
        raise ValueError(f"unsupported output format: {form}")
    frames[form](rewritten).write.text(path)


def _as(default: object, value: str) -> object:
    """A variable's text as the kind of the default."""
    if isinstance(default, bool):
        if value.lower() not in ("1", "t", "true", "0", "f", "false"):
            raise ValueError(f"not a truth value: {value}")
        return value.lower() in ("1", "t", "true")
    if isinstance(default, list):
        return [x.strip() for x in value.split(",") if x.strip()]
    return type(default)(value)


def load_config(path: str | None = None, environ: dict | None = None) -> dict:
    """Settings: ``SPARKVEIL_*`` variables (dots are underscores) over a JSON or YAML file over the defaults. A variable with no text does not count."""
    out = dict(DEFAULTS)
    if path:
        from ..operators.library import parse

        with open(path) as f:
            text = f.read()
        tree = json.loads(text) if path.endswith(".json") else parse(text)

        def walk(node: dict, at: str) -> None:
            for k, v in node.items():
                walk(v, f"{at}{k}.") if isinstance(v, dict) else out.__setitem__(f"{at}{k}".lower(), v)

        walk(tree, "")
    for k in out:
        value = (os.environ if environ is None else environ).get("SPARKVEIL_" + k.upper().replace(".", "_"))
        if value:
            out[k] = _as(DEFAULTS.get(k, ""), value)
    return out
