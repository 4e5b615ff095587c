import datetime

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import strategies as st
from sparkveil.operators import detect, library, policy, tokens
from sparkveil.plans.libraries import LIBRARIES
from sparkveil.sources import texts


def test_tokens(spark):
    df = detect.rewrite_texts(spark.createDataFrame([("Email: test@example.com, Phone: 555-123-4567",), ("nothing",)], "text string"))
    now = F.lit(datetime.datetime(2024, 1, 1))
    store = tokens.issue(df, "text", now, salt="s")
    row = store.collect()
    assert len(row) == 1 and row[0].redaction_type == "phone" and (row[0].expires - row[0].created).days == 1
    back = tokens.restore(store.select("token").union(spark.createDataFrame([("no",)], "token string")), store).collect()
    assert {r.status for r in back} == {"restored", "invalid"}
    assert tokens.cleanup(store, F.lit(datetime.datetime(2024, 1, 2))).count() == 1
    assert tokens.cleanup(store, F.lit(datetime.datetime(2024, 1, 3))).count() == 0


def test_policy(spark):
    faults = policy.validation_errors(spark.createDataFrame([("", ["x"], "replace", 1), ("b", [], "mask", -1), ("c", ["x"], "invalid", 0)], "name string, patterns array<string>, mode string, priority int"))
    assert sorted(r.code for r in faults.collect()) == ["EMPTY_RULE_NAME", "INVALID_MODE", "INVALID_PRIORITY", "NO_PATTERNS"]
    df = spark.createDataFrame([("id ZZ-1 and a@b.com", "ann")], "text string, who string")
    rule = policy.Rule("codes", (r"ZZ-\d",), priority=9, conditions=(policy.Condition("user_id", "eq", "ann"),))
    assert policy.apply_rules(df, [rule]).first().redacted_text == "id ZZ-1 and [EMAIL_REDACTED]"
    assert policy.apply_rules(df, [rule], user_id=F.col("who"), effective=True).first().redacted_text == "id [CODES_REDACTED] and [EMAIL_REDACTED]"
    assert policy.apply_rules(df, [rule], user_id=F.lit("bob"), effective=True).first().redacted_text == "id ZZ-1 and [EMAIL_REDACTED]"


def test_strategies():
    r = st.StrategyRegistry()
    assert r.default_for("SSN").name == "format_preserving" and r.default_for("date").name == "semantic"
    assert r.best_for("phone", ("reversible",)).name == "format_preserving"
    with pytest.raises(KeyError):
        r.get("none")
    with pytest.raises(ValueError):
        r.register(None)


def test_strategy_shapes(spark):
    df = spark.createDataFrame([("123-45-6789", "ssn"), ("(555) 123-4567", "phone"), ("2020-01-02", "date"), ("Ab1-é", "generic")], "t string, k string")
    out = [r[0] for r in df.select(st.FormatPreserving().column("t", "k")).collect()]
    import re

    for value, shape in zip(out, (r"[1-9]\d\d-\d\d-\d{4}", r"\(555\) \d{3}-\d{4}", r"(19[7-9]\d|20[01]\d)-\d\d-\d\d", r"[A-Z][a-z]\d-é")):
        assert re.fullmatch(shape, value)


def test_library(spark):
    good = {"version": "1", "framework": "f", "description": "d", "patterns": [{"id": "a", "name": "a", "category": "c", "regex": r"\d+", "confidence": 0.95, "examples": ["x", "12"], "replacement": "[A]", "enabled": True}]}
    out = library.validate(good)
    assert out["valid"] and out["warnings"] == [("warning", "EXAMPLE_MISMATCH", "1")] and out["statistics"]["compliance_score"] == 1.0
    bad = library.validate({"patterns": [{"id": "a", "regex": "["}, {"id": "a", "confidence": 2}]})
    codes = [f[1] for f in bad["errors"]]
    assert not bad["valid"] and {"DUPLICATE_ID", "INVALID_REGEX", "INVALID_CONFIDENCE", "MISSING_NAME"} <= set(codes)
    assert sum(map(len, LIBRARIES.values())) == 64
    for rows in LIBRARIES.values():
        for _, _, _, _, regex in rows:
            library.check(regex)


def test_sources(spark, tmp_path):
    red = detect.rewrite_texts(texts.from_lines(spark, ["a@b.com", "x"]))
    texts.write(red, str(tmp_path / "j"), "json")
    assert '"redaction_count":1' in spark.read.text(str(tmp_path / "j")).first().value
    texts.write(red, str(tmp_path / "y"), "yaml")
    assert texts.load_config(environ={"SPARKVEIL_CLI_BATCH_SIZE": "7"})["cli.batch_size"] == 7
    with pytest.raises(ValueError):
        texts.write(red, str(tmp_path / "z"), "xml")


def test_stream(spark, tmp_path):
    from sparkveil.streaming import stream

    spark.createDataFrame([("a@b.com",), ("none",)], "text string").write.parquet(str(tmp_path / "in"))
    live = stream.redacted_stream(spark, str(tmp_path / "in"), "text string")
    q = stream.token_sink(live, str(tmp_path / "tokens"), str(tmp_path / "cp"), salt="s")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "tokens")).count() == 1
