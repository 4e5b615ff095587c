import re

import pytest
from pyspark.sql import functions as F

from sparkveil import cli
from sparkveil.functions import strategies as st
from sparkveil.functions.detectors import _NEEDS, PATTERNS, default_registry
from sparkveil.functions.regex import Slow, check, compiled, to_python
from sparkveil.operators import detect, factory, library, tokens
from sparkveil.sources import texts

#: One text that each detector finds, made without the library.
HITS = {
    "email": "a@b.cd", "phone": "555-123-4567", "credit_card": "4111111111111111", "ssn": "123-45-6789", "ip_address": "1.2.3.4", "date": "1/2/1999", "time": "1:02",
    "link": "www.x", "zip_code": "12345-6789", "po_box": "PO Box 1", "btc_address": "1" + "a" * 25, "md5_hex": "a" * 32, "sha1_hex": "b" * 40, "sha256_hex": "c" * 64,
    "guid": "aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa", "isbn": "XXXXXXXXXX-XXX-XXX-XXX", "mac_address": "aa:bb:cc:dd:ee:ff", "iban": "DE00AAAA0000000", "git_repo": "git@a.bc.git",
    "uk_national_insurance": "AB123456C", "uk_nhs_number": "NHS 1234567890", "uk_postcode": "M1 1AA", "uk_phone_number": "+44201234567", "uk_mobile_number": "07123456789",
    "uk_sort_code": "12-34-56", "uk_iban": "GB82WEST12345698765432", "uk_company_number": "12345678", "uk_driving_license": "MORGA657054SM9IJ", "uk_passport_number": "123456789",
}


def test_gates_lose_nothing():
    assert set(HITS) == set(PATTERNS) and set(_NEEDS) <= set(PATTERNS)
    for d in default_registry().detectors:
        found = detect.search(HITS[d.kind], default_registry().only([d.kind]))
        assert [s[4] for s in found] == [HITS[d.kind]], d.kind


@pytest.mark.parametrize(
    "regex, text, hits",
    [
        (r"a(?i)b|c", "aB C ab", ["aB", "C", "ab"]),
        (r"\d+\z", "1 22", ["22"]),
        (r"\d+$", "1 22\n", []),
        (r"(?m)\d+$", "1\n22\n", ["1", "22"]),
        (r"\p{L}+", "été 1", ["été"]),
        (r"[[:alpha:]]+\b", "ab1 cd", ["cd"]),
        (r"[[:^digit:]]+", "ab1", ["ab"]),
        (r"(?i)k+", "kKK", ["kKK"]),
        (r"\Qa.b\E+", "a.bb axb", ["a.bb"]),
        (r"(?U)a+", "aaa", ["a", "a", "a"]),
        (r"\x{e9}t", "ét", ["ét"]),
        (r"x{,2}", "x{,2}", ["x{,2}"]),
        (r"(?P<n>a)(?:b|c)+", "abcb", ["abcb"]),
        (r"a\sb", "a\x0bb a b", ["a b"]),
        (r"\w+", "naïve", ["na", "ve"]),
        (r"\pL\d\b", "é1 é٣", ["é1"]),
    ],
)
def test_dialect(regex, text, hits):
    check(regex)
    assert [m.group() for m in compiled(regex)(text)] == hits


@pytest.mark.parametrize("regex", ["(?=x)", r"(a)\1", "a++", "a**", "a{2}{3}", "[a", "a)", "(a", r"\Z", "a{1001}", "(?x)a", "a{3,2}", "(?<=a)b", "*a", r"[[:nope:]]"])
def test_refused(regex):
    with pytest.raises(ValueError):
        check(regex)


def test_patterns_of_users_end_no_executor(spark, monkeypatch):
    registry = default_registry().register("deep", "(a|b)+c")
    df = spark.createDataFrame([("ab" * 20_000 + "c",)], "text string")
    assert detect.rewrite_texts(df, registry=registry).first().redacted_text == "[REDACTED]"
    monkeypatch.setattr("sparkveil.functions.regex.SECONDS", 0.2)
    with pytest.raises(Slow):
        list(compiled("(a|aa)+$")("a" * 60 + "b"))


def test_time_is_linear_in_spans():
    import time

    took = []
    for n in (1_000, 8_000):
        text = " 123-45-6789 é" * n
        at = time.perf_counter()
        spans = detect.fold(detect.search(text, default_registry()))
        out = detect.found(text, spans)
        took.append(time.perf_counter() - at)
        assert len(out["spans"]) == n and "".join(g + (s["original"] if s else "") for g, s in zip(out["gaps"], [*out["spans"], None])) == text
    assert took[1] < 30 * took[0]


def test_once_a_text_and_no_clashes(spark):
    df = spark.createDataFrame([("a@b.com 123-45-6789", 1, 2, 3)], "text string, _text int, row int, parts int")
    done = detect.rewrite_texts(df)
    assert done.columns == ["text", "_text", "row", "parts", "redacted_text", "redactions", "n_spans"] and done.first()["_text"] == 1
    plan = tokens.stats(tokens.issue(done, "text", F.current_timestamp(), salt="s"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1


def test_factory(spark):
    make = factory.ProviderFactory()
    df = spark.createDataFrame([("My email is test@example.com",)], "text string")
    for provider in (make.basic(), make.policy_aware(factory.ProviderConfig(max_text_length=500)), factory.create_basic(), factory.create_policy_aware()):
        assert provider.rewrite(df).first().redacted_text == "My email is [EMAIL_REDACTED]"
    assert make.policy_aware().apply_rules(df, []).first().n_spans == 1
    with pytest.raises(TypeError):
        make.basic().apply_rules(df, [])
    with pytest.raises(NotImplementedError):
        make.language_model()
    with pytest.raises(ValueError, match="unsupported provider type: x"):
        make.create("x")
    assert make.supported_types() == ("basic", "policy_aware") and make.merged(None) == factory.DEFAULT
    assert make.merged(factory.ProviderConfig(default_ttl_seconds=5)) == factory.ProviderConfig("basic", 1_048_576, 5)
    make.validate(factory.DEFAULT)
    for bad in (None, factory.ProviderConfig("llm", 1, 1), factory.ProviderConfig("basic", 0, 1), factory.ProviderConfig("basic", 1, -1)):
        with pytest.raises(ValueError):
            make.validate(bad)
    assert factory.llm_fault(factory.LlmConfig("p", "m", 2.0, 0)) is None
    assert [factory.llm_fault(c) for c in (factory.LlmConfig(), factory.LlmConfig("p"), factory.LlmConfig("p", "m", 3), factory.LlmConfig("p", "m", 1, -1))] == ["LLM provider cannot be empty", "LLM model cannot be empty", "temperature must be between 0 and 2", "max_tokens cannot be negative"]


YAML = """# a library
version: "1.0"
framework: "F"
description: 'it''s one'
metadata:
  compliance_frameworks: ["A", "B"]
patterns:
  # first
  - id: "n"
    name: "Number"
    category: c
    regex: '\\b\\d{3}\\b'   # three
    confidence: 0.95
    examples:
      - "123"
      - "12: no"
    replacement: "[N]"
    enabled: true
  - id: m
    regex: "a\\\\.b"
    confidence: .5
    enabled: false
"""


def test_library_files():
    got = library.parse(YAML)
    assert got["description"] == "it's one" and got["metadata"] == {"compliance_frameworks": ["A", "B"]}
    assert got["patterns"][0] == {"id": "n", "name": "Number", "category": "c", "regex": r"\b\d{3}\b", "confidence": 0.95, "examples": ["123", "12: no"], "replacement": "[N]", "enabled": True}
    assert got["patterns"][1]["regex"] == r"a\.b" and got["patterns"][1]["confidence"] == 0.5
    out = library.validate(got)
    assert out["statistics"]["coverage"] == {"categories": 2, "compliance_frameworks": ["A", "B"]}
    assert ("warning", "EXAMPLE_MISMATCH", "2") in out["warnings"] and not out["valid"]
    for bad in ("", "- a\n- b", "a: 1\n   b: 2", "\ta: 1", "a: 'x"):
        with pytest.raises(ValueError, match="YAML_PARSE_ERROR"):
            library.parse(bad)


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("redaction:\n  engine:\n    max_tokens: 5\n    enabled_types:\n      - email\ncli:\n  batch_size: 9\n")
    got = texts.load_config(str(path), {"SPARKVEIL_CLI_BATCH_SIZE": "7", "SPARKVEIL_CLI_PROGRESS_ENABLED": "false"})
    assert len(texts.DEFAULTS) == 15
    assert (got["redaction.engine.max_tokens"], got["redaction.engine.enabled_types"], got["cli.batch_size"], got["cli.progress_enabled"], got["logging.level"]) == (5, ["email"], 7, False, "info")


def test_formats(spark):
    import json

    done = detect.rewrite_texts(spark.createDataFrame([('x "a@b.com"',), ("none",)], "text string"))
    one, none = (json.loads(r.value) for r in texts.as_json(done).collect())
    assert one["original_text"] == 'x "a@b.com"' and one["token"] == "" and one["redactions"][0]["replacement"] == "[EMAIL_REDACTED]" and none["redactions"] == []
    for want, row in zip((one, none), texts.as_yaml(done).collect()):
        got = library.parse(row.value)
        assert got["redacted_text"] == want["redacted_text"] and got["redaction_count"] == len(want["redactions"])
        assert [(r["type"], r["original"], r["start"]) for r in got["redactions"]] == [(r["type"], r["original"], r["start"]) for r in want["redactions"]]


def test_command_line(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli.main(["rewrite", "mail", "a@b.com", "--format", "json", "--reversible", "--store", store, "--stats"], spark) == 0
    import json

    token = json.loads(capsys.readouterr().out)["token"]
    assert len(token) == 32
    assert cli.main(["restore", token, "--store", store], spark) == 0 and capsys.readouterr().out == "mail a@b.com"
    assert cli.main(["restore", "--token", "no", "--store", store], spark) == 1 and cli.main(["restore", "--store", store], spark) == 1
    capsys.readouterr()
    cli.main(["engine", "stats", "--store", store], spark)
    assert "active_patterns: 29\ntotal_tokens: 1\n  email: 1" in capsys.readouterr().out
    cli.main(["engine", "cleanup", "--store", store], spark)
    cli.main(["engine", "rotate-keys"], spark)
    cli.main(["engine", "test", "1.2.3.4"], spark)
    cli.main(["engine", "patterns"], spark)
    out = capsys.readouterr().out
    assert "removed 0\nrotated\n[IP_ADDRESS_REDACTED]\n" in out and "uk_sort_code\t90" in out
    out_file = tmp_path / "o.txt"
    (tmp_path / "in.txt").write_text("x 1.2.3.4\ny")
    cli.main(["rewrite", "--file", str(tmp_path / "in.txt"), "--output", str(out_file)], spark)
    assert out_file.read_text() == "x [IP_ADDRESS_REDACTED]\ny" and out_file.stat().st_mode & 0o777 == 0o600


def test_strategies_by_hand(spark):
    """Values that were worked out here from the rules, not by the strategies' own SQL."""
    import hashlib

    df = spark.createDataFrame([("a@b.com",)], "t string")
    h = hashlib.sha256(b"a@b.com:email:default_salt_change_in_production").hexdigest()
    assert df.select(st.ConsistentHash().column("t", "'email'")).first()[0] == f"user_{h[:8]}@redacted.com"

    def drawn(seed, kind, text, place, n):
        return int(hashlib.sha256(f"{seed}|{kind}|{text}|{place}".encode()).hexdigest()[:8], 16) % n

    got = df.select(st.FakeData().column("t", "'phone'", "7"), st.FakeData().column("t", "'date_of_birth'", "7"), st.FormatPreserving().column("'123-45-6789'", "'ssn'", "7"), st.Semantic().column("t", "'credit_card'", "7")).first()
    assert got[0] == f"555-{drawn(7, 'phone', 'a@b.com', 'x', 1000):03d}-{drawn(7, 'phone', 'a@b.com', 'y', 10000):04d}"
    assert got[1] == f"{1970 + drawn(7, 'date_of_birth', 'a@b.com', 'y', 50)}-{1 + drawn(7, 'date_of_birth', 'a@b.com', 'm', 12):02d}-{1 + drawn(7, 'date_of_birth', 'a@b.com', 'd', 28):02d}"
    assert got[2] == f"{100 + drawn(7, 'ssn', '123-45-6789', 'a', 900)}-{drawn(7, 'ssn', '123-45-6789', 'b', 100):02d}-{drawn(7, 'ssn', '123-45-6789', 'c', 10000):04d}"
    assert got[3] == f"4111-1111-1111-{drawn(7, 'credit_card', 'a@b.com', 'c', 10000):04d}"
    assert [len(x) for x in (st.FIRST, st.LAST, st.USERS, st.MAIL, st.STREETS, st.CITIES, st.STATES, st.COUNTRIES, st.FIRMS, st.SUFFIX)] == [32, 32, 10, 10, 17, 18, 18, 18, 12, 12]
    assert st.StrategyRegistry().score(st.FormatPreserving(), "SSN", accuracy="HIGH", speed="Fast") == 15


def test_token_summary(spark):
    df = detect.rewrite_texts(spark.createDataFrame([("a@b.com",), ("555-123-4567",)], "text string"))
    row = tokens.summary(tokens.issue(df, "text", F.current_timestamp(), salt="s")).first()
    assert (row.total_tokens, row.active_patterns, row.tokens_by_type) == (2, 29, {"email": 1, "phone": 1})
    assert tokens.summary(tokens.issue(df.limit(0), "text", F.current_timestamp())).first().total_tokens == 0
    assert to_python("a|b") == "a|b"
