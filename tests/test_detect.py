import itertools
import os
import re

import pytest
from hypothesis import given, settings, strategies as hs

from sparkveil.functions.detectors import default_registry, placeholder
from sparkveil.functions.regex import check, to_java
from sparkveil.operators import detect

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: text, rewritten text
CASES = [
    ("Contact me at test@example.com", "Contact me at [EMAIL_REDACTED]"),
    ("SSN: 123-45-6789", "SSN: [SSN_REDACTED]"),
    ("Meeting at 14:30 PM", "Meeting at [TIME_REDACTED]"),
    ("see 14:30 tomorrow", "see [TIME_REDACTED]tomorrow"),
    ("Hello, my email is john.doe@example.com and my phone is (555) 123-4567", "Hello, my email is [EMAIL_REDACTED] and my phone is ([PHONE_REDACTED]"),
    ("é123-45-6789 ü", "é[SSN_REDACTED] ü"),
    ("naïve 4111-1111-1111-1111é", "naïve [CREDIT_CARD_REDACTED]é"),
    ("日本 test@example.com日本", "日本 [EMAIL_REDACTED]日本"),
    ("Ａ12-34-56", "Ａ[UK_SORT_CODE_REDACTED]"),
    ("a@b.c|d e", "[EMAIL_REDACTED] e"),
    ("x 11112222333344445555666677778888 y", "x [BTC_ADDRESS_REDACTED] y"),
    ("Clone https://github.com/acme/repo.git now", "Clone [GIT_REPO_REDACTED] now"),
    ("ISBN 978-0-306-40615-7", "ISBN 978-0-306-40615-7"),
    ("", ""),
    (None, None),
    ("https://" + "ab." * 2000 + "com/x", "[LINK_REDACTED]"),
]


def test_cases(spark):
    rows = detect.rewrite_texts(spark.createDataFrame(CASES, "text string, want string")).collect()
    assert [r.redacted_text for r in rows] == [r.want for r in rows]


def test_fixture_table(spark):
    found = [re.match(r"\| \d+ \| (\w+) \| `(.*)` \| (\d) \| `(.*)` \|$", line.strip()) for line in open(f"{HERE}/FIXTURES.md")]
    rows = [(m[1], m[2], int(m[3]), m[4]) for m in found if m]
    assert len(rows) == 58
    for r in detect.rewrite_texts(spark.createDataFrame(rows, "type string, text string, n int, want string")).collect():
        assert r.redacted_text == r.want and sum(x.type == r.type for x in r.redactions) == r.n


def test_offsets_are_bytes_and_descend(spark):
    r = detect.rewrite_texts(spark.createDataFrame([("é a@b.com ü 123-45-6789",)], "text string")).first()
    assert [(x.type, x.start, x.end) for x in r.redactions] == [("ssn", 14, 25), ("email", 3, 10)]


def plain_fold(spans):
    kept = []
    for s in sorted(spans):
        hit = [k for k in kept if s[0] < k[0] - k[1] and k[0] < s[0] - s[1]]
        if all((s[1], s[2]) < (k[1], k[2]) for k in hit):
            kept = [k for k in kept if k not in hit] + [s]
    return kept


@settings(max_examples=15, deadline=None)
@given(hs.lists(hs.lists(hs.tuples(hs.integers(0, 20), hs.integers(-8, -1), hs.sampled_from([-30, -50, -100])), max_size=8), min_size=1, max_size=10))
def test_resolution_against_all_pairs(spark, groups):
    from pyspark.sql import functions as F

    data = [(i, [(a, n, p, f"t{k}", "", "", 0.5) for k, (a, n, p) in enumerate(g)]) for i, g in enumerate(groups)]
    df = spark.createDataFrame(data, f"i int, c {detect._SPAN}").select("i", detect.resolve(F.array_sort("c")).alias("r"))
    for r in df.collect():
        want = plain_fold([(a, n, p, t) for a, n, p, t, *_ in data[r.i][1]])
        assert [(x.start, x.nlen, x.nprio, x.type) for x in r.r] == want
        assert all(a.start - a.nlen <= b.start for a, b in itertools.pairwise(r.r))


def test_modes_and_limits(spark):
    df = spark.createDataFrame([("to a@b.com",)], "text string")
    assert detect.rewrite_texts(df, mode="mask").first().redacted_text == "to [EMAIL_REDACTED]"
    assert detect.rewrite_texts(df, mode="mask", effective_modes=True).first().redacted_text == "to *******"
    assert detect.rewrite_texts(df, mode="remove", effective_modes=True).first().redacted_text == "to "
    r = detect.rewrite_texts(df, registry=default_registry(max_text_length=5), strict=False).first()
    assert r.redacted_text is None and r.too_long
    with pytest.raises(Exception, match="maximum length"):
        detect.rewrite_texts(df, registry=default_registry(max_text_length=5)).collect()


def test_registering():
    assert len(default_registry().detectors) == 29
    assert len(default_registry().register("email", "x").detectors) == 29
    for bad in ("[invalid regex", "(?=x)", r"(a)\1", "a++"):
        with pytest.raises(ValueError):
            check(bad)
    assert placeholder("unknown_type") == "[REDACTED]" and placeholder("md5_hex") == "[MD5_HASH_REDACTED]"
    assert to_java(r"\bA\s") == "(?<![0-9A-Za-z_])A[\\t\\n\\f\\r ]"
