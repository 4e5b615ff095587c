"""Queries over the driver's tables with the SQL that must give the same rows.

Detectors that plain documents never trigger are run over texts made from the keys of
``orders``, by the same expression in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import strategies as st
from ..functions.detectors import default_registry, placeholder
from ..operators import detect, library, policy, tokens
from .libraries import LIBRARIES

SPARK, DUCK = st.Dialect(True), st.Dialect(False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _p(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


_K, _H = "o_orderkey", "md5(CAST(o_orderkey AS STRING))"
_S = "CAST(sum_hash AS STRING)"
#: What a text is made of, by detector; both dialects read it. ``sum_hash`` is SHA-256 of the key.
_VALUES = {
    "email": f"concat('user', CAST({_K} AS STRING), '@mail', CAST({_K} % 7 AS STRING), '.example.com')",
    "phone": f"concat('555-', {_p(_K + ' % 900 + 100', 3)}, '-', {_p(_K + ' % 10000', 4)})",
    "credit_card": f"concat('4111 ', {_p(_K + ' % 10000', 4)}, ' ', {_p('o_custkey % 10000', 4)}, ' 1111')",
    "ssn": f"concat({_p(_K + ' % 1000', 3)}, '-', {_p('o_custkey % 100', 2)}, '-', {_p(_K + ' % 10000', 4)})",
    "ip_address": f"concat('10.', CAST({_K} % 256 AS STRING), '.', CAST(o_custkey % 256 AS STRING), '.7')",
    "date": f"concat({_p('month(o_orderdate)', 2)}, '/', {_p('day(o_orderdate)', 2)}, '/', CAST(year(o_orderdate) AS STRING))",
    "time": f"concat({_p(_K + ' % 24', 2)}, ':', {_p('o_custkey % 60', 2)})",
    "link": f"concat('https://site', CAST({_K} AS STRING), '.example.org/p?q=', CAST(o_custkey AS STRING))",
    "zip_code": f"concat({_p(_K + ' % 100000', 5)}, '-', {_p('o_custkey % 10000', 4)})",
    "po_box": f"concat('PO Box ', CAST({_K} AS STRING))",
    "btc_address": f"concat('1', substr(replace({_H}, '0', 'z'), 1, 28))",
    "md5_hex": _H,
    "sha1_hex": f"concat({_H}, substr({_H}, 1, 8))",
    "sha256_hex": f"concat({_H}, {_H})",
    "guid": f"concat(substr({_H}, 1, 8), '-', substr({_H}, 9, 4), '-', substr({_H}, 13, 4), '-', substr({_H}, 17, 4), '-', substr({_H}, 21, 12))",
    "isbn": f"concat('ISBN ', {_p(_K, 10)}, '-', {_p('o_custkey % 1000', 3)}, '-001-002')",
    "mac_address": f"concat(substr({_H}, 1, 2), ':', substr({_H}, 3, 2), ':', substr({_H}, 5, 2), ':', substr({_H}, 7, 2), ':', substr({_H}, 9, 2), ':', substr({_H}, 11, 2))",
    "iban": f"concat('DE', {_p(_K + ' % 100', 2)}, {_p('o_custkey % 10000', 4)}, {_p(_K + ' % 10000000', 7)}, '00')",
    "git_repo": f"concat('https://git.example.com/u', CAST(o_custkey AS STRING), '/r', CAST({_K} AS STRING), '.git')",
    "uk_national_insurance": f"concat('AB', {_p(_K + ' % 1000000', 6)}, 'C')",
    "uk_nhs_number": f"concat('NHS number: ', {_p(_K + ' % 1000', 3)}, ' ', {_p('o_custkey % 1000', 3)}, ' ', {_p(_K + ' % 10000', 4)})",
    "uk_postcode": f"concat('SW', CAST({_K} % 10 AS STRING), 'A ', CAST(o_custkey % 10 AS STRING), 'AA')",
    "uk_phone_number": f"concat('+44 20 ', {_p(_K + ' % 10000', 4)}, ' ', {_p('o_custkey % 10000', 4)})",
    "uk_mobile_number": f"concat('07', {_p(_K + ' % 1000000000', 9)})",
    "uk_sort_code": f"concat({_p(_K + ' % 100', 2)}, '-', {_p('o_custkey % 100', 2)}, '-56')",
    "uk_iban": f"concat('GB82 WEST ', {_p(_K + ' % 10000', 4)}, ' ', {_p('o_custkey % 10000', 4)}, ' 7654 32')",
    "uk_company_number": f"concat('Company No: ', {_p(_K + ' % 100000000', 8)})",
    "uk_driving_license": f"concat('MORGA', {_p(_K + ' % 1000000', 6)}, 'SM9IJ')",
    "uk_passport_number": f"concat('Passport No: ', {_p(_K + ' % 1000000000', 9)})",
}
_NAMES = list(_VALUES)
_GLUE = "CASE o_custkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'é' WHEN 2 THEN ' ' WHEN 3 THEN ',' ELSE ': ' END"


def made_text(kind: str) -> str:
    """A text with a detector's value and the next one's, between signs that border it now and then."""
    other = _VALUES[_NAMES[(_NAMES.index(kind) + 1) % len(_NAMES)]]
    return f"concat('Record ', {_GLUE}, {_VALUES[kind]}, CASE WHEN o_orderkey % 3 = 0 THEN 'ü' ELSE ' and ' END, {other}, '. End')"


def mixed_text() -> str:
    """A text with five values, chosen by key, that touch and overlap each other in part."""
    picks = [f"CASE (o_orderkey + {7 * k}) % 29 " + " ".join(f"WHEN {i} THEN {_VALUES[n]}" for i, n in enumerate(_NAMES)) + " END" for k in range(4)]
    return "concat('A ', " + ", CASE WHEN o_custkey % 4 = 0 THEN '-' ELSE ' ' END, ".join(picks) + ", ' end é')"


def _quote(regex: str) -> str:
    return regex.replace("'", "''")


def _duck_spans(kind: str, regex: str, rank: int, text: str = "t", shown: str | None = None) -> str:
    m, g = f"regexp_extract_all({text}, '{_quote(regex)}', 0)", f"string_split_regex({text}, '{_quote(regex)}')"
    start = f"CAST(list_sum([length(x) for x in {g}[1:i]]) + coalesce(list_sum([length(x) for x in {m}[1:i - 1]]), 0) AS INTEGER)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: struct_pack(start := {start}, nlen := CAST(-length({m}[i]) AS INTEGER), nprio := -{rank}, type := '{kind}', original := {m}[i], placeholder := '{shown or placeholder(kind)}'))"


def _duck_candidates(source: str, keys: str) -> str:
    """Rows (keys, t, c) with all detectors' sorted candidates of texts."""
    every = ", ".join(f"CASE WHEN regexp_matches(t, '{_quote(d.regex)}') THEN {_duck_spans(d.kind, d.regex, d.priority)} ELSE [] END" for d in default_registry().detectors)
    return f"SELECT {keys}, t, list_sort(flatten([{every}])) AS c FROM ({source})"


def _duck_resolved(source: str, keys: str) -> str:
    last = "a[len(a)]"
    free, beats = f"b[1].start >= {last}.start - {last}.nlen", f"(b[1].nlen < {last}.nlen OR (b[1].nlen = {last}.nlen AND b[1].nprio < {last}.nprio))"
    fold = f"list_reduce(list_transform(c, lambda x: [x]), lambda a, b: CASE WHEN {free} THEN a || b WHEN {beats} THEN a[1:len(a) - 1] || b ELSE a END)"
    return f"SELECT {keys}, t, CASE WHEN len(c) = 0 THEN [] ELSE {fold} END AS r FROM ({_duck_candidates(source, keys)})"


def _duck_rewritten(source: str, keys: str) -> str:
    parts = "list_transform(range(1, len(r) + 1), lambda i: substr(t, CASE WHEN i = 1 THEN 1 ELSE r[i - 1].start - r[i - 1].nlen + 1 END, r[i].start - CASE WHEN i = 1 THEN 0 ELSE r[i - 1].start - r[i - 1].nlen END) || r[i].placeholder)"
    return f"SELECT {keys}, CASE WHEN len(r) = 0 THEN t ELSE array_to_string({parts}, '') || substr(t, r[len(r)].start - r[len(r)].nlen + 1) END AS redacted_text, CAST(len(r) AS INTEGER) AS n_spans FROM ({_duck_resolved(source, keys)})"


def _made(spark, sf_dir, expr):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(expr).alias("t"))


_MADE = "SELECT o_orderkey, {} AS t FROM orders"
_DOCS = "SELECT doc_id, lang, source, text AS t FROM documents"


def _detect(kind: str):
    def query(spark, sf_dir):
        d = next(d for d in default_registry().detectors if d.kind == kind)
        return _made(spark, sf_dir, made_text(kind)).select("o_orderkey", F.explode(detect.matches(F.col("t"), d)).alias("hit"))

    regex = next(d.regex for d in default_registry().detectors if d.kind == kind)
    return query, f"SELECT o_orderkey, unnest(regexp_extract_all(t, '{_quote(regex)}', 0)) AS hit FROM ({_MADE.format(made_text(kind))})"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def spans_all(spark, sf_dir):
    c = _made(spark, sf_dir, mixed_text()).select("o_orderkey", F.explode(detect.candidates(F.col("t"), default_registry())).alias("s"))
    return c.select("o_orderkey", "s.type", "s.start", (F.col("s.start") - F.col("s.nlen")).alias("end"), "s.original")


def resolve_overlaps(spark, sf_dir):
    c = _made(spark, sf_dir, mixed_text()).select("o_orderkey", F.explode(detect.resolve(detect.candidates(F.col("t"), default_registry()))).alias("s"))
    return c.select("o_orderkey", "s.type", "s.start", (F.col("s.start") - F.col("s.nlen")).alias("end"))


def rewrite_mixed(spark, sf_dir):
    return detect.rewrite_texts(_made(spark, sf_dir, mixed_text()), "t").select("o_orderkey", "redacted_text", "n_spans")


def rewrite_documents(spark, sf_dir):
    return detect.rewrite_texts(_docs(spark, sf_dir)).select("doc_id", "redacted_text", "n_spans")


def context_window(spark, sf_dir):
    r = detect.rewrite_texts(_made(spark, sf_dir, "concat('Some words before ', " + _VALUES["email"] + ", ' and some words after')"), "t")
    return detect.explode_spans(r, "o_orderkey").select("o_orderkey", "type", "start", "end", "context")


def stats_by_type(spark, sf_dir):
    return detect.stats_by_type(detect.rewrite_texts(_docs(spark, sf_dir)))


def stats_by_type_lang(spark, sf_dir):
    return detect.stats_by_type(detect.rewrite_texts(_docs(spark, sf_dir)), "lang")


def stats_by_source(spark, sf_dir):
    return detect.rewrite_texts(_docs(spark, sf_dir)).groupBy("source").agg(F.sum("n_spans").cast("bigint").alias("n_spans"), F.count("*").alias("n_docs"))


def top_docs(spark, sf_dir):
    return detect.rewrite_texts(_docs(spark, sf_dir)).select("doc_id", "n_spans").orderBy(F.desc("n_spans"), "doc_id").limit(20)


def rewrite_conversations(spark, sf_dir):
    return detect.rewrite_texts(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "redacted_text", "n_spans")


def custom_registered(spark, sf_dir):
    registry = default_registry().register("order_id", r"\bORD-\d{6}\b")
    return detect.rewrite_texts(_made(spark, sf_dir, f"concat('Order ORD-', {_p(_K + ' % 1000000', 6)}, ' is due')"), "t", registry).select("o_orderkey", "redacted_text")


def custom_request(spark, sf_dir):
    r = detect.rewrite_texts(_made(spark, sf_dir, f"concat('Ticket T', {_p(_K + ' % 10000', 4)})"), "t", custom=(detect.CustomPattern("ticket", r"T\d{4}", confidence=0.5),))
    return detect.explode_spans(r, "o_orderkey", "redacted_text").select("o_orderkey", "redacted_text", "type", "start", "replacement", "confidence")


def mode_mask(spark, sf_dir):
    return detect.rewrite_texts(_made(spark, sf_dir, "concat('Mail ', " + _VALUES["email"] + ")"), "t", mode="mask", effective_modes=True).select("o_orderkey", "redacted_text")


def _strategy(strategy, kind: str, text: str):
    def query(spark, sf_dir):
        base = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("t"), F.lit(kind).alias("k"))
        return base.select("o_orderkey", strategy.column("t", "k", "7").alias("replaced"))

    return query, f"SELECT o_orderkey, {strategy.sql(DUCK, 't', 'k', '7')} AS replaced FROM (SELECT o_orderkey, {text} AS t, '{kind}' AS k FROM orders)"


_KINDS = ["email", "phone", "ssn", "credit_card", "name", "Address", "date", "generic", "unknown", "Grüße"]


def strategy_defaults(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in [*st.DEFAULTS, *_KINDS, "EMAIL"]], "k string").select("k", F.expr(st.lookup_sql("k")).alias("strategy"))


_REQUESTS = [(k, f, a, s) for k in ("email", "phone", "name", "zip_code", "thing") for f in ("", "format_preserving", "reversible") for a in ("", "high", "good") for s in ("", "fast")]


def strategy_best(spark, sf_dir):
    r = st.StrategyRegistry()
    return spark.createDataFrame([(*q, r.best_for(q[0], (q[1],) if q[1] else (), q[2], q[3]).name) for q in _REQUESTS], "kind string, feature string, accuracy string, speed string, strategy string")


def _strategy_best_sql() -> str:
    values = ", ".join(str(q) for q in _REQUESTS)
    caps = ", ".join(f"('{s.name}', '{k}', {'true' if s.formats else 'false'}, '{s.accuracy}')" for s in st.StrategyRegistry().strategies.values() for k in s.kinds)
    return f"""WITH q AS (SELECT * FROM (VALUES {values}) t(kind, feature, accuracy, speed)), caps AS (SELECT * FROM (VALUES {caps}) t(name, kind, fmt, acc)),
names AS (SELECT DISTINCT name FROM caps),
scored AS (SELECT q.*, n.name, {st.lookup_sql('q.kind')} AS base, CASE WHEN c.name IS NULL OR q.feature = 'reversible' THEN 0 ELSE 10 + CASE WHEN q.feature = 'format_preserving' AND c.fmt THEN 3 ELSE 0 END + CASE WHEN q.accuracy <> '' AND q.accuracy = c.acc THEN 3 ELSE 0 END + CASE WHEN q.speed = 'fast' THEN 2 ELSE 0 END END AS s
  FROM q CROSS JOIN names n LEFT JOIN caps c ON c.name = n.name AND c.kind = q.kind),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, feature, accuracy, speed ORDER BY CASE WHEN feature = '' AND accuracy = '' AND speed = '' THEN CASE WHEN name = base THEN 0 ELSE 1 END ELSE 0 END, s DESC, CASE WHEN name = base THEN 0 ELSE 1 END, name) AS r FROM scored)
SELECT kind, feature, accuracy, speed, name AS strategy FROM ranked WHERE r = 1"""


_RULES = [("", ["x"], "replace", 1), ("two", [], "mask", 5), ("three", ["a", "b"], "llm", -1), ("four", ["a"], "", 0), ("five", ["z"], "encrypt", 9)]


def policy_validate(spark, sf_dir):
    return policy.validation_errors(spark.createDataFrame(_RULES, "name string, patterns array<string>, mode string, priority int"))


def _policy_validate_sql() -> str:
    rows = ", ".join(f"('{n}', {len(p)}, '{m}', {k})" for n, p, m, k in _RULES)
    return f"""WITH r AS (SELECT * FROM (VALUES {rows}) t(rule, n, mode, priority))
SELECT rule, 'name' AS field, 'EMPTY_RULE_NAME' AS code FROM r WHERE rule = '' UNION ALL SELECT rule, 'patterns', 'NO_PATTERNS' FROM r WHERE n = 0
UNION ALL SELECT rule, 'priority', 'INVALID_PRIORITY' FROM r WHERE priority < 0 UNION ALL SELECT rule, 'mode', 'INVALID_MODE' FROM r WHERE mode NOT IN ('replace', 'mask', 'remove', 'tokenize', 'hash', 'encrypt')"""


_CONDITIONS = [("user_id", "eq", "Customer#000000007"), ("user_id", "contains", "00001"), ("user_id", "contains", ""), ("user_role", "ne", "BUILDING"), ("user_role", "regex", "B.*"), ("team", "eq", "x"), ("user_id", "equals", 5)]


def policy_conditions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("role", F.when(F.col("c_custkey") % 10 > 0, F.col("c_mktsegment")))
    return c.select("c_custkey", *[policy.condition_holds(policy.Condition(*x), F.col("c_name"), F.col("role")).alias(f"c{i}") for i, x in enumerate(_CONDITIONS)])


POLICY_CONDITIONS_SQL = """SELECT c_custkey, c_name = 'Customer#000000007' AS c0, contains(c_name, '00001') AS c1, false AS c2, CASE WHEN c_custkey % 10 = 0 THEN true ELSE c_mktsegment <> 'BUILDING' END AS c3,
CASE WHEN c_custkey % 10 = 0 THEN true ELSE false END AS c4, true AS c5, false AS c6 FROM customer"""


def policy_apply(spark, sf_dir):
    rules = [policy.Rule("TEST_RULE", (r"test@example\.com",), priority=100)]
    return policy.apply_rules(_docs(spark, sf_dir), rules).select("doc_id", "redacted_text", "n_spans")


def _library(name: str):
    def query(spark, sf_dir):
        rows = [(i, i, c, r, f, "", ["x"], p, True) for i, c, f, p, r in LIBRARIES[name]]
        return library.score_patterns(spark.createDataFrame(rows, library.SCHEMA))

    values = ", ".join(f"('{i}', '{c}', {f}, '{_quote(r)}')" for i, c, f, _, r in LIBRARIES[name])
    sql = f"""SELECT count(*) AS total, count(*) AS enabled, count(DISTINCT category) AS categories, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium,
count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS low, count(*) FILTER (confidence < 0.5) AS very_low, count(*) FILTER (length(regex) - length(replace(regex, '|', '')) > 10) AS complex FROM (VALUES {values}) t(id, category, confidence, regex)"""
    return query, sql


def _scan(name: str):
    def query(spark, sf_dir):
        return library.scan(_docs(spark, sf_dir), [(i, r) for i, _, _, _, r in LIBRARIES[name]], "text", "doc_id", trusted=True)

    parts = " UNION ALL ".join(f"SELECT doc_id, '{i}' AS pattern, CAST(len(regexp_extract_all(text, '{_quote(r)}', 0)) AS INTEGER) AS n FROM documents" for i, _, _, _, r in LIBRARIES[name])
    return query, f"SELECT * FROM ({parts}) WHERE n > 0"


def _token_store(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.expr("concat('Mail ', " + _VALUES["email"] + ", ' or call ', " + _VALUES["phone"] + ")").alias("t"))
    return tokens.issue(detect.rewrite_texts(o, "t"), "t", F.col("o_orderdate"), 86_400, salt="s")


_STORE = f"SELECT substr(sha256(t || 's'), 1, 32) AS token, t AS original_text, 'phone' AS redaction_type, o_orderdate AS created, o_orderdate + INTERVAL 1 DAY AS expires FROM (SELECT o_orderdate, concat('Mail ', {_VALUES['email']}, ' or call ', {_VALUES['phone']}) AS t FROM orders)"


def token_issue(spark, sf_dir):
    return _token_store(spark, sf_dir)


def token_restore(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.expr("substr(sha2(concat('Mail ', " + _VALUES["email"] + ", ' or call ', " + _VALUES["phone"] + ", CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 'other' END), 256), 1, 32)").alias("token"))
    return tokens.restore(wanted, _token_store(spark, sf_dir))


_RESTORE = f"SELECT w.token, s.original_text, CASE WHEN s.token IS NULL THEN 'invalid' ELSE 'restored' END AS status FROM (SELECT substr(sha256(concat('Mail ', {_VALUES['email']}, ' or call ', {_VALUES['phone']}, CASE WHEN o_orderkey % 2 = 0 THEN 's' ELSE 'other' END)), 1, 32) AS token FROM orders WHERE o_orderkey % 3 = 0) w LEFT JOIN ({_STORE}) s ON s.token = w.token"


def token_cleanup(spark, sf_dir):
    return tokens.cleanup(_token_store(spark, sf_dir), F.lit("1995-06-17 00:00:00").cast("timestamp")).groupBy("redaction_type").agg(F.count("*").alias("n"))


def token_stats(spark, sf_dir):
    return tokens.stats(_token_store(spark, sf_dir))


def windowed_counts(spark, sf_dir):
    from ..streaming.stream import windowed_counts as counts

    return counts(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def capabilities(spark, sf_dir):
    return detect.capabilities(spark).select("max_text_length", F.size("supported_types").alias("n_types"), F.size("supported_modes").alias("n_modes"))


def _pairs() -> dict[str, tuple]:
    out = {f"detect_{k}": _detect(k) for k in _VALUES}
    mixed = _MADE.format(mixed_text())
    flat = "SELECT o_orderkey, s.type AS type, s.start AS start, s.start - s.nlen AS \"end\"{} FROM (SELECT o_orderkey, unnest({}) AS s FROM ({}))"
    docs = _duck_resolved(_DOCS, "doc_id, lang, source")
    mail = _VALUES["email"]
    out |= {
        "spans_all": (spans_all, flat.format(", s.original AS original", "c", _duck_candidates(mixed, "o_orderkey"))),
        "resolve_overlaps": (resolve_overlaps, flat.format("", "r", _duck_resolved(mixed, "o_orderkey"))),
        "rewrite_mixed": (rewrite_mixed, _duck_rewritten(mixed, "o_orderkey")),
        "rewrite_documents": (rewrite_documents, _duck_rewritten(_DOCS, "doc_id")),
        "rewrite_conversations": (rewrite_conversations, _duck_rewritten("SELECT conv_id, turn, text AS t FROM conversations", "conv_id, turn")),
        "context_window": (context_window, f"SELECT o_orderkey, 'email' AS type, 18 AS start, CAST(18 + length(m) AS INTEGER) AS \"end\", 'Some words before ' || m || ' and some words after'[1:20] AS context FROM (SELECT o_orderkey, {mail} AS m FROM orders)"),
        "stats_by_type": (stats_by_type, f"SELECT s.type AS type, count(*) AS n FROM (SELECT unnest(r) AS s FROM ({docs})) GROUP BY 1"),
        "stats_by_type_lang": (stats_by_type_lang, f"SELECT lang, s.type AS type, count(*) AS n FROM (SELECT lang, unnest(r) AS s FROM ({docs})) GROUP BY 1, 2"),
        "stats_by_source": (stats_by_source, f"SELECT source, CAST(sum(len(r)) AS BIGINT) AS n_spans, count(*) AS n_docs FROM ({docs}) GROUP BY 1"),
        "top_docs": (top_docs, f"SELECT doc_id, CAST(len(r) AS INTEGER) AS n_spans FROM ({docs}) ORDER BY 2 DESC, 1 LIMIT 20"),
        "custom_registered": (custom_registered, "SELECT o_orderkey, 'Order [REDACTED] is due' AS redacted_text FROM orders"),
        "custom_request": (custom_request, f"SELECT o_orderkey, concat('Ticket T', {_p(_K + ' % 10000', 4)}) AS redacted_text, 'custom' AS type, 7 AS start, '[CUSTOM_REDACTED]' AS replacement, CAST(0.5 AS DOUBLE) AS confidence FROM orders"),
        "mode_mask": (mode_mask, f"SELECT o_orderkey, 'Mail ' || repeat('*', length({mail})) AS redacted_text FROM orders"),
        "strategy_defaults": (strategy_defaults, f"SELECT k, {st.lookup_sql('k')} AS strategy FROM (VALUES " + ", ".join(f"('{k}')" for k in [*st.DEFAULTS, *_KINDS, "EMAIL"]) + ") t(k)"),
        "strategy_best": (strategy_best, _strategy_best_sql()),
        "policy_validate": (policy_validate, _policy_validate_sql()),
        "policy_conditions": (policy_conditions, POLICY_CONDITIONS_SQL),
        "policy_apply": (policy_apply, _duck_rewritten(_DOCS, "doc_id")),
        "token_issue": (token_issue, _STORE),
        "token_restore": (token_restore, _RESTORE),
        "token_cleanup": (token_cleanup, f"SELECT redaction_type, count(*) AS n FROM ({_STORE}) WHERE NOT (TIMESTAMP '1995-06-17 00:00:00' > expires) GROUP BY 1"),
        "token_stats": (token_stats, f"SELECT redaction_type, count(*) AS n FROM ({_STORE}) GROUP BY 1"),
        "windowed_counts": (windowed_counts, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
        "capabilities": (capabilities, "SELECT 1048576 AS max_text_length, 29 AS n_types, 6 AS n_modes"),
    }
    for name in LIBRARIES:
        out[f"library_stats_{name}"], out[f"library_scan_{name}"] = _library(name), _scan(name)
    hashed, shaped, fake, like = st.ConsistentHash(), st.FormatPreserving(), st.FakeData(), st.Semantic()
    for kind in ("email", "phone", "ssn", "credit_card", "name", "address", "date", "generic"):
        out[f"strategy_consistent_hash_{kind}"] = _strategy(hashed, kind, mail)
    out["strategy_consistent_hash_full"] = _strategy(st.ConsistentHash("pepper", True), "email", mail)
    for kind, text in (("ssn", _VALUES["ssn"]), ("phone", _VALUES["phone"]), ("credit_card", _VALUES["credit_card"]), ("date", _VALUES["date"]), ("zip_code", _VALUES["zip_code"]), ("account_number", mail), ("generic", mail)):
        out[f"strategy_format_preserving_{kind}"] = _strategy(shaped, kind, text)
    for kind in ("name", "email", "phone", "address", "company", "date_of_birth", "city", "state", "country", "generic"):
        out[f"strategy_fake_data_{kind}"] = _strategy(fake, kind, mail)
    for kind in ("email", "phone", "ssn", "credit_card", "name", "address", "date", "generic"):
        out[f"strategy_semantic_{kind}"] = _strategy(like, kind, f"substr({mail}, 1, CAST(1 + o_orderkey % 14 AS INT))" if kind == "generic" else mail)
    return out


def queries() -> dict:
    return {name: pair[0] for name, pair in _pairs().items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for name, pair in _pairs().items()}
