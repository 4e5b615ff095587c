"""Policy rules: validation, conditions, and their application."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.detectors import Detector, Registry, default_registry
from ..functions.regex import check
from .detect import rewrite_texts

MODES = ("replace", "mask", "remove", "tokenize", "hash", "encrypt")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object


@dataclass(frozen=True)
class Rule:
    name: str
    patterns: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    mode: str = "replace"
    conditions: tuple[Condition, ...] = ()
    priority: int = 0
    enabled: bool = True
    metadata: dict = field(default_factory=dict)


def validation_errors(rules: DataFrame) -> DataFrame:
    """``(rule, field, code)`` for each fault of ``rules`` (name, patterns, mode, priority), a rule's faults in this order: name, patterns, priority, mode."""

    def fault(bad: Column, name: str, code: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(name).alias("field"), F.lit(code).alias("code")))

    faults = F.array(fault(F.col("name") == "", "name", "EMPTY_RULE_NAME"), fault(F.size("patterns") <= 0, "patterns", "NO_PATTERNS"), fault(F.col("priority") < 0, "priority", "INVALID_PRIORITY"), fault(~F.col("mode").isin(*MODES), "mode", "INVALID_MODE"))
    return rules.select(F.col("name").alias("rule"), F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("f")).select("rule", "f.field", "f.code")


def condition_holds(c: Condition, user_id: Column, user_role: Column) -> Column:
    """Whether a condition holds; those on other fields, and on the role where there is none, do. Unknown operators and values that are not text never do."""
    if c.field not in ("user_id", "user_role"):
        return F.lit(True)
    value = user_id if c.field == "user_id" else user_role
    if not isinstance(c.value, str):
        met = F.lit(False)
    elif c.operator in ("eq", "equals"):
        met = value == c.value
    elif c.operator in ("ne", "not_equals"):
        met = value != c.value
    elif c.operator == "contains":
        met = value.contains(c.value) if c.value else F.lit(False)
    else:
        met = F.lit(False)
    met = F.coalesce(met, F.lit(False))
    return met if c.field == "user_id" else F.when(user_role.isNull(), True).otherwise(met)


def rule_applies(rule: Rule, user_id: Column, user_role: Column) -> Column:
    holds = F.lit(rule.enabled)
    for c in rule.conditions:
        holds = holds & condition_holds(c, user_id, user_role)
    return holds


def apply_rules(df: DataFrame, rules: list[Rule], text_col: str = "text", user_id: Column | None = None, user_role: Column | None = None, registry: Registry | None = None, effective: bool = False) -> DataFrame:
    """``rewrite_texts`` with the rules beside it: they change nothing unless ``effective``, where the patterns of rules that apply to a row are replaced too, higher priority first among equals."""
    registry = registry or default_registry()
    if not effective:
        return rewrite_texts(df, text_col, registry)
    role = user_role if user_role is not None else F.lit(None).cast("string")
    user = user_id if user_id is not None else F.lit("")
    rules = sorted(rules, key=lambda r: (-r.priority, r.name))
    own = F.struct(*[rule_applies(rule, user, role).alias(f"r{k}") for k, rule in enumerate(rules)]) if rules else F.lit(True)
    names = df.columns
    out = rewrite_texts(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), own.alias("holds"), F.col(f"`{text_col}`").alias("text")), "text", registry)
    for r, rule in enumerate(rules):
        for k, p in enumerate(rule.patterns):
            check(p)
            one = Registry((Detector(f"{rule.name}_{k}", p, rule.priority, f"[{rule.name.upper()}_REDACTED]"),), registry.max_text_length)
            step = rewrite_texts(out.select("row", "holds", F.struct("redactions", "n_spans").alias("before"), F.col("redacted_text").alias("text")), "text", one, mode=rule.mode, effective_modes=True)
            holds = F.col(f"holds.r{r}")
            out = step.select("row", "holds", F.when(holds, F.col("redacted_text")).otherwise(F.col("text")).alias("redacted_text"), F.when(holds, F.concat("before.redactions", "redactions")).otherwise(F.col("before.redactions")).alias("redactions"))
            out = out.withColumn("n_spans", F.size("redactions"))
    names = [c for c in names if c not in ("redacted_text", "redactions", "n_spans")]
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "redacted_text", "redactions", "n_spans")
