"""Providers by configuration: what a provider is here is a ``Registry`` and how its texts are rewritten."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..functions.detectors import Registry, default_registry
from . import policy
from .detect import rewrite_texts

BASIC, POLICY_AWARE, LLM = "basic", "policy_aware", "llm"
#: Types that can be made.
SUPPORTED = (BASIC, POLICY_AWARE)


@dataclass(frozen=True)
class LlmConfig:
    provider: str = ""
    model: str = ""
    temperature: float = 0.0
    max_tokens: int = 0


@dataclass(frozen=True)
class ProviderConfig:
    """Zero values take the factory's defaults."""

    type: str = ""
    max_text_length: int = 0
    default_ttl_seconds: int = 0
    llm: LlmConfig | None = None


DEFAULT = ProviderConfig(BASIC, 1_048_576, 86_400)


@dataclass(frozen=True)
class Provider:
    """Rewrites text columns with one registry; a policy-aware one takes rules too."""

    kind: str
    registry: Registry

    def rewrite(self, df: DataFrame, text_col: str = "text", **options) -> DataFrame:
        return rewrite_texts(df, text_col, self.registry, **options)

    def apply_rules(self, df: DataFrame, rules: list[policy.Rule], text_col: str = "text", **options) -> DataFrame:
        if self.kind != POLICY_AWARE:
            raise TypeError(f"a {self.kind} provider has no policies")
        return policy.apply_rules(df, rules, text_col, registry=self.registry, **options)


def llm_fault(config: LlmConfig) -> str | None:
    """What is wrong with the configuration of a language model, if anything."""
    faults = (
        (not config.provider, "LLM provider cannot be empty"),
        (not config.model, "LLM model cannot be empty"),
        (not 0 <= config.temperature <= 2, "temperature must be between 0 and 2"),
        (config.max_tokens < 0, "max_tokens cannot be negative"),
    )
    return next((text for bad, text in faults if bad), None)


class ProviderFactory:
    """Makes providers; ``defaults`` stand in for what a configuration leaves open."""

    def __init__(self, defaults: ProviderConfig | None = None):
        self.defaults = defaults or DEFAULT

    @staticmethod
    def supported_types() -> tuple[str, ...]:
        return SUPPORTED

    def merged(self, config: ProviderConfig | None) -> ProviderConfig:
        """``config`` with the defaults for its zero values."""
        if config is None:
            return self.defaults
        filled = {f: getattr(config, f) or getattr(self.defaults, f) for f in ("type", "max_text_length", "default_ttl_seconds")}
        return replace(config, **filled)

    def validate(self, config: ProviderConfig | None) -> None:
        """ValueError for no configuration, a type that can't be made, a length or a lifetime that isn't positive, and a faulty language model's settings."""
        if config is None:
            raise ValueError("config cannot be nil")
        if config.type not in SUPPORTED:
            raise ValueError(f"unsupported provider type: {config.type}")
        for name, value in (("max_text_length", config.max_text_length), ("default_ttl", config.default_ttl_seconds)):
            if value <= 0:
                raise ValueError(f"{name} must be positive")
        if config.llm is not None and config.type == LLM and (fault := llm_fault(config.llm)):
            raise ValueError(f"invalid LLM config: {fault}")

    def create(self, kind: str, config: ProviderConfig | None = None) -> Provider:
        """A provider of the given type. NotImplementedError for a language model, ValueError for other types. The configuration is not validated."""
        if kind == LLM:
            raise NotImplementedError("LLM-based provider not yet implemented")
        if kind not in SUPPORTED:
            raise ValueError(f"unsupported provider type: {kind}")
        full = self.merged(config)
        return Provider(kind, default_registry(max_text_length=full.max_text_length, default_ttl_seconds=full.default_ttl_seconds))

    def basic(self, config: ProviderConfig | None = None) -> Provider:
        return self.create(BASIC, config)

    def policy_aware(self, config: ProviderConfig | None = None) -> Provider:
        return self.create(POLICY_AWARE, config)

    def language_model(self, config: ProviderConfig | None = None) -> Provider:
        return self.create(LLM, config)


def create_basic(config: ProviderConfig | None = None) -> Provider:
    return ProviderFactory().basic(config)


def create_policy_aware(config: ProviderConfig | None = None) -> Provider:
    return ProviderFactory().policy_aware(config)
