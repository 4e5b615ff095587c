"""The built-in detectors: patterns, priorities and placeholders."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The detectors' patterns, in RE2 syntax.
PATTERNS: dict[str, str] = {
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "date": r"\b(?:0?[1-9]|1[012])[-/](?:0?[1-9]|[12][0-9]|3[01])[-/](?:19|20)\d{2}\b",
    "time": r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?\s*(?:AM|PM|am|pm)?\b",
    "link": r'\b(?:https?://|www\.)[^\s<>"{}|\\^`\[\]]+',
    "zip_code": r"\b\d{5}-\d{4}\b",
    "po_box": r"\b(?:P\.?O\.?\s*Box|Post\s*Office\s*Box|PO\s*Box)\s+\d+\b",
    "btc_address": r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b",
    "md5_hex": r"\b[a-fA-F0-9]{32}\b",
    "sha1_hex": r"\b[a-fA-F0-9]{40}\b",
    "sha256_hex": r"\b[a-fA-F0-9]{64}\b",
    "guid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "isbn": r"\b(?:ISBN(?:-1[03])?\s*:?\s*)?[0-9X]{10}(?:[-\s][0-9X]{3}){3}\b",
    "mac_address": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}([A-Z0-9]?){0,16}\b",
    "git_repo": r"\b(?:git@|https?://)(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(?:/[a-zA-Z0-9_.-]+)*\.git\b",
    "uk_national_insurance": r"(?i)\b[A-Z]{2}\d{6}[A-D]\b",
    "uk_nhs_number": r"(?i)\bNHS\s+Numbers?\s*:?\s*\d{3}\s\d{3}\s\d{4}\b|\bNHS:?\s*\d{10}\b|\bNHS\s+\d{3}\s\d{3}\s\d{4}\b",
    "uk_postcode": r"(?i)\b[A-Z]{1,2}[0-9][A-Z0-9]?\s?[0-9][A-Z]{2}\b",
    "uk_phone_number": r"(?i)\+44\s?\d{2,4}\s?\d{3,4}\s?\d{3,4}",
    "uk_mobile_number": r"(?i)\b07\d{9}\b|07\s?\d{3}\s?\d{3}\s?\d{3}",
    "uk_sort_code": r"(?i)\b\d{2}-\d{2}-\d{2}\b",
    "uk_iban": r"(?i)\bGB\d{2}\s?[A-Z]{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}\b",
    "uk_company_number": r"(?i)\b(?:Company\s+(?:No\.?|Number)\s*:?\s*)?\d{8}\b",
    "uk_driving_license": r"(?i)\b[A-Z]{5}\d{6}[A-Z]{2}\d[A-Z]{2}\b",
    "uk_passport_number": r"(?i)\b(?:Passport\s+(?:No\.?|Number)\s*:?\s*)?\d{9}\b",
}

# Priorities; all other types have 30.
PRIORITIES: dict[str, int] = {
    "uk_national_insurance": 100,
    "uk_nhs_number": 100,
    "uk_passport_number": 100,
    "uk_driving_license": 90,
    "uk_iban": 90,
    "uk_sort_code": 90,
    "uk_phone_number": 80,
    "uk_mobile_number": 80,
    "uk_company_number": 80,
    "uk_postcode": 70,
    "ssn": 60,
    "credit_card": 60,
    "email": 50,
    "phone": 50,
    "ip_address": 40,
    "date": 40,
    "time": 40,
}

#: Types that have a placeholder but no pattern.
UNDETECTED = ("address", "name")
CONFIDENCE = 0.95
#: Type names whose placeholder does not follow from the name.
_NAMED = {"md5_hex": "MD5_HASH", "sha1_hex": "SHA1_HASH", "sha256_hex": "SHA256_HASH"}
#: Signs without which a pattern cannot match; others need a digit.
_NEEDS = {"email": ["@"], "link": ["://", "www."], "git_repo": [".git"], "po_box": ["Box"], "isbn": [], "md5_hex": [], "sha1_hex": [], "sha256_hex": [], "guid": ["-"], "mac_address": []}


def priority(kind: str) -> int:
    return PRIORITIES.get(kind, 30)


def placeholder(kind: str) -> str:
    """``[TYPE_REDACTED]`` for known types, ``[REDACTED]`` for others."""
    if kind in PATTERNS or kind in UNDETECTED:
        return f"[{_NAMED.get(kind, kind.upper())}_REDACTED]"
    return "[REDACTED]"


@dataclass(frozen=True)
class Detector:
    kind: str
    regex: str
    priority: int = 30
    placeholder: str = "[REDACTED]"
    confidence: float = CONFIDENCE
    needs: tuple[str, ...] | None = ()  # one of these must be in the text; None: a digit must
    trusted: bool = False  # a built-in pattern, which no text makes slow


@dataclass(frozen=True)
class Registry:
    """An immutable set of detectors; registering gives a new one."""

    detectors: tuple[Detector, ...]
    max_text_length: int = 1_048_576
    default_ttl_seconds: int = 86_400

    def register(self, kind: str, regex: str) -> Registry:
        """Add a pattern, or replace one of that name. ValueError if it is no RE2 pattern."""
        from .regex import check

        check(regex)
        made = Detector(kind, regex, priority(kind), placeholder(kind))
        return replace(self, detectors=(*(d for d in self.detectors if d.kind != kind), made))

    def only(self, kinds) -> Registry:
        """The detectors of the given types: an opt-in that the plain engine lacks."""
        return replace(self, detectors=tuple(d for d in self.detectors if d.kind in set(kinds)))

    def without(self, kinds) -> Registry:
        return replace(self, detectors=tuple(d for d in self.detectors if d.kind not in set(kinds)))

    def at_least(self, confidence: float) -> Registry:
        return replace(self, detectors=tuple(d for d in self.detectors if d.confidence >= confidence))


def default_registry(**limits) -> Registry:
    return Registry(tuple(Detector(k, p, priority(k), placeholder(k), CONFIDENCE, tuple(_NEEDS[k]) if k in _NEEDS else None, True) for k, p in PATTERNS.items()), **limits)
