"""Replacement strategies as SQL text for two dialects, so that every one can be checked on another engine.

Random picks of a strategy come from a hash of (seed, type, text, place), which makes them
repeatable across partitions and retries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

DEFAULT_SALT = "default_salt_change_in_production"
FIRST = "Ada Ben Cleo Dan Eva Finn Gwen Hugo Iris Jack Kira Liam Mona Nils Olga Paul Quinn Rosa Sven Tara Uma Vic Wren Xena Yara Zeno Alma Bram Cora Dirk Elsa Fritz".split()
LAST = "Archer Brook Carver Dale Ellis Frost Grant Hale Irwin Judd Kerr Lowe Marsh North Otis Pryce Quill Rowe Stone Thorne Upton Vance West Yorke Zane Alder Birch Cole Drake Ember Flint Glenn".split()
USERS = "user contact person someone member guest client sample reader visitor".split()
MAIL = "sample.com example.net test.org mail.example post.example demo.example web.example inbox.example note.example site.example".split()
STREETS = [f"{a} {b}" for a, b in zip("Oak Elm Mill Park Hill Lake High Station Cedar Maple Bridge Garden Spring River Church Queen King".split(), "Street Avenue Lane Road Drive View Street Road Court Place Way Close Lane Road Street Avenue Drive".split())]
CITIES = "Ashford Brightwater Clearfield Dunmore Eastvale Fairhaven Glenrock Harborview Ironwood Juniper Kingsport Larkhill Meadowbrook Newfield Oakdale Pinehurst Redstone Silverton".split()
STATES = "Northland Southmark Eastholm Westria Midvale Lakeshire Highmoor Lowfen Greenway Riverton Stonegate Woodland Seaboard Hillcrest Plainview Sunfield Coalport Snowdale".split()
COUNTRIES = "Arvania Belmora Cordia Delvara Estoria Farland Galdova Hestia Ivoria Jorvik Kaldera Lumenia Morvia Noravia Ostland Pelagia Rovinia Sardovia".split()
FIRMS = "Acorn Blue Cedar Delta Ember Falcon Granite Harbor Ivory Jade Kestrel Lunar".split()
SUFFIX = "Ltd Inc Group Partners Works Systems Foods Labs Freight Holdings Trading Services".split()


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def number(self, key: str, n: int) -> str:
        """A whole number from 0 to n - 1 drawn by a key."""
        h = f"substr({self.sha(key)}, 1, 8)"
        return f"CAST(pmod(CAST(conv({h}, 16, 10) AS BIGINT), {n}) AS INT)" if self.spark else f"CAST(CAST('0x' || {h} AS BIGINT) % {n} AS INT)"

    def choose(self, values: list[str], at: str) -> str:
        items = ", ".join("'" + v + "'" for v in values)
        return f"element_at(array({items}), {at} + 1)" if self.spark else f"list_extract([{items}], {at} + 1)"

    def matches(self, x: str, regex: str) -> str:
        return f"rlike({x}, r'{regex}')" if self.spark else f"regexp_matches({x}, '{regex}')"

    def digits(self, x: str) -> str:
        return f"regexp_replace({x}, r'[^0-9]', '')" if self.spark else f"regexp_replace({x}, '[^0-9]', '', 'g')"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})" if self.spark else f"strlen({x})"

    def each_sign(self, x: str, key: str, letters: bool = True) -> str:
        """Digits for digits, and letters for letters, drawn by place; other signs stay."""
        draw = lambda n: self.number(f"concat({key}, '|', CAST(i AS STRING))", n)
        code = lambda base: f"chr({base} + {draw(26)})"
        more = f" WHEN c BETWEEN 'A' AND 'Z' THEN {code(65)} WHEN c BETWEEN 'a' AND 'z' THEN {code(97)}" if letters else ""
        case = f"CASE WHEN c BETWEEN '0' AND '9' THEN CAST({draw(10)} AS STRING){more} ELSE c END"
        if self.spark:
            return f"array_join(transform(filter(split({x}, ''), c -> c <> ''), (c, i) -> {case}), '')"
        return f"coalesce(array_to_string(list_transform(string_split({x}, ''), lambda c, i: {case.replace('CAST(i AS STRING)', 'CAST(i - 1 AS STRING)')}), ''), '')"


def _padded(x: str, width: int) -> str:
    return f"lpad(CAST({x} AS STRING), {width}, '0')"


class Strategy:
    """One way to replace a value: ``sql`` of the columns text and type, given as SQL of each."""

    name, confidence, default_confidence, accuracy, formats, kinds = "", 1.0, 1.0, "good", False, ()

    def sql(self, d: Dialect, text: str, kind: str, seed: str = "0") -> str:
        raise NotImplementedError

    def column(self, text: str, kind: str, seed: str = "0") -> Column:
        return F.expr(self.sql(Dialect(True), text, kind, seed))

    def capabilities(self) -> dict:
        return {"name": self.name, "supported_types": list(self.kinds), "supports_reversible": False, "supports_format_preserving": self.formats, "performance": "fast", "accuracy": self.accuracy}


class ConsistentHash(Strategy):
    """SHA-256 of ``text:type:salt``, shown in a form that goes with the type; types are taken as written."""

    name, confidence, default_confidence, accuracy = "consistent_hash", 1.0, 1.0, "high"
    kinds = ("email", "phone", "phone_number", "ssn", "social_security", "credit_card", "credit_card_number", "name", "person_name", "address", "date", "date_of_birth", "generic")

    def __init__(self, salt: str = DEFAULT_SALT, full_hash: bool = False):
        self.salt, self.full_hash = salt, full_hash

    def sql(self, d, text, kind, seed="0"):
        salt = self.salt.replace("'", "''")
        h = d.sha(f"concat({text}, ':', {kind}, ':', '{salt}')")
        if self.full_hash:
            return h
        part = lambda a, n: f"substr({h}, {a}, {n})"
        return (
            f"CASE WHEN {kind} = 'email' THEN concat('user_', {part(1, 8)}, '@redacted.com') WHEN {kind} IN ('phone', 'phone_number') THEN concat('555-', {part(1, 3)}, '-', {part(4, 4)}) "
            f"WHEN {kind} IN ('ssn', 'social_security') THEN concat('***-**-', {part(1, 4)}) WHEN {kind} IN ('credit_card', 'credit_card_number') THEN concat('****-****-****-', {part(1, 4)}) "
            f"WHEN {kind} IN ('name', 'person_name') THEN concat('Person_', {part(1, 8)}) WHEN {kind} = 'address' THEN concat('Address_', {part(1, 8)}) "
            f"WHEN {kind} IN ('date', 'date_of_birth') THEN concat('Date_', {part(1, 8)}) ELSE concat('HASH_', {part(1, 16)}) END"
        )


class FormatPreserving(Strategy):
    """A value of the same shape."""

    name, confidence, default_confidence, accuracy, formats = "format_preserving", 0.9, 0.7, "high", True
    kinds = ("ssn", "social_security", "phone", "phone_number", "credit_card", "credit_card_number", "date", "date_of_birth", "zip_code", "account_number", "generic")

    def sql(self, d, text, kind, seed="0"):
        key = f"concat('{seed}', '|', lower({kind}), '|', {text})"
        n = lambda k, top: d.number(f"concat({key}, '|{k}')", top)
        a, b, c = f"CAST(100 + {n('a', 900)} AS STRING)", _padded(n("b", 100), 2), _padded(n("c", 10000), 4)
        x3, x4 = f"CAST(100 + {n('x', 900)} AS STRING)", _padded(n("y", 10000), 4)
        ssn = f"CASE WHEN {text} LIKE '%-%' THEN concat({a}, '-', {b}, '-', {c}) WHEN {text} LIKE '% %' THEN concat({a}, ' ', {b}, ' ', {c}) ELSE concat({a}, {b}, {c}) END"
        phone = (
            f"CASE WHEN {text} LIKE '%(%' AND {text} LIKE '%)%' THEN concat('(555) ', {x3}, '-', {x4}) WHEN {text} LIKE '%-%' THEN concat('555-', {x3}, '-', {x4}) WHEN {text} LIKE '%.%' THEN concat('555.', {x3}, '.', {x4}) "
            f"WHEN length({d.digits(text)}) = 10 AND {d.digits(text)} = {text} THEN concat('555', {x3}, {x4}) ELSE concat('555-', {x3}, '-', {x4}) END"
        )
        card = f"CASE WHEN {text} LIKE '%-%' THEN '4111-1111-1111-1111' WHEN {text} LIKE '% %' THEN '4111 1111 1111 1111' ELSE '4111111111111111' END"
        y, m, day = f"CAST(1970 + {n('y', 50)} AS STRING)", _padded(f"1 + {n('m', 12)}", 2), _padded(f"1 + {n('d', 28)}", 2)
        date = (
            f"CASE WHEN {d.matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')} THEN concat({y}, '-', {m}, '-', {day}) WHEN {d.matches(text, '[0-9]{2}/[0-9]{2}/[0-9]{4}')} THEN concat({m}, '/', {day}, '/', {y}) "
            f"WHEN {d.matches(text, '[0-9]{2}-[0-9]{2}-[0-9]{4}')} THEN concat({m}, '-', {day}, '-', {y}) ELSE '01-01-1990' END"
        )
        zipped = f"CASE WHEN {d.bytes(text)} = 5 THEN {_padded(n('z', 100000), 5)} WHEN {d.bytes(text)} = 10 AND {text} LIKE '%-%' THEN concat({_padded(n('z', 100000), 5)}, '-', {_padded(n('w', 10000), 4)}) ELSE '12345' END"
        k = f"lower({kind})"
        return (
            f"CASE WHEN {k} IN ('ssn', 'social_security') THEN {ssn} WHEN {k} IN ('phone', 'phone_number') THEN {phone} WHEN {k} IN ('credit_card', 'credit_card_number') THEN {card} "
            f"WHEN {k} IN ('date', 'date_of_birth') THEN {date} WHEN {k} = 'zip_code' THEN {zipped} WHEN {k} = 'account_number' THEN {d.each_sign(text, key, False)} ELSE {d.each_sign(text, key)} END"
        )


class FakeData(Strategy):
    """A made-up value that looks real."""

    name, confidence, default_confidence, accuracy = "fake_data", 0.85, 0.6, "good"
    kinds = ("name", "person_name", "email", "phone", "phone_number", "address", "company", "date_of_birth", "city", "state", "country", "generic")

    def sql(self, d, text, kind, seed="0"):
        key = f"concat('{seed}', '|', lower({kind}), '|', {text})"
        one = lambda k, values: d.choose(values, d.number(f"concat({key}, '|{k}')", len(values)))
        n = lambda k, top: d.number(f"concat({key}, '|{k}')", top)
        k = f"lower({kind})"
        size = d.bytes(text)
        return (
            f"CASE WHEN {k} IN ('name', 'person_name') THEN concat({one('f', FIRST)}, ' ', {one('l', LAST)}) WHEN {k} = 'email' THEN concat({one('u', USERS)}, '@', {one('m', MAIL)}) "
            f"WHEN {k} IN ('phone', 'phone_number') THEN concat('555-', {_padded(n('x', 1000), 3)}, '-', {_padded(n('y', 10000), 4)}) "
            f"WHEN {k} = 'address' THEN concat(CAST(1 + {n('n', 9999)} AS STRING), ' ', {one('s', STREETS)}) WHEN {k} = 'company' THEN concat({one('c', FIRMS)}, ' ', {one('u', SUFFIX)}) "
            f"WHEN {k} = 'date_of_birth' THEN concat(CAST(1970 + {n('y', 50)} AS STRING), '-', {_padded('1 + ' + n('m', 12), 2)}, '-', {_padded('1 + ' + n('d', 28), 2)}) "
            f"WHEN {k} = 'city' THEN {one('c', CITIES)} WHEN {k} = 'state' THEN {one('c', STATES)} WHEN {k} = 'country' THEN {one('c', COUNTRIES)} "
            f"WHEN {size} <= 5 THEN 'FAKE' WHEN {size} <= 15 THEN 'FAKE_DATA' ELSE 'REALISTIC_FAKE_DATA_PLACEHOLDER' END"
        )


class Semantic(Strategy):
    """A stand-in that keeps the meaning's kind."""

    name, confidence, default_confidence, accuracy = "semantic", 0.8, 0.6, "good"
    kinds = ("email", "email_address", "phone", "phone_number", "ssn", "social_security", "credit_card", "credit_card_number", "name", "person_name", "address", "date", "date_of_birth", "generic")

    def sql(self, d, text, kind, seed="0"):
        key = f"concat('{seed}', '|', lower({kind}), '|', {text})"
        one = lambda k, values: d.choose(values, d.number(f"concat({key}, '|{k}')", len(values)))
        n = lambda k, top: d.number(f"concat({key}, '|{k}')", top)
        k, size = f"lower({kind})", d.bytes(text)
        return (
            f"CASE WHEN {k} IN ('email', 'email_address') THEN concat({one('u', ['user', 'contact', 'person', 'someone'])}, '@', {one('m', MAIL[:4])}) WHEN {k} IN ('phone', 'phone_number') THEN concat('555-', CAST(100 + {n('x', 900)} AS STRING), '-', {_padded(n('y', 10000), 4)}) "
            f"WHEN {k} IN ('ssn', 'social_security') THEN concat(CAST(100 + {n('a', 900)} AS STRING), '-', {_padded(n('b', 100), 2)}, '-', {_padded(n('c', 10000), 4)}) "
            f"WHEN {k} IN ('credit_card', 'credit_card_number') THEN concat('4111-1111-1111-', {_padded(n('c', 10000), 4)}) WHEN {k} IN ('name', 'person_name') THEN concat({one('f', FIRST[:6])}, ' ', {one('l', LAST[:6])}) "
            f"WHEN {k} = 'address' THEN concat(CAST(1 + {n('n', 9999)} AS STRING), ' ', {one('s', STREETS[:5])}) WHEN {k} IN ('date', 'date_of_birth') THEN concat({_padded('1 + ' + n('m', 12), 2)}, '/', {_padded('1 + ' + n('d', 28), 2)}, '/', CAST(1970 + {n('y', 50)} AS STRING)) "
            f"WHEN {size} <= 3 THEN '***' WHEN {size} <= 10 THEN '[REDACTED]' ELSE '[SENSITIVE_DATA_REDACTED]' END"
        )


# The strategy of each type; all others have semantic.
DEFAULTS = {
    "email": "semantic",
    "email_address": "semantic",
    "phone": "format_preserving",
    "phone_number": "format_preserving",
    "ssn": "format_preserving",
    "social_security": "format_preserving",
    "credit_card": "format_preserving",
    "credit_card_number": "format_preserving",
    "name": "fake_data",
    "person_name": "fake_data",
    "address": "fake_data",
    "date_of_birth": "fake_data",
    "generic": "consistent_hash",
    "unknown": "semantic",
}


class StrategyRegistry:
    """Strategies by name, the default of each type, and the best for a request."""

    def __init__(self, *strategies: Strategy):
        self.strategies: dict[str, Strategy] = {}
        self.defaults = dict(DEFAULTS)
        for s in strategies or (Semantic(), FormatPreserving(), ConsistentHash(), FakeData()):
            self.register(s)

    def register(self, strategy: Strategy) -> None:
        if strategy is None:
            raise ValueError("strategy cannot be nil")
        if not strategy.name:
            raise ValueError("strategy name cannot be empty")
        self.strategies[strategy.name] = strategy

    def get(self, name: str) -> Strategy:
        if name not in self.strategies:
            raise KeyError(f"strategy '{name}' not found")
        return self.strategies[name]

    def names(self) -> list[str]:
        return sorted(self.strategies)

    def default_for(self, kind: str) -> Strategy:
        return self.get(self.defaults.get(kind.lower(), "semantic"))

    def score(self, strategy: Strategy, kind: str, features=(), accuracy: str = "", speed: str = "") -> int:
        """0 if the type is not supported or reversal is asked for, else 10 and 3, 3 and 2 for a kept format, the accuracy and the speed asked for."""
        if kind.lower() not in strategy.kinds or "reversible" in features:
            return 0
        return 10 + 3 * ("format_preserving" in features and strategy.formats) + 3 * (bool(accuracy) and accuracy.lower() == strategy.accuracy) + 2 * (speed.lower() == "fast")

    def best_for(self, kind: str, features=(), accuracy: str = "", speed: str = "") -> Strategy:
        """The default unless something is asked for and another strategy scores higher; ties go by name."""
        best = self.default_for(kind)
        if features or accuracy or speed:
            top = self.score(best, kind, features, accuracy, speed)
            for name in self.names():
                if (s := self.score(self.strategies[name], kind, features, accuracy, speed)) > top:
                    best, top = self.strategies[name], s
        return best


def lookup_sql(kind: str) -> str:
    """The default strategy's name of a type column, in either dialect."""
    by: dict[str, list[str]] = {}
    for k, v in DEFAULTS.items():
        by.setdefault(v, []).append(k)
    whens = " ".join(f"WHEN lower({kind}) IN ({', '.join(repr(k) for k in ks)}) THEN '{v}'" for v, ks in by.items() if v != "semantic")
    return f"CASE {whens} ELSE 'semantic' END"


def replacement(strategy: Strategy, text: str, kind: str, seed: str = "0") -> Column:
    """The whole result of a strategy: struct of replaced_text, strategy, confidence, reversible and metadata."""
    new = strategy.column(text, kind, seed)
    known = F.lower(F.col(kind)).isin(list(strategy.kinds)) & (F.lower(F.col(kind)) != "generic")
    meta = F.create_map(F.lit("original_length"), F.octet_length(text).cast("string"), F.lit("replaced_length"), F.octet_length(new).cast("string"), F.lit("detected_type"), F.col(kind))
    return F.struct(new.alias("replaced_text"), F.lit(strategy.name).alias("strategy"), F.when(known, strategy.confidence).otherwise(strategy.default_confidence).alias("confidence"), F.lit(False).alias("reversible"), meta.alias("metadata"))
