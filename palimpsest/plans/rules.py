"""Detection rules as data: built-in patterns, rule packs from JSON, and the rewrite to Java's regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rule_values import VALUES

ENTITY_TYPES = ("PERSON", "EMAIL", "PHONE", "SSN", "CREDIT_CARD", "DATE", "CURRENCY", "IP_ADDRESS", "IBAN", "ADDRESS", "COMPANY", "SECRET", "API_KEY", "OTHER")
PACK_SCHEMA = (
    "region string, rules array<struct<id:string,entityType:string,pattern:string,flags:string,confidence:double,"
    "domains:array<string>,description:string,examples:array<string>,validate:string,multiline:boolean>>"
)


@dataclass(frozen=True)
class Rule:
    """need: a cheap pattern without which the rule can't match; lines that lack it skip the rule."""

    region: str
    name: str
    type: str
    pattern: str
    confidence: float
    validate: str | None = None
    flags: str = "g"
    need: str | None = None
    multiline: bool = False

    @property
    def detector(self) -> str:
        return f"regex:{self.region}:{self.name}"


#: White space of the rule packs that Java's does not know; flat texts have plain spaces there. As a pattern, with a first look at what is beyond ASCII.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ANY_SPACE = r"(?=[^\x00-\x9F])[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_WORD_NEXT = re.compile(r"\\d(?![*?]|\{0)|\[(?:\w-\w|\w|\\d)+\](?![*?]|\{0)", re.ASCII)
_WORD_BEFORE = re.compile(r"(?:\\d|\[(?:\w-\w|\w|\\d)+\])(?:\{[1-9][0-9,]*\}|\+)?$", re.ASCII)


def java_pattern(pattern: str, flags: str = "g", flat: bool = False) -> str:
    r"""Make ``\b`` and ``\s`` mean what they mean in the rule packs: ASCII word edges, all Unicode white space.

    flat: the texts have plain spaces for SPACES, so ``\s`` stays, and edges
    beside what must be a word character look at the other side only.
    """
    space = r"\s" if flat else r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    edge = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two[0] == "\\" and len(two) == 2:
            if two == r"\b" and not inside:
                ahead = flat and _WORD_NEXT.match(pattern, at + 2)
                behind = flat and _WORD_BEFORE.search(pattern[:at])
                out.append(r"(?<![0-9A-Za-z_])" if ahead else r"(?![0-9A-Za-z_])" if behind else edge)
            else:
                out.append((space if inside or flat else f"[{space}]") if two == r"\s" else two)
            at += 2
            continue
        inside = two[0] == "[" or inside and two[0] != "]"
        out.append(r"\[" if two[0] == "[" and out and inside and _open(out) else two[0])
        at += 1
    mode = ("i" if "i" in flags else "") + ("u" if "u" in flags and "i" in flags else "")
    return (f"(?{mode})" if mode else "") + "".join(out)


def _open(out: list[str]) -> bool:
    """Whether a class is open at the end of what is written: Java takes a second ``[`` there for a nested class."""
    inside = False
    for piece in out:
        inside = piece == "[" or inside and piece != "]"
    return inside


def is_class(pattern: str) -> bool:
    """Whether a pattern is one character or one class of characters."""
    return len(pattern) == 1 and pattern.isalnum() or pattern in ("@", ":", "=") or re.fullmatch(r"\[[^\[\]^]+\]", pattern) is not None


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern that is one group; else the pattern."""
    if not (pattern.startswith("(?:") and pattern.endswith(")")):
        return [pattern]
    out, depth, inside, at, start = [], 0, False, 3, 3
    while at < len(pattern) - 1:
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside or c == "[":
            inside = c != "]"
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return [pattern]
        elif c == "|" and not depth:
            out.append(pattern[start:at])
            start = at + 1
        at += 1
    return [*out, pattern[start:-1]]


def any_of(patterns: Iterable[str]) -> dict[str, list[str]]:
    """Fewer patterns that together hold in the same texts, each with those it stands for.

    Classes become one class. Java tries each alternative at each place, so those that begin with a capital are tried at capitals only.
    """
    classes, plain, folded, apart = [], [], [], []
    for p in patterns:
        special = re.search(r"^\(\?(?!iu\))[a-z]+\)|\\[1-9k]", p)
        (classes if is_class(p) else apart if special else folded if p.startswith("(?iu)") else plain).append(p)
    branches = list(dict.fromkeys(b for p in plain for b in _branches(p)))
    capital = [b for b in branches if re.match(r"[A-Z](?![?*{|])", b) and _branches(f"(?:{b})") == [b]]
    capitals = [f"(?=[A-Z])(?:{'|'.join(capital)})"] if capital else []
    out = {f"[{''.join(p[1:-1] if p[0] == '[' else p for p in classes)}]": classes, "|".join([*capitals, *(b for b in branches if b not in capital)]): plain}
    out[f"(?iu)(?:{'|'.join(p.removeprefix('(?iu)') for p in folded)})"] = folded
    return {k: v for k, v in out.items() if v} | {p: [p] for p in apart}


_HEAD = re.compile(r"\[\\p\{L\}\]\[[^\]]*\][*+](?:\(\?:,?\\s\+\)\?)?")
_BEHIND = r"(?<=[\p{L}][\p{L}\s]{0,30}[:#]\s?)"


def without_head(pattern: str, flags: str = "g") -> str | None:
    """What follows the run of letters at the start of a pattern, for flat texts; null where it starts otherwise.

    A run is tried from each of its letters, which takes the square of its length: texts without the rest need not be tried.
    """
    if pattern.startswith(_BEHIND):
        return java_pattern(pattern.replace(_BEHIND, r"[:#]\s?", 1), flags, flat=True)
    rest = [b[m.end() :] if (m := _HEAD.match(b)) else b for b in _branches(f"(?:{pattern})")]
    return java_pattern("|".join(rest), flags, flat=True) if "|".join(rest) != pattern and all(rest) else None


#: What a line must hold for a rule that can match without a digit; all others need one.
_NEEDS = {
    "email": "@", "ipv6": ":", "mac_address": ":", "aws_access_key": "A[A-Z]{2}A", "github_token": "gh", "slack_token": "xox", "openai_api_key": "sk-",
    "anthropic_api_key": "sk-", "google_api_key": "AIza", "private_key_block": "-----BEGIN", "jwt": "eyJ", "connection_string_creds": "://",
    "secret_assignment": "[:=]", "uscc": "[0-9A-Z]{18}", "currency_hanzi": "[元圆块]", "currency_kanji": "円",
    "company_prefix": "会社", "company_suffix": "会社",
}
_ENDING = re.compile(r"(\(\?:[^()]*(?:\([^()]*\)[^()]*)*\))(?:\\b)?$")


def _need(name: str, pattern: str, flags: str) -> str | None:
    """A cheap pattern that every match of the rule holds: for names and amounts in words, the words the pattern ends with."""
    if name in ("company", "currency_words") and (found := _ENDING.search(pattern)):
        return java_pattern(found[1], flags, flat=True)
    if name in ("address", "street") and not re.search(r"\\d\{?[1+]|\\d\+", pattern.replace("\\d+)?", "")):
        return "[\\u4E00-\\u9FFF]" if name == "address" else None
    return _NEEDS.get(name, "[0-9]")


#: The built-in rules, universal ones first.
RULES: tuple[Rule, ...] = tuple(Rule(region, name, kind, pattern, confidence, check, flags, _need(name, pattern, flags), lines) for region, name, kind, pattern, flags, confidence, check, lines in VALUES)


def for_region(region: str = "all", rules: Iterable[Rule] = RULES) -> list[Rule]:
    """Rules of a region with the universal ones; ``all`` takes every rule."""
    return [r for r in rules if region == "all" or r.region in ("universal", region)]


def load_packs(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of JSON packs under ``path``; an unknown check is an error."""
    from ..functions.validators import VALIDATORS

    rows = spark.read.schema(PACK_SCHEMA).json(path, multiLine=True).select("region", F.posexplode("rules").alias("n", "r")).select("region", "n", "r.*")
    out = []
    for r in sorted(rows.collect(), key=lambda r: (r["region"] != "universal", r["region"], r["n"])):  # a few hundred rules
        name = r["validate"] and "".join("_" + c.lower() if c.isupper() else c for c in r["validate"])
        if name and name not in VALIDATORS:
            raise ValueError(f"{r['id']}: unknown validator {r['validate']}")
        if r["entityType"] not in ENTITY_TYPES:
            raise ValueError(f"{r['id']}: unknown type {r['entityType']}")
        out.append(Rule(r["region"], r["id"].split(":")[-1], r["entityType"], r["pattern"], r["confidence"], name, r["flags"] or "g", None, bool(r["multiline"])))
    return out


def rules_table(spark: SparkSession, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The dimension table of rules."""
    rows = [(i, r.region, r.detector, r.type, r.pattern, r.flags, r.confidence, r.validate, r.multiline) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_order int, region string, id string, entity_type string, pattern string, flags string, confidence double, validate string, multiline boolean")
