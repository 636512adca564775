"""Plain answers read by Arrow batch: what textjson's columns give, for all but odd texts.

Most answers hold one flat object, or no JSON at all. These are read here, equal texts of a batch once. Of any other
(nested values in a field of the contract, half surrogates, very long numbers, deep or very long texts) the
result is null, and the columns read them.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa

from casewright.functions import textjson as T

RESULT = "errors array<string>, json_valid boolean, got struct<decision: string, risk_level: string, need_human: boolean, reason_codes: array<string>>"
_ARROW = pa.struct([
    ("errors", pa.list_(pa.string())), ("json_valid", pa.bool_()),
    ("got", pa.struct([("decision", pa.string()), ("risk_level", pa.string()), ("need_human", pa.bool_()), ("reason_codes", pa.list_(pa.string()))])),
])
#: Longer texts, more brackets and longer numbers are left to the columns.
MOST_CHARS, MOST_BRACKETS, MOST_DIGITS = 1 << 20, 200, 30
_OPEN, _CLOSE = re.compile(r"\A```(?:json|JSON)?\s*", re.ASCII), re.compile(r"\s*```\Z", re.ASCII)
_CODES = frozenset(T.REASON_CODES)


class Odd(Exception):
    """Not for this reader."""


def _number(text: str) -> int:
    if len(text) > MOST_DIGITS:
        raise Odd
    return 0


def _constant(text: str) -> None:
    raise ValueError(text)


_decode = json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_constant).decode


def _bare(text: str, always: bool) -> str:
    out = text.strip(T.BLANK)
    return _CLOSE.sub("", _OPEN.sub("", out)).strip(T.BLANK) if always or out.startswith("```") else out


def _braces(text: str) -> str | None:
    first, last = text.find("{"), text.rfind("}")
    return text[first : last + 1] if 0 <= first < last else None


def _errors(found: dict) -> list[str]:
    if any(f not in found for f in T.FIELDS):
        return ["missing_fields"]
    of = lambda f, known: isinstance(found[f], str) and found[f] in known
    codes = _codes(found["reason_codes"])
    tests = [
        ("invalid_intent", not of("intent", T.INTENTS)), ("invalid_decision", not of("decision", T.DECISIONS)), ("invalid_risk_level", not of("risk_level", T.RISK_LEVELS)),
        ("need_human_not_boolean", not isinstance(found["need_human"], bool)), ("reason_codes_not_strings", codes is None),
        ("invalid_reason_codes", codes is not None and not _CODES.issuperset(codes)), ("explanation_empty", not isinstance(found["explanation"], str) or not found["explanation"]),
    ]
    return [name for name, wrong in tests if wrong]


def _codes(value: object) -> list | None:
    return value if isinstance(value, list) and all(c is None or isinstance(c, str) for c in value) else None


def read(text: str, online: bool) -> dict | None:
    """One answer's result; None if it is odd."""
    if len(text) > MOST_CHARS or text.count("[") + text.count("{") > MOST_BRACKETS or "\\ud" in text or "\\uD" in text:
        return None
    bare = _bare(text, online)
    for candidate in (_braces(bare), bare) if online else (bare, _braces(bare)):
        if candidate is None:
            continue
        try:
            found = _decode(candidate)
        except Odd:
            return None
        except ValueError:
            continue
        if not isinstance(found, dict):
            return {"errors": ["not_an_object"], "json_valid": True, "got": {}}
        for value in (found.get(f) for f in T.FIELDS):
            if isinstance(value, dict) or isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
                return None
        name = lambda f: found[f] if isinstance(found.get(f), str) else None  # noqa: E731, B023
        human = found.get("need_human")
        got = {"decision": name("decision"), "risk_level": name("risk_level"), "need_human": human if isinstance(human, bool) else None, "reason_codes": _codes(found.get("reason_codes"))}
        return {"errors": _errors(found), "json_valid": True, "got": got}
    return {"errors": ["not_json"], "json_valid": False, "got": {}}


def read_batch(texts: pa.Array, online: bool) -> pa.Array:
    """read() of every text, null for null; equal texts are read once."""
    coded = texts.dictionary_encode()
    known = pa.array([read(t, online) for t in coded.dictionary.to_pylist()], _ARROW)
    return known.take(coded.indices)


def offline_batch(texts: pa.Array) -> pa.Array:
    return read_batch(texts, False)


def online_batch(texts: pa.Array) -> pa.Array:
    return read_batch(texts, True)
