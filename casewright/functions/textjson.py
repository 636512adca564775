"""JSON in model answers: lenient and strict readings, and the output contract.

All functions return Columns. Type tests read fields as VARIANT, because casting would accept
"true" for true. The lenient readings keep the last of duplicate keys; the strict one rejects
duplicates at any depth and anything but one object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the output contract, down to FIELDS.
INTENTS = ["refund_request", "return_refund_request", "exchange_request", "complaint", "unknown"]
DECISIONS = ["allow_refund", "allow_return_refund", "allow_exchange", "request_more_evidence", "deny", "manual_review"]
RISK_LEVELS = ["low", "medium", "high"]
REASON_CODES = [
    "within_7_days_unused", "quality_issue_with_evidence", "quality_issue_no_evidence", "fresh_goods_no_reason_denied",
    "customized_goods_no_reason_denied", "virtual_goods_denied", "used_or_not_resellable", "over_7_days_no_quality_issue",
    "high_value_order", "frequent_refund_user", "evidence_conflict", "order_info_conflict", "logistics_issue", "manual_review_required",
]
FIELDS = ["intent", "decision", "risk_level", "need_human", "reason_codes", "explanation"]
#: White space of any kind, ASCII and other.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
THINKING = "<think>\n\n</think>\n\n"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(BLANK))


def strip_fence(text: Column, always: bool = False) -> Column:
    """Without a Markdown code fence; unless always, only where the text starts with one."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json|JSON)?\s*", ""), r"\s*```$", ""))
    return bare if always else F.when(F.startswith(strip(text), F.lit("```")), bare).otherwise(strip(text))


#: Text whose quotation marks pair up, with no apostrophe between strings, and in them no control character
#: and no escape that JSON does not know.
#: Possessive throughout, so it takes one pass and no stack however long the text.
WELL_QUOTED = r"""(?s)\A[^"']*+(?:"[^"\\\x00-\x1f]*+(?:\\["\\/bfnrtu][^"\\\x00-\x1f]*+)*+"[^"']*+)*+\z"""


def is_json(text: Column) -> Column:
    """One JSON value and nothing after it; duplicate keys pass.

    The parser behind get_json_object takes single quotes and raw control characters for JSON, so
    quotation is checked before. The text is read as the first of two array elements whose second is the text's own hash: a text
    that closes the array early, or brings elements of its own, cannot put that hash in its place.
    """
    mark = F.hex(F.xxhash64(text))
    pair = F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))
    return F.coalesce(F.rlike(text, F.lit(WELL_QUOTED)) & (F.get_json_object(pair, "$[1]") == mark), F.lit(False))


def braces(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such part."""
    return F.nullif(F.regexp_extract(text, r"(?s)([{].*[}])", 1), F.lit(""))


def lenient(text: Column) -> Column:
    """JSON text of an answer: the whole of it, else what its braces enclose; null if neither parses."""
    return _first_json(strip_fence(text), lambda bare: [bare, braces(bare)])


def _first_json(bare: Column, candidates) -> Column:
    """The first candidate that is JSON; each is made and parsed once."""
    return F.element_at(F.transform(F.array(bare), lambda b: F.coalesce(*(_parsed(c) for c in candidates(b)))), 1)


def _parsed(text: Column) -> Column:
    return F.element_at(F.transform(F.array(text), lambda t: F.when(is_json(t), t)), 1)


def braces_first(text: Column) -> Column:
    """As lenient, but the braces are tried first and fences always removed."""
    return _first_json(strip_fence(text, always=True), lambda bare: [braces(bare), bare])


def strict_object(text: Column) -> Column:
    """The answer if it is one JSON object without duplicate keys, after at most one empty thinking
    block; else null."""
    bare = strip(F.when(F.startswith(text, F.lit(THINKING)), F.substr(text, F.lit(len(THINKING) + 1))).otherwise(text))
    return F.when(F.startswith(bare, F.lit("{")) & is_json(bare) & F.try_parse_json(bare).isNotNull(), bare)


def fields(json: Column) -> Column:
    """struct of the contract's fields as VARIANT; null if the JSON is no object."""
    return F.when(F.startswith(json, F.lit("{")), F.from_json(json, ", ".join(f"{f} variant" for f in FIELDS)))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def as_text(value: Column) -> Column:
    """A VARIANT's string, null for any other type."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_flag(value: Column) -> Column:
    return F.when(_kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def as_codes(value: Column) -> Column:
    """A VARIANT's strings if it is a list of strings (or empty), else null."""
    return F.when(_kind(value).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(value, "$", "array<string>"))


def contract_errors(json: Column, got: Column | None = None, typed: Column | None = None) -> Column:
    """What an answer lacks, in order; empty if it is valid. Missing fields hide all other errors.

    got and typed: the answer's fields() and values() where they are columns already, so that they
    are read once. A field that is there as JSON null is a VARIANT, a missing one is NULL.
    """
    got = fields(json) if got is None else got
    typed = values(got) if typed is None else typed
    allowed = lambda name, known: ~F.coalesce(typed[name].isin(known), F.lit(False))
    missing = got[FIELDS[0]].isNull()
    for name in FIELDS[1:]:
        missing |= got[name].isNull()
    codes = typed["reason_codes"]
    checks = [
        F.when(allowed("intent", INTENTS), "invalid_intent"),
        F.when(allowed("decision", DECISIONS), "invalid_decision"),
        F.when(allowed("risk_level", RISK_LEVELS), "invalid_risk_level"),
        F.when(typed["need_human"].isNull(), "need_human_not_boolean"),
        F.when(codes.isNull(), "reason_codes_not_strings").when(F.size(F.array_except(codes, F.array(*map(F.lit, REASON_CODES)))) > 0, "invalid_reason_codes"),
        F.when(F.coalesce(typed["explanation"], F.lit("")) == "", "explanation_empty"),
    ]
    return (
        F.when(json.isNull(), F.array(F.lit("not_json")))
        .when(~F.startswith(json, F.lit("{")), F.array(F.lit("not_an_object")))
        .when(missing, F.array(F.lit("missing_fields")))
        .otherwise(F.array_compact(F.array(*checks)))
    )


def values(got: Column) -> Column:
    """struct of the contract's fields with their types; null where the type is another."""
    read = {"need_human": as_flag, "reason_codes": as_codes}
    return F.struct(*(read.get(name, as_text)(got[name]).alias(name) for name in FIELDS))
