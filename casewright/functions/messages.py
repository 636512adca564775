"""Chat messages as arrays of (role, content): building, editing, rendering; text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.layout import hash_key

MESSAGES = "array<struct<role: string, content: string>>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build(system: Column | None, user: Column, assistant: Column | None = None) -> Column:
    """System, user and assistant messages; those that are null or empty are left out."""
    listed = [message(r, c) for r, c in (("system", system), ("user", user), ("assistant", assistant)) if c is not None]
    return F.filter(F.array(*listed), lambda m: F.coalesce(m["content"], F.lit("")) != "")


def without_role(messages: Column, role: str = "system") -> Column:
    return F.filter(messages, lambda m: m["role"] != role)


def with_system(messages: Column, system: Column) -> Column:
    """messages with this system text in front instead of their own; none if it is empty."""
    head = F.filter(F.array(message("system", system)), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return F.concat(head, without_role(messages))


def last_of(messages: Column, role: str = "user", default: Column | None = None) -> Column:
    """Content of the role's last message, else default."""
    found = F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]
    return found if default is None else F.coalesce(found, default)


def flatten(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


def characters(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"]))


def collected(turns: DataFrame, key: str, turn: str) -> DataFrame:
    """(key, messages): a conversation's turns in order. Conversations are short."""
    listed = F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def user_prompt(request: Column, facts: Column, evidence: Column) -> Column:
    """Request, facts as JSON and, where there is one, the evidence line."""
    return F.concat_ws("\n", request, F.concat(F.lit("facts: "), facts), F.concat(F.lit("evidence: "), evidence))


def prompt_metadata(text: Column) -> Column:
    """struct(sample_id, prompt_exposure) named in a prompt; the id of the active order stands in for a
    missing sample_id."""
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    sample = F.coalesce(found(r"sample_id:\s*([A-Za-z0-9_\-]+)"), found(r"C-ACTIVE-([A-Za-z0-9_\-]+)"))
    return F.struct(sample.alias("sample_id"), found(r"prompt_exposure:\s*(full|partial|minimal|no_skill)").alias("prompt_exposure"))


def cycled(items: Sequence[str], n: Column) -> Column:
    """The items repeated in turn, n in all."""
    listed = F.array(*map(F.lit, items))
    steps = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.element_at(listed, i % len(items) + 1))


def shuffled_lines(lines: Column, *seed: Column | str) -> Column:
    """Lines in the order of their hashes with the row's seed."""
    keyed = F.transform(lines, lambda x: F.struct(hash_key(*seed, x).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def composed(components: Sequence[tuple[str, Column]], bits: Column) -> Column:
    """The texts whose flag in the struct of bits is set, one a line."""
    return F.array_join(F.array_compact(F.array(*(F.when(bits[name], text) for name, text in components))), "\n")


def normalised_lines(text: Column) -> Column:
    """Unix line ends, no blanks at line ends, no empty lines at the edges. Unicode is left as it is."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?m)[ \t]+$", "")
    return F.regexp_replace(lines, r"^\n+|\n+$", "")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    size = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, size).otherwise((differ - 1).cast("int"))


def span_inside(first: Column, last: Column, from_: Column, to: Column) -> Column:
    """Whether the span first to last (last left out) is not empty and lies within from_ to to."""
    return F.coalesce((first < last) & (first >= from_) & (last <= to), F.lit(False))


def completion_mask(full: Column, prompt: Column, ignore: int = -100) -> Column:
    """Labels of a token list: ignore over what it shares with the prompt, the tokens after that."""
    n = common_prefix(full, prompt)
    return F.concat(F.array_repeat(F.lit(ignore), n), F.slice(full, n + 1, F.size(full)))


#: What must not be published; a fixed list.
SECRETS = {
    "openai_key": r"sk-[A-Za-z0-9]{20,}",
    "hf_token": r"hf_[A-Za-z0-9]{20,}",
    "wandb_key": r"(?i)(?:wandb|w\.andb)[-_]?[A-Za-z0-9]{20,}",
    "private_path": r"(?i)(?<![A-Za-z0-9_])(?:[A-Za-z]:\\|/home/|/data/|/root/|/Users/)",
    "credential_assignment": r"(?i)(?:api[_-]?key|token|password)\s*[:=]\s*['\"][^'\"]+",
}


def secret_counts(text: Column, patterns: dict[str, str]) -> list[Column]:
    return [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long").alias(name) for name, p in patterns.items()]


def match_lines(text: Column, pattern: str) -> Column:
    """Line (from 1) at which each match of a pattern in a text begins, in order; several on one line are told each.

    A text falls into what lies between the matches and the matches themselves; line ends of both are added up
    once. The pattern matches no empty text.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n")))
    steps = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(found)), ends).alias("b"), F.transform(found, ends).alias("m"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("lines"))
    step = lambda s, x: F.struct((s["at"] + x["b"] + x["m"]).alias("at"), F.concat(s["lines"], F.array(s["at"] + x["b"])).alias("lines"))
    return F.aggregate(steps, start, step)["lines"]


def secret_places(text: Column, patterns: dict[str, str]) -> Column:
    """Array of (finding, line) of all matches of all patterns."""

    def places(name: str, pattern: str) -> Column:
        return F.transform(match_lines(text, pattern), lambda n: F.struct(F.lit(name).alias("finding"), n.alias("line")))

    each = [places(name, p) for name, p in patterns.items()]
    return F.coalesce(F.concat(*each), F.array().cast("array<struct<finding: string, line: int>>"))
