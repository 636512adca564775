"""Locked splits: content hashes by skill and split, checked before a split is read; sealed splits are not read at all.

A manifest is a small table (skill_id, split, cases, case_sha256, facts_sha256, text_sha256, locked). Cases and
texts are hashed in the order of their slots, facts as a multiset, all in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import hashtree, layout

SEALED = ("confirmation",)
HASHES = ["case_sha256", "facts_sha256", "text_sha256"]
KEY = ["skill_id", "split"]


def split_manifest(cases: DataFrame, text: str, sealed: Sequence[str] = SEALED, depth: int = 0) -> DataFrame:
    """The manifest of cases (skill_id, split, slot from 1, semantic_case_hash, facts_hash, text). depth is that of
    the facts' hash tree (hashtree.depth_for the largest split); a manifest is compared at the depth it was made with."""
    counts = cases.groupBy(*KEY).agg(F.count("*").alias("cases"))
    out = counts.join(layout.ordered_hash(cases, KEY, "semantic_case_hash", "slot", "case_sha256"), KEY)
    facts = hashtree.root(hashtree.hash_tree(cases, KEY, "facts_hash", depth)).select(*KEY, F.col("h").alias("facts_sha256"))
    out = out.join(facts, KEY).join(layout.ordered_hash(cases, KEY, text, "slot", "text_sha256"), KEY)
    return out.select(*KEY, "cases", *HASHES, F.col("split").isin(list(sealed)).alias("locked"))


def manifest_errors(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(skill_id, split, problem): splits that are missing, unknown, or have another number, content or lock than stored."""
    fields = ["cases", *HASHES, "locked"]
    a, b = (df.select(*(F.col(k).alias(f"{s}_{k}") for k in KEY), *(F.col(f).alias(f"{s}_{f}") for f in fields)) for s, df in (("s", stored), ("n", now)))
    both = a.join(b, (F.col("s_skill_id") == F.col("n_skill_id")) & (F.col("s_split") == F.col("n_split")), "full")
    present = F.col("s_split").isNotNull() & F.col("n_split").isNotNull()
    problems = F.array_compact(F.array(
        F.when(F.col("n_split").isNull(), "missing"), F.when(F.col("s_split").isNull(), "unknown"),
        *(F.when(present & ~F.col(f"s_{f}").eqNullSafe(F.col(f"n_{f}")), f) for f in fields),
    ))
    return both.select(*(F.coalesce(f"s_{k}", f"n_{k}").alias(k) for k in KEY), F.explode(problems).alias("problem"))


def read_split(cases: DataFrame, manifest: DataFrame, split: str, text: str, depth: int = 0) -> DataFrame:
    """The cases of one split, after their hashes have been found to be the manifest's. Raises PermissionError for a
    split that is locked for any skill (or has a sealed name), LookupError for one that the manifest does not have,
    ValueError for one whose content differs."""
    entries = manifest.where(F.col("split") == split)
    found = entries.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("locked"), F.lit(False)).alias("locked")).first()
    if found["locked"] or split in SEALED:
        raise PermissionError(f"split {split} is locked")
    if not found["n"]:
        raise LookupError(f"no split {split} in the manifest")
    rows = cases.where(F.col("split") == split)
    if wrong := manifest_errors(entries, split_manifest(rows, text, depth=depth)).limit(5).collect():
        raise ValueError(f"split {split} is not what the manifest says: {[tuple(r) for r in wrong]}")
    return rows


def audit(cases: DataFrame, manifest: DataFrame, text: str, depth: int = 0) -> DataFrame:
    """manifest_errors of all splits, sealed ones too: hashes are compared, no case is given out."""
    return manifest_errors(manifest, split_manifest(cases, text, depth=depth))
