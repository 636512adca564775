"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

import corpus_pipeline
from casewright.llm import embeddings, exact, iblt, langid, lexical, licenses, lm, mixing, packing, prefixtrie, quality, simhash, urls


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_langid": langid.op2_langid,
        "op3_licenses": licenses.op3_licenses,
        "op4_mixing": mixing.op4_mixing,
        "op5_quality": quality.op5_quality,
        "op6_lm": lm.op6_lm,
        "op7_packing": packing.op7_packing,
        "op8_fingerprints": iblt.op8_fingerprints,
        "op9_embeddings": embeddings.op9_embeddings,
        "op10_urls": urls.op10_urls,
        "op11_exact": exact.op11_exact,
        "op12_trie": prefixtrie.op12_trie,
        "op13_lexical": lexical.op13_lexical,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op10_urls": urls.ORACLE, "op11_exact": exact.ORACLE, "op12_trie": prefixtrie.ORACLE, "op13_lexical": lexical.ORACLE}
