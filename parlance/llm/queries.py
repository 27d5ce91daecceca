"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from parlance.llm.audit import OP11_SQL, op11_filter_audit
from parlance.llm.decontaminate import op3_decontaminate
from parlance.llm.language_model import op9_language_model
from parlance.llm.manifest import OP12_SQL, op12_manifest
from parlance.llm.mixing import OP4_SQL, op4_mixing
from parlance.llm.pii import op8_pii
from parlance.llm.repeats import op10_repeats
from parlance.llm.secrets import op6_secrets
from parlance.llm.simhash import op1_simhash
from parlance.llm.sketch import op7_sketch
from parlance.llm.tokens import op5_tokens
from parlance.llm.toxicity import op2_toxicity
from parlance.llm.url_filter import OP13_SQL, op13_url_filter

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_tokens": op5_tokens,
    "op6_secrets": op6_secrets,
    "op7_sketch": op7_sketch,
    "op8_pii": op8_pii,
    "op9_language_model": op9_language_model,
    "op10_repeats": op10_repeats,
    "op11_filter_audit": op11_filter_audit,
    "op12_manifest": op12_manifest,
    "op13_url_filter": op13_url_filter,
}
SQL = {"op4_mixing": OP4_SQL, "op11_filter_audit": OP11_SQL, "op12_manifest": OP12_SQL, "op13_url_filter": OP13_SQL}
