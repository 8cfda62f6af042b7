"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlift.llm import secrets_sql
from cohortlift.llm.chat import OP6_SQL, op6_chat
from cohortlift.llm.decontamination import op7_decontamination
from cohortlift.llm.fingerprints import op1_fingerprint
from cohortlift.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from cohortlift.llm.language import op4_language
from cohortlift.llm.mixing import op10_mixing
from cohortlift.llm.pii import op8_pii
from cohortlift.llm.quality import op2_quality
from cohortlift.llm.secrets import op9_secret_scan
from cohortlift.llm.simhash import op5_simhash
from cohortlift.llm.spelling import OP12_SQL, op12_spelling
from cohortlift.llm.topk import OP11_SQL, op11_topk
from cohortlift.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: list[Query] = [
    op1_fingerprint, op2_quality, op3_toxicity, op4_language, op5_simhash, op6_chat,
    op7_decontamination, op8_pii, op9_secret_scan, op10_mixing, op11_topk, op12_spelling,
    op13_hard_negatives,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_chat": OP6_SQL,
        "op9_secret_scan": secrets_sql.build(),
        "op11_topk": OP11_SQL,
        "op12_spelling": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
