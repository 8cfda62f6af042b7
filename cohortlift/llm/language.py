"""Language of documents by averaged subword embeddings and a softmax (see ``subword``).

A text is accepted if the probability of its language is at least a bound. The bound is calibrated: of the rows
kept apart in training that were predicted rightly, ``ACCEPTED_SHARE`` reach it.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and not accepted; a text
with letters always gets the likeliest learned language, accepted or not. Repeated rows are predicted
each. If nothing could be learned every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import batched, fold, table
from cohortlift.llm.subword import BATCH_CHARS, Features, Model, Training, fit

FEATURES = Features(grams=(1, 2, 3), pairs=False, cased=False)
TRAINING = Training(rows_per_class=600, epochs=8)
#: Share of the rightly predicted rows kept apart that the bound of acceptance lets through.
ACCEPTED_SHARE = 0.98
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def acceptance(model: Model, share: float = ACCEPTED_SHARE) -> float:
    """The least probability with which a language is accepted; 0 if no rows were kept apart."""
    return model.confident[int((1 - share) * len(model.confident))] if model.confident else 0.0


def predict(docs: DataFrame, model: Model | None, accept: float | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted); ``accept`` is the bound, by default the calibrated one."""
    if accept is None:
        accept = acceptance(model) if model else 0.0
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            known = [bool(model) and t is not None and _LETTER.search(t) is not None for t in texts]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = [i for i, k in enumerate(known) if k]
            kept = [texts[i] for i in at]
            for a, b in batched(kept, BATCH_CHARS):
                p = model.probabilities(kept[a:b])
                for i, row in zip(at[a:b], p, strict=True):
                    lang[i], score[i] = model.classes[int(row.argmax())], row.max()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(lang), pa.array(score), pa.array((score >= accept) & np.array(known, dtype=bool))],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    schema = f"doc_id {kind}, lang_pred string, score double, accepted boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = docs.where((fold("doc_id", 3) != 1) & F.col("text").isNotNull())
    model = fit(docs, known.select("doc_id", F.col("lang").alias("label")), FEATURES, TRAINING)
    return predict(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted"
    )
