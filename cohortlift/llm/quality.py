"""Quality of documents by averaged subword embeddings and a softmax (see ``subword``).

Defined results: null and empty texts have no features and get the score of the bias alone, the same for
all; repeated rows are scored each, equal texts alike; labels that are null or without document are
ignored; without any label the score is 0.5 (predicted 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm.common import batched, fold, table, whole_text
from cohortlift.llm.subword import BATCH_CHARS, Features, Model, Training, fit

FEATURES = Features(grams=(2, 3, 4), cased=True)
TRAINING = Training()


def score(docs: DataFrame, model: Model | None, positive: object = 1) -> DataFrame:
    """(doc_id, score): the probability of the class ``positive``."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = np.full(len(texts), 0.5)
            for a, b in batched(texts, BATCH_CHARS) if model else ():
                p = model.probabilities(texts[a:b])
                found[a:b] = p[:, model.classes.index(positive)] if positive in model.classes else 0.0
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found)], names=["doc_id", "score"])

    plain = docs.select("doc_id", whole_text().alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels.where(fold("doc_id", 3) != 1), FEATURES, TRAINING)
    return score(docs, model).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
