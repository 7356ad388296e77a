"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

See kerf.llm.nbsvm for the method and its treatment of nulls, empty and long texts, ties and repeated rows. Empty
tables give empty results. Other columns of the input are not read and are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import nbsvm
from kerf.llm.common import crc_mod

LABEL_MOD, LABEL_HELD = 5, 0
#: Bound of the labelled sample that the driver fits on, for each class.
TEXTS_PER_CLASS = 2000
THRESHOLD = 0.5


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row of docs."""
    texts, y, share = nbsvm.labelled_sample(docs, labels, "toxic", LABEL_MOD, LABEL_HELD, per_class)
    scored = nbsvm.score_texts(docs, nbsvm.fit(texts, y, share, nbsvm.char_ngrams), nbsvm.char_ngrams)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), LABEL_MOD) == LABEL_HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
