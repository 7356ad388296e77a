"""Quality classifier: naive Bayes support vectors over token n-grams.

See kerf.llm.nbsvm for the method and its treatment of nulls, empty and long texts, ties and repeated rows. Empty
tables give empty results. Other columns of the input are not read and are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import nbsvm
from kerf.llm.common import crc_mod

LABEL_MOD, LABEL_HELD = 4, 2
#: Bound of the labelled sample that the driver fits on, for each class.
TEXTS_PER_CLASS = 4000
THRESHOLD = 0.7


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS) -> nbsvm.Model:
    texts, y, share = nbsvm.labelled_sample(docs, labels, "quality", LABEL_MOD, LABEL_HELD, per_class)
    return nbsvm.fit(texts, y, share, nbsvm.token_ngrams, cost=1.0, min_texts=5, unit=True)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row of docs."""
    scored = nbsvm.score_texts(docs, fit_quality(docs, labels, per_class), nbsvm.token_ngrams)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), LABEL_MOD) == LABEL_HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = TEXTS_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs with a score of at least threshold, all columns kept, whatever their names; text must be a string
    column. Null ids and repeated rows are scored row by row; an empty table stays empty."""
    own = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    kept = nbsvm.score_texts(own, fit_quality(docs, labels, per_class), nbsvm.token_ngrams, whole_rows=True).where(F.col("score") >= threshold)
    return kept.drop("score").toDF(*docs.columns)
