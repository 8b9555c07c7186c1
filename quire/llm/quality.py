"""Quality by ordinal cumulative-link regression over hashed text features.

Ratings have grades 0 (low quality), 1 (good, but toxic) and 2 (good).  One weight vector is shared by all grades and
ordered cut points separate them: P(grade >= k) = sigmoid(w.x - cut_k).  Selection goes by the expected grade (the sum of
these chances) and by the tail chance of reaching SELECT_GRADE.

Fitted on a bounded sample of labelled rows (see ``hashlinear``), of which those with crc32(id as text) mod 4 = 2 are held
out, so that accuracy can be measured on them.  A null ``toxic`` counts as not toxic; a null ``quality`` is no rating.
Without ratings all chances come from even cut points.  Rows that are equal, or equal in id, are scored each for itself.
Null counts as empty text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.hashlinear import SAMPLE, Matrix, Model, fit_ordinal, held_out, sample, tails

GRADES = 3
#: A document is selected if it reaches this grade with at least this chance.
SELECT_GRADE, SELECT_CHANCE = 1, 0.5


def ratings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, y): rated documents that are not held out; several ratings of an id count as their rounded mean."""
    grade = F.when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(2)).otherwise(0)
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg(grade)).alias("y"))
    return docs.select("doc_id", "text").join(known.filter(~held_out()), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    y, sketches, _ = sample(ratings(docs, labels), most)
    return fit_ordinal(Matrix(sketches), y.astype(np.int64), GRADES)


def graded(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, expected_grade (0 to 2), tail_probability (of SELECT_GRADE), selected (boolean): one row for each input row."""
    got = tails(docs, fit(docs, labels, most))
    tail = F.col("q_tails")[SELECT_GRADE - 1]
    return got.select("doc_id", held_out().alias("held_out"), F.aggregate("q_tails", F.lit(0.0), lambda s, p: s + p).alias("expected_grade"), tail.alias("tail_probability"), (tail >= SELECT_CHANCE).alias("selected"))
