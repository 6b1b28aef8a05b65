"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  A
text is cut into pieces and every piece is compressed with both; the difference of
the two total sizes over their sum says which kind of text it resembles.  A
logistic curve over that difference and the compression rate, fitted on labelled rows that no
dictionary has seen, makes it a probability.

The fit reads a bounded sample of labelled rows (``per_class`` of each class);
every whole text is scored, piece by piece, in one pass without a shuffle.

Edge cases: null and empty texts get the score of a text of size 0; labels other than 0 and 1
and labels without a document are ignored; without labels of both
kinds every score is 0.5; repeated rows come back once per row; a null id is not held out;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import class_weights, fold, labelled_sample, logistic, share_of_ones, sigmoid
from .stages import read

PER_CLASS = 3000
DICTIONARY = 96 * 1024
PIECE = 2048
LEVEL = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    coefficients: np.ndarray
    centre: np.ndarray
    spread: np.ndarray


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where the trainer finds too little text, the text itself serves as one."""
    parts = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:] or b"\n"


class Scales:
    """Compressors of both kinds."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def weigh(self, text: str) -> tuple[float, float]:
        """Normalised size difference (positive: nearer to good) and compression rate."""
        data = text.encode()
        parts = pieces(data)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.pair)
        return (bad - good) / (bad + good), np.log((bad + good) / (2 * (len(data) + 8 * len(parts))))


def expand(raw: np.ndarray) -> np.ndarray:
    d, r = raw[:, 0], raw[:, 1]
    return np.column_stack([d, r, d * d, d * r, r * r])


def fit(sample: list[tuple[str, int, int]], share: float = 0.5) -> Model | None:
    """Dictionaries from the even draws, the curve from the odd ones, weighted to the share of good labels."""
    sides = [[t.encode() for t, label, draw in sample if label == c and draw % 2 == 0] for c in (1, 0)]
    if not all(sides):
        return None
    good, bad = (dictionary(s) for s in sides)
    scales = Scales(good, bad)
    rest = [(t, label) for t, label, draw in sample if draw % 2] or [(t, label) for t, label, _ in sample]
    x = expand(np.array([scales.weigh(t) for t, _ in rest]))
    y = np.array([label for _, label in rest], dtype=float)
    if y.min() == y.max():
        return None
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(good, bad, logistic((x - centre) / spread, y, class_weights(y, share), 0.1), centre, spread)


def score_rows(model: Model | None):
    """Arrow function: text last of the columns -> the other columns and a score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scales = Scales(model.good, model.bad) if model else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            if scales is None or not len(texts):
                score = np.full(len(texts), 0.5)
            else:
                x = expand(np.array([scales.weigh(t.as_py() or "") for t in texts]))
                z = np.column_stack([(x - model.centre) / model.spread, np.ones(len(x))]) @ model.coefficients
                score = sigmoid(z)
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*names, "score"])

    return run


def quality_model(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS
) -> Model | None:
    """Fitted on labelled rows outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    usable = F.coalesce(fold(F.col("id"), 3) != 1, F.lit(True))
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, usable, per_class)
    return fit(sample, share_of_ones(labels, label_col, id_col, usable))


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(score_rows(model), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(fold(F.col("id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted_rows(model: Model | None, text_col: str):
    """Arrow function: the rows whose score is at least 0.5, all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = score_rows(model)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col))], names=["text"])
            (scored,) = scorer(iter([texts]))
            yield batch.filter(pa.array(scored.column(0).to_numpy() >= 0.5))

    return run


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents the classifier does not reject, all columns."""
    return docs.mapInArrow(accepted_rows(quality_model(docs, labels, id_col, text_col), text_col), docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, quality_model(docs, read(spark, sf_dir, "labels")))
