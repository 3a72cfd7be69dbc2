"""A quality classifier by compression.

One zstandard dictionary is built from good labelled texts and one from bad ones. A
text of the good kind packs smaller with the first. The difference of the two sizes,
normalised by the text's length, is the main feature; a logistic calibration turns it,
with how far the text packs at all (which shows repetition), into a probability. The
calibration is fitted on labelled rows that the dictionaries have not seen.

Long texts are packed in pieces of ``PIECE`` bytes, each from the dictionary alone, and the
sizes added up: in one go, what comes late would be packed by the text before it, and a
text would be judged by its opening.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh

#: Bounds of the sample that the model is fitted on: rows of each class for the dictionaries, rows of both for
#: the calibration, and the longest text (characters) that may be in the sample. Scoring has no bound.
DICTIONARY_ROWS, CALIBRATION_ROWS, LONGEST_SAMPLE = 1200, 2400, 20_000
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Bytes packed from the dictionary alone.
PIECE = 8192


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]


class Scorer:
    """Compressors of a model; made once in each Python worker."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = []
        for data in (good, bad):
            book = zstandard.ZstdCompressionDict(data) if data else None
            if book is not None:
                book.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=False, write_checksum=False))

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        """Normalised size difference, its product with the log length, log of the packed share, its square."""
        out = []
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            good, bad = (sum(len(p.compress(data[i : i + PIECE])) for i in range(0, max(1, len(data)), PIECE)) for p in self.packers)
            n = len(data) + 1
            share = np.log((good + bad) / (2 * n))
            out.append((((bad - good) / n), (bad - good) / (bad + good) * np.log(n), share, share * np.log(n)))
        return np.array(out, float).reshape(-1, 4)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method with a small ridge; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to choose from: they are the dictionary as they stand
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def fit(rows: pd.DataFrame) -> Model:
    """From (text, label), label 1 for good, in a fixed order. Of each class every third
    row is kept for calibration. Without rows of both classes the score is constant."""
    parts = {1: ([], []), 0: ([], [])}
    for label, group in rows.groupby("label"):
        for i, t in enumerate(group["text"]):
            parts[int(label)][i % 3 == 2].append(t)
    if not all(parts[k][0] and parts[k][1] for k in parts):
        share = float(rows["label"].mean()) if len(rows) else 0.5
        return Model(b"", b"", [0.0] * 4 + [float(np.log((share + 0.01) / (1.01 - share)))], [0.0] * 4, [1.0] * 4)
    good, bad = (_dictionary(parts[k][0][:DICTIONARY_ROWS]) for k in (1, 0))
    texts = parts[1][1] + parts[0][1]
    y = np.array([1.0] * len(parts[1][1]) + [0.0] * len(parts[0][1]))
    x = Scorer(good, bad).features(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, _logistic((x - mean) / scale, y).tolist(), mean.tolist(), scale.tolist())


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> pd.DataFrame:
    """The bounded labelled sample, in the order of a hash of the id. Held-out rows,
    rows without id or label, and texts over LONGEST_SAMPLE are not in it. An id
    labelled more than once counts once, with its larger label."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    per_class = DICTIONARY_ROWS * 3 // 2 + CALIBRATION_ROWS // 2
    ranked = usable.withColumn("at", F.xxhash64(F.col(id_col).cast("string")))
    chosen = [ranked.where(F.col("label") == k).orderBy("at", id_col).limit(2 * per_class) for k in (0, 1)]
    keys = F.broadcast(chosen[0].unionByName(chosen[1]))  # 4 * per_class rows at most
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(keys, id_col).where(F.length("text") <= LONGEST_SAMPLE)
    nth = [texts.where(F.col("label") == k).orderBy("at", id_col, "text").limit(per_class).select("at", id_col, "text", "label") for k in (0, 1)]
    return nth[0].unionByName(nth[1]).toPandas().sort_values(["label", "at", id_col, "text"])


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; only the text is an input. A null
    text scores as an empty one."""
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.good, model.bad)
        w, mean, scale = np.array(model.weights), np.array(model.mean), np.array(model.scale)
        for texts in batches:
            x = (scorer.features(texts) - mean) / scale
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), dtype="float64")

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out_col, F.pandas_udf(of, "double")(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` and ``predicted`` (1 if the score is 0.5 or more).

    Fitted on ``labels`` (id, label) by :func:`training_rows`. Rows with a null id are
    scored and not held out; repeated rows are scored alike; a null text scores as an empty one;
    without usable labels the score is the constant that they leave. An empty table gives
    no rows. Other columns stay; those named ``held_out``, ``score`` or ``predicted`` are replaced.
    """
    model = fit(training_rows(docs, labels, id_col, text_col, label_col))
    scored = score(docs.withColumn("held_out", held_out(F.col(id_col))), model, text_col)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, in their own columns whatever their names."""
    name = fresh(docs, "__score")
    model = fit(training_rows(docs, labels, id_col, text_col, label_col))
    return score(docs, model, text_col, name).where(F.col(name) >= 0.5).select(*docs.columns)
