"""Quality by compression: a text is compressed with a zstandard dictionary built from good and one
built from bad labelled texts; the difference of the sizes for each byte becomes a calibrated score.

A text is compressed in blocks of BLOCK bytes, all of them, so that the dictionary and not the text's own
beginning explains each block.  Fitting takes a bounded sample (PER_CLASS whole texts of each label): half of it builds the dictionaries, the other half calibrates the difference by a
one-dimensional logistic curve, so that the curve sees differences as of unknown texts.

Rules: a null or empty text has no evidence and scores the share of label 1.  With no labels of one
class the score is that of the other class, with none at all 0.5.  Equal texts get equal scores.
"""

from __future__ import annotations

import math

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, keep_rows, kind, map_rows, pick, sample_of_labels, spread

BLOCK, LEVEL, DICT_BYTES = 2048, 3, 64 << 10
PER_CLASS = 800
THRESHOLD = 0.7
#: A text of so many bytes counts half by its own difference and half by the prior.
PRIOR_BYTES = 64


def sigmoid(v: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, v))))


class Model:
    """good and bad: dictionary bytes; a and b: the curve's slope and offset; prior: log odds of label 1."""

    def __init__(self, good: bytes, bad: bytes, a: float, b: float, prior: float):
        self.good, self.bad, self.a, self.b, self.prior = good, bad, a, b, prior
        self._tools = None

    def __getstate__(self):
        return self.good, self.bad, self.a, self.b, self.prior

    def __setstate__(self, state):
        self.__init__(*state)

    def difference(self, text: str | None) -> float:
        """(size with the bad dictionary - size with the good one) / bytes."""
        data = (text or "").encode("utf-8")
        if not data or not self.good or not self.bad:
            return 0.0
        if self._tools is None:
            self._tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        good, bad = (t.compress for t in self._tools)
        total = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            total += len(bad(block)) - len(good(block))
        return total / len(data)

    def score(self, text: str | None) -> float:
        w = weight(len((text or "").encode("utf-8")))
        return sigmoid(w * (self.a * self.difference(text) + self.b) + (1 - w) * self.prior)


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary for texts like these.  Where the trainer finds too little, their plain bytes."""
    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)


def weight(n: int) -> float:
    """How far n bytes are evidence of their own."""
    return n / (n + PRIOR_BYTES)


def curve(x: list[float], n: list[int], y: list[int], prior: float) -> tuple[float, float]:
    """Logistic slope and offset by Newton's method, with a weak pull to 0 on the slope; a text of few
    bytes is drawn to the prior log odds."""
    scale = max(1e-9, (sum(v * v for v in x) / len(x)) ** 0.5)
    rows = [(v / scale * weight(k), weight(k), (1 - weight(k)) * prior, t) for v, k, t in zip(x, n, y)]
    a = b = 0.0
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for v, w, base, t in rows:
            p = sigmoid(a * v + b * w + base)
            q = max(1e-9, p * (1 - p))
            g0, g1 = g0 + (p - t) * v, g1 + (p - t) * w
            h00, h01, h11 = h00 + q * v * v, h01 + q * v * w, h11 + q * w * w
        g0, h00, h11 = g0 + 0.05 * a, h00 + 0.05, h11 + 1e-6
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 4 / max(1e-9, abs(da), abs(db)))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return a / scale, b


def fit(rows: list[tuple[str, int]], prior: float | None = None) -> Model:
    """rows: (text, label).  prior: the share of label 1 among all labelled rows, to which the offset is
    corrected when the sample has another share."""
    by = {v: [t.encode("utf-8") for t, y in rows if y == v and t] for v in (0, 1)}
    if not by[0] or not by[1]:
        return Model(b"", b"", 0.0, sure := 0.0 if not rows else 3.0 if by[1] else -3.0, sure)
    half = {v: (t[::2], t[1::2] or t) for v, t in by.items()}
    held = [(t, v) for v in (0, 1) for t in half[v][1]]
    share = sum(v for _, v in held) / len(held)
    odds = math.log(share / (1 - share))
    m = Model(dictionary(half[1][0]), dictionary(half[0][0]), 0.0, 0.0, odds)
    m.a, m.b = curve([m.difference(t.decode("utf-8")) for t, _ in held], [len(t) for t, _ in held], [v for _, v in held], odds)
    if prior is not None and 0 < prior < 1:
        m.prior = math.log(prior / (1 - prior))
        m.b += m.prior - odds
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, train=None, per_class: int = PER_CLASS, label: str = "quality") -> Model:
    """The model of the rows that train (a Column over doc_id) admits, from a sample of per_class of each label."""
    train = F.lit(True) if train is None else train
    counts = dict(pick(labels, "doc_id", label).where(train & F.col(label).isin(0, 1)).groupBy(label).count().collect())
    prior = counts.get(1, 0) / max(1, counts.get(0, 0) + counts.get(1, 0))
    return fit(sample_of_labels(docs, labels, label, train, per_class), prior)


def score_quality(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, for every row."""
    df = pick(df, doc_id, text)
    return map_rows(df, f"`{doc_id}` {kind(df, doc_id)}, score double", lambda: lambda i, t: (i, model.score(t)))


def keep_good(df: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that score threshold or more, with all their columns."""
    return keep_rows(df, text, lambda: lambda t: model.score(t) >= threshold)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(spread(docs), fit_quality(docs, labels, fold("doc_id", 4) != 2))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
