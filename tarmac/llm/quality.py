"""Quality scores from two zstandard dictionaries, one built from good and one from bad labelled text.

A text is cut into pieces of ``PIECE`` bytes (all of them; the last may be shorter), each piece is compressed with either
dictionary, and the sizes are summed. The difference (bad size minus good size) over the text's bytes tells which
dictionary fits better; with the compressed share of the text it goes through a logistic calibration.

Fitting takes a bounded sample of the labelled rows (``per_label`` documents of each label, in the order of a hash of
their ids, and among those whose text has at most ``max_fit_bytes`` bytes); scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import filter_rows, map_rows, table

PIECE = 2048
DICT_BYTES = 32768
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration's weights: a few dozen KB, whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        """A function from text (None: empty) to a score from 0 to 1."""
        compressors = _compressors(self.good, self.bad)
        w = np.array(self.weights)

        def score(text: str | None) -> float:
            return float(_sigmoid(_inputs(text, compressors) @ w))

        return score


def _compressors(good: bytes, bad: bytes):
    return [
        zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        for d in (good, bad)
    ]


def _inputs(text: str | None, compressors) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    good, bad = compressors
    sizes = [(len(good.compress(p)), len(bad.compress(p))) for p in _pieces(data)]
    g, b = (sum(x) for x in zip(*sizes, strict=True))
    n = max(1, len(data))
    return np.array([1.0, (b - g) / n, min(g, b) / n, (b - g) / n * np.log1p(n)])


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def held_out(id_col):
    """Whether a row is kept from fitting: crc32 of the id's text is a multiple of five; null for a null id, which has no label."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2000, max_fit_bytes: int = 65536) -> QualityModel:
    """Fit on the rows that ``held_out`` leaves. Labels other than 0 and 1, and null texts, are ignored.

    Half of the sample trains the dictionaries, the other half the calibration. Where a label has fewer than eight
    documents, nothing can be told: every score is then the share of label 1 (0.5 without labels).
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").dropDuplicates(["doc_id"]).where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id").cast("long"))
    chosen = [usable.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_label) for q in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # at most 2 * per_label rows: small enough to broadcast
    fits = F.octet_length("text") <= max_fit_bytes
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(fits).join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text").collect()
    rows = sorted({(r.doc_id, r.quality, r.text) for r in rows})
    texts = {q: [t.encode("utf-8", "surrogatepass") for _, label, t in rows if label == q] for q in (0, 1)}
    if min(map(len, texts.values())) < 8:
        share = len(texts[1]) / len(rows) if rows else 0.5
        share = min(max(share, 0.01), 0.99)
        return QualityModel(b"good", b"bad", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    dictionaries = {q: _dictionary(texts[q][::2]) for q in (0, 1)}
    compressors = _compressors(dictionaries[1], dictionaries[0])
    x = np.array([_inputs(t.decode("utf-8", "surrogatepass"), compressors) for q in (0, 1) for t in texts[q][1::2]])
    y = np.array([q for q in (0, 1) for _ in texts[q][1::2]], dtype=float)
    seen = usable.groupBy("quality").count().collect()
    counts = {r["quality"]: r["count"] for r in seen}
    prior = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))
    return QualityModel(dictionaries[1], dictionaries[0], tuple(_logistic(x, y, prior / prior.mean())))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [p for t in texts for p in _pieces(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"\n".join(pieces)[-DICT_BYTES:] or b"\n"


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Weighted logistic regression by Newton's steps on standardised inputs."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    mean[0], sd[0] = 0.0, 1.0
    sd[sd == 0] = 1.0
    z, w = (x - mean) / sd, np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(z @ w)
        grad = z.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    out = w / sd
    out[0] = w[0] - (w[1:] * mean[1:] / sd[1:]).sum()
    return out.tolist()


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per input row, whole texts; null and empty texts are scored as empty. Ids may be null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(columns):
        scorer = sent.value.scorer()
        for i, text in zip(*columns, strict=True):
            yield i, scorer(text)

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "id long, score double", rows)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, all columns as they are.

    Null and empty texts have the score of an empty text; repeated rows stay or go together; ids are not looked at (rows may
    lack one). An empty table stays empty; without labels every text scores 0.5.
    """
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(columns):
        scorer = sent.value.scorer()
        return [scorer(text) >= threshold for text in columns[0]]

    return filter_rows(docs, ["text"], keep)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), F.col("score"),
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
