"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text is cut into pieces
(so that the dictionaries matter to the end of a long one), every piece is compressed with either,
and the difference of the two total sizes, by the size of the text, is its feature. A logistic curve
fitted on other labelled texts turns it into the probability of label 1.

Dictionaries and curve come from a bounded sample: of the labelled documents at most ``sample_rows``
and ``sample_bytes``, those with the smallest hash of their id; a longer text than one of ``SHARES``
parts of these bytes teaches by its beginning, so that it leaves room for others. Every other document of the
sample trains the dictionaries, the rest the curve.

Edges: a null or empty text has feature 0 and the score that goes with it. Without labelled text of
both classes every score is the share of label 1 in the sample, or one half. Labels other than 0
and 1, null labels and null ids teach nothing. Repeated rows are documents of their own. Other
columns of the input are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from metertide.llm.batches import slices
from metertide.workspace import materialize

PIECE, LEVEL = 512, 3
DICTIONARY_BYTES = 112_640
#: Added to a text's size, so that a few bytes do not decide.
SOFTENING = 64
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 48 << 20
SHARES = 64
#: Pieces of a class that go into its dictionary at most.
DICTIONARY_PIECES = 12_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries for good and bad text (empty: none), and the curve's slope and intercept."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def train_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES``, from pieces evenly spread over the texts."""
    parts = [part for text in texts for part in pieces(text)]
    step = max(1, -(-len(parts) // DICTIONARY_PIECES))
    parts = parts[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to find anything common in it
        return b"".join(parts)[-DICTIONARY_BYTES:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **options)


def feature(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Bytes that the good dictionary saves over the bad one, per byte of text."""
    saved = 0
    for part in pieces(text):
        saved += len(bad.compress(part)) - len(good.compress(part))
    return saved / (len(text) + SOFTENING)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton's method, with a weak pull to 0."""
    scale = max(float(np.std(x)), 1e-9)
    design = np.column_stack([x / scale, np.ones(len(x))])
    weights, ridge = np.zeros(2), np.diag([0.1, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (y - p) - ridge @ weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def learn_quality(
    documents: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> QualityModel:
    """The model, from ``labels`` (doc_id, quality) of ``documents`` (doc_id, text)."""
    wanted = (
        labels.select("doc_id", "quality")
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .withColumn("_order", F.xxhash64(F.col("doc_id")))
        .orderBy("_order", "doc_id", "quality")
        .limit(sample_rows)
    )
    share = max(1, sample_bytes // SHARES)
    sample = materialize(
        documents.select("doc_id", "text")
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(wanted), "doc_id")  # at most sample_rows rows of three numbers
        .withColumn("_bytes", F.least(F.octet_length("text"), F.lit(share))),
        "quality-sample",
    )
    order = ("_order", "doc_id", "quality", "_bytes")
    sizes = sample.orderBy(*order).select(*order).limit(2 * sample_rows).toPandas()
    kept = sizes[sizes["_bytes"].cumsum() <= sample_bytes]
    if not len(kept):
        return QualityModel(b"", b"", 0.0, 0.0)
    rows = (
        sample.filter(F.col("_order") <= int(kept["_order"].iloc[-1]))
        .orderBy(*order, "text")
        .limit(len(kept))
        .select(F.substring(F.col("text").cast("binary"), 1, share).alias("text"), "quality")
        .toPandas()
    )
    texts, quality = [bytes(t) for t in rows["text"]], rows["quality"].to_numpy()
    share = (quality.sum() + 0.5) / (len(quality) + 1)
    base = float(np.log(share / (1 - share)))
    halves = [[t for t, q in zip(texts[::2], quality[::2], strict=True) if q == k] for k in (1, 0)]
    if not halves[0] or not halves[1] or len(set(quality[1::2])) < 2:
        return QualityModel(b"", b"", 0.0, base)
    good, bad = (train_dictionary(x) for x in halves)
    pair = compressor(good), compressor(bad)
    x = np.array([feature(t, *pair) for t in texts[1::2]])
    return QualityModel(good, bad, *fit_curve(x, quality[1::2].astype(float)))


def score_quality(
    documents: DataFrame, model: QualityModel, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id``, ``saved`` (the feature), ``score`` and ``predicted`` of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = compressor(model.good), compressor(model.bad)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            x = np.array([feature((t or "").encode(), good, bad) for t in texts], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(x), pa.array(p),
                 pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "saved", "score", "predicted"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, saved double, score double, predicted int"
    )
