"""Quality by naive Bayes support vectors.

Features are indicators of n-grams: single tokens and pairs of tokens, lower-cased, and runs of one
to three *shapes* (whether a token is lower-cased, capitalised, all capitals, digits or mixed; a run
of punctuation and a line break stand for themselves). Texts are read whole; an n-gram counts once,
however often it occurs. N-grams are hashed to ``2**bits`` places.

Each indicator is scaled by its class log-count ratio, the logarithm of how much larger its share is
among the rows of label 1 than among those of label 0 (both smoothed); a text's scaled indicators
are brought to length 1. Then a linear model with hinge loss is fitted to them by dual coordinate
descent: one row's dual variable at a time is set to its best value between 0 and its bound, and the
weights, the sum of the rows weighted by their duals, follow. The weights are mixed with their mean, which is plain naive
Bayes. Margins become probabilities by a logistic curve fitted to margins that were predicted out of fold, so
that a score doesn't depend on how well the fitted rows are remembered.

Fitted on at most ``sample`` labelled rows (the documented bound), chosen by a hash of their id; all
else covers all rows. A score depends on the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, slices, spread, struct_of
from .toxicity import fit_logistic

_TOKEN = re.compile(r"\n|[^\W_]+|(?:[^\w\s]|_)+")
#: Odd multipliers of the places of an n-gram's parts.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
MEMO = 200_000


def shape(token: str) -> str:
    if not (token[0].isalnum()):
        return token[:8]
    if token.isdigit():
        return "0"
    if token.islower():
        return "a"
    if token.isupper():
        return "A" if len(token) > 1 else "I"
    return "Aa" if token[0].isupper() and token[1:].islower() else "x"


class _Hashes(dict):
    """Token -> hash, worked out where it isn't remembered."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[token] = xxhash.xxh3_64_intdigest(self.of(token).encode("utf-8", "surrogatepass"))
        return out


class Indicators:
    """Which n-grams a text has, as distinct places."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.words, self.shapes = _Hashes(str.lower), _Hashes(lambda t: "shape " + shape(t))
        self.last = np.zeros(1 << bits, dtype=np.int32)

    def places(self, text: str | None) -> np.ndarray:
        tokens = _TOKEN.findall(text or "")
        n = len(tokens)
        w = np.fromiter(map(self.words.__getitem__, tokens), np.uint64, n)
        s = np.fromiter(map(self.shapes.__getitem__, tokens), np.uint64, n)
        grams = [w * _MIX[0], w[:-1] * _MIX[0] + w[1:] * _MIX[1], s * _MIX[0], s[:-1] * _MIX[0] + s[1:] * _MIX[1], s[:-2] * _MIX[0] + s[1:-1] * _MIX[1] + s[2:] * _MIX[2]]
        at = (np.concatenate(grams) >> self.shift).astype(np.int64)
        order = np.arange(len(at), dtype=np.int32)
        self.last[at] = order  # of equal places the last one stays
        return at[self.last[at] == order]


@dataclass
class Model:
    """Of each place its weight times its ratio, and its ratio squared; bias and curve."""

    bits: int
    weight: np.ndarray
    power: np.ndarray
    bias: float
    curve: tuple[float, float]

    def margin(self, places: np.ndarray) -> float:
        size = float(np.sqrt(self.power[places].sum(dtype=np.float64)))
        return self.bias + (float(self.weight[places].sum(dtype=np.float64)) / size if size else 0.0)

    def score(self, places: np.ndarray) -> float:
        z = self.curve[0] * self.margin(places) + self.curve[1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smoothing: float = 1.0, min_rows: int = 3) -> np.ndarray:
    """The logarithm of each place's share among rows of y > 0 over that among the others; 0 where
    fewer than min_rows rows have it."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, v in zip(rows, y, strict=True) if (v > 0) == side)]), minlength=size) for side in (True, False)]
    p, q = (c + smoothing for c in counts)
    seen = counts[0] + counts[1] >= min_rows
    width = max(int(seen.sum()), 1)
    total = [c[seen].sum() + smoothing * width for c in counts]
    return np.where(seen, np.log(p / total[0]) - np.log(q / total[1]), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, bound: float = 1.0, passes: int = 12, tolerance: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|**2 / 2 + bound * the sum of hinge losses, rows being sparse
    (places and values), y 1 or -1. The bias is the weight of a place that all rows have.

    A pass goes over the rows in a new order; rows whose dual is at an end and stays there cost a
    dot product. Ends after ``passes``, or when no projected gradient exceeds the tolerance."""
    w, bias = np.zeros(size), 0.0
    duals, order = np.zeros(len(rows)), np.random.default_rng(seed)
    diagonal = np.array([float(v @ v) + 1 for v in values])
    for _ in range(passes):
        worst = 0.0
        for i in order.permutation(len(rows)).tolist():
            at, v, a = rows[i], values[i], duals[i]
            slope = y[i] * (float(v @ w[at]) + bias) - 1
            projected = min(slope, 0.0) if a == 0 else max(slope, 0.0) if a == bound else slope
            if projected:
                worst = max(worst, abs(projected))
                duals[i] = min(max(a - slope / diagonal[i], 0.0), bound)
                step = (duals[i] - a) * y[i]
                w[at] += step * v
                bias += step
        if worst < tolerance:
            break
    return w, bias


def _fit(rows: list[np.ndarray], y: np.ndarray, bits: int, bound: float, mix: float) -> Model:
    ratio = log_count_ratios(rows, y, 1 << bits)
    kept = [r[ratio[r] != 0] for r in rows]
    values = [ratio[r] for r in kept]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    w, bias = dual_coordinate_descent(kept, values, y, 1 << bits, bound)
    used = ratio != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    weight = np.where(used, (1 - mix) * mean + mix * w, 0.0)
    return Model(bits, (weight * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, (1.0, 0.0))


def fit(labelled: DataFrame, label: str, text: str = "text", id: str = "doc_id", sample: int = 10_000, bits: int = 20, bound: float = 1.0, mix: float = 0.75, folds: int = 3) -> Model:
    """Fit on at most sample rows whose label is 0 or 1; others are left out. Null texts count as
    empty, repeated rows each count. Without rows of both labels every score is the label there is
    (0.5 without any). Folds are dealt out by a hash of the text: exact copies are in one fold.

    The sample's places are the only thing that comes to the driver."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("id"), "id", "text", "y").limit(sample).repartition(spread(labelled.sparkSession))
    schema = struct_of(("order", T.LongType()), ("y", T.IntegerType()), ("places", T.ArrayType(T.IntegerType())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Indicators(bits)
        for batch in slices(batches):
            places = [np.sort(of.places(s.as_py())).astype(np.int32) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.list_(pa.int32()))], names=schema.names)

    coded = rows.select(F.xxhash64("text").alias("order"), "text", "y").mapInArrow(encode, schema).toArrow().sort_by([("order", "ascending"), ("y", "ascending")]).combine_chunks()
    y = coded["y"].to_numpy() * 2.0 - 1.0 if coded.num_rows else np.zeros(0)
    places = [x.values.to_numpy().astype(np.int64) for x in coded["places"]] if coded.num_rows else []
    fold = coded["order"].to_numpy() % folds if coded.num_rows else np.zeros(0)
    none = np.zeros(1 << bits, dtype=np.float32)
    if len(set(y)) < 2:
        return Model(bits, none, none, 0.0, (1.0, 0.0 if not len(y) else 40.0 * y[0]))
    margins = np.zeros(len(y))
    for k in range(folds):
        held, seen = np.flatnonzero(fold == k).tolist(), np.flatnonzero(fold != k).tolist()
        if held and len(set(y[seen])) == 2:
            model = _fit([places[i] for i in seen], y[seen], bits, bound, mix)
            margins[held] = [model.margin(places[i]) for i in held]
    model = _fit(places, y, bits, bound, mix)
    slope, start = fit_logistic(margins[:, None], (y > 0).astype(float), 1e-3)
    model.curve = (max(float(slope), 0.0), float(start))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name``, the probability of label 1 for every row; a null text is scored as the empty
    one. A column of docs of that name (in whatever case) is replaced, all others stay."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == name.lower() and c != text])
    held = free_name(docs.columns, "_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(held, T.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Indicators(model.bits)
        for batch in slices(batches):
            scores = [model.score(of.places(s.as_py())) for s in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema).withColumnRenamed(held, name)


def held_out(id: str = "doc_id"):
    """Whether a row is kept from training: one in four, by the CRC of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4)) == 2, F.lit(False))


def labelled_documents(spark, sf_dir: str, sample: int = 10_000) -> DataFrame:
    """At most sample labelled documents that aren't held out. The labels picked are a table of
    bounded size, so they may be broadcast to the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and quality is not null").where(~held_out())
    some = labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return materialize(texts.join(F.broadcast(some), "doc_id"), "labelled")


def op12_quality(spark, sf_dir: str) -> DataFrame:
    """Score of every document by a model that never saw a held-out label."""
    model = fit(labelled_documents(spark, sf_dir), "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
