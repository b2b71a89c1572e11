"""Toxicity: classifier chains over sparse text features.

A chain orders its categories. Each category has one linear (logistic) model whose inputs are
the features of the text and the probabilities of all earlier categories. While training, the
earlier probabilities are out-of-fold predictions, so that a later model meets inputs as
unreliable as those it will get for new texts; when applied, the models run one after another.

Features are presences, not counts or shares: a document of 20,000 words with one slur has the
feature as much as a short one. For each lower-cased token (word or run of punctuation) there
is the token and its prefixes of 3 to 6 letters, which also find inflected or compounded forms
that the labelled rows lack; and a few shapes of the whole text. Only features whose presence
differs between the classes by at least ``min_z`` standard errors are kept, at most
``max_features`` a category, which bounds the model. Texts are always read whole.

Out-of-fold means that nothing of a fold is used for its predictions: neither for the weights
nor for the choice of features. Folds are dealt out by a hash of the text, so that exact copies
are in one fold.

The models are fitted on at most ``sample`` labelled rows (the documented bound), chosen by a
hash of their id; everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, slices, spread, struct_of

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
PREFIXES = (3, 4, 5, 6)
MEMO = 200_000


def token_features(token: str) -> list[str]:
    """The token, and its prefixes marked by a trailing star."""
    return [token, *(token[:n] + "*" for n in PREFIXES if len(token) >= n and token[0].isalpha())]


def shapes(tokens: list[str], distinct: set[str]) -> list[str]:
    """Marks of the whole text."""
    out = []
    upper = sum(1 for w in distinct if w.isupper() and len(w) > 1)
    if upper * 2 > len(distinct):
        out.append("#upper")
    if len(tokens) >= 20 and len(distinct) * 3 < len(tokens):
        out.append("#repeats")
    if not tokens:
        out.append("#empty")
    return out


def text_features(text: str | None) -> set[str]:
    """All features of a text; of a null text those of the empty one."""
    tokens = _TOKEN.findall(text or "")
    distinct = set(tokens)
    return {f for w in {w.lower() for w in distinct} for f in token_features(w)} | set(shapes(tokens, distinct))


@dataclass
class Link:
    """One category: weights of its features, of the earlier categories, and the bias."""

    category: str
    weights: dict[str, float]
    earlier: list[float]
    bias: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    @property
    def categories(self) -> list[str]:
        return [x.category for x in self.links]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A chain in a task; what a token contributes to each link is remembered."""

    def __init__(self, chain: Chain):
        self.chain = chain
        vocabulary = sorted({f for x in chain.links for f in x.weights})
        self.ids = {f: i for i, f in enumerate(vocabulary)}
        self.w = np.array([[x.weights.get(f, 0.0) for x in chain.links] for f in vocabulary]).reshape(len(vocabulary), len(chain.links))
        self.memo: dict[str, tuple[int, ...]] = {}

    def _ids(self, token: str) -> tuple[int, ...]:
        found = tuple(self.ids[f] for f in token_features(token.lower()) if f in self.ids)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[token] = found
        return found

    def active(self, text: str | None) -> set[int]:
        tokens = _TOKEN.findall(text or "")
        distinct = set(tokens)
        memo, ids = self.memo, set()
        for w in distinct:
            found = memo.get(w)
            if found is None:
                found = self._ids(w)
            if found:
                ids.update(found)
        ids.update(self.ids[s] for s in shapes(tokens, distinct) if s in self.ids)
        return ids

    def probabilities(self, text: str | None) -> list[float]:
        ids = sorted(self.active(text))
        base = self.w[ids].sum(axis=0) if ids else np.zeros(len(self.chain.links))
        p: list[float] = []
        for z, link in zip(base, self.chain.links, strict=True):
            z = float(z) + link.bias + sum(a * b for a, b in zip(link.earlier, p, strict=True))
            p.append(1 / (1 + float(np.exp(-max(-40.0, min(40.0, z))))))
        return p


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 12) -> np.ndarray:
    """Weights with the bias last, by Newton's method; the bias isn't penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def out_of_fold(x: np.ndarray, y: np.ndarray, l2: float, fold: np.ndarray, inputs=None) -> np.ndarray:
    """For each row the prediction of a model that hasn't seen its fold; inputs(fold): those that
    may be used for that fold (x, if not given)."""
    p = np.zeros(len(y))
    for k in np.unique(fold).tolist():
        own = x if inputs is None else inputs(k)
        seen = fold != k
        if seen.any():
            p[~seen] = _predict(own[~seen], fit_logistic(own[seen], y[seen], l2))
        else:
            p[~seen] = y.mean()
    return p


def select_features(labelled: DataFrame, text: str, categories: Sequence[str], max_features: int, min_z: float, folds: int = 0) -> dict[tuple[str, int | None], list[str]]:
    """For each category the features whose presence tells its classes apart best: by all rows
    (category, None) and, but for the last category, without each of the folds (category, fold),
    given by the column ``_fold``.

    Counted over all rows of labelled in one pass, in a distributed way; only the chosen ones, at
    most max_features a choice, come to the driver.
    """
    k = len(categories)
    counts = [f"n{i}_{v}" for i in range(k) for v in (0, 1)]
    schema = struct_of(("feature", T.StringType()), ("fold", T.IntegerType()), *((c, T.LongType()) for c in counts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, int], list[int]] = {}
        for batch in slices(batches):
            labels = [batch.column(c).to_pylist() for c in range(2, k + 2)]
            for r, (s, fold) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                hit = [2 * i + int(labels[i][r]) for i in range(k) if labels[i][r] is not None]
                for f in text_features(s) if hit else ():
                    row = n.get((f, fold))
                    if row is None:
                        row = n[f, fold] = [0] * (2 * k)
                    for h in hit:
                        row[h] += 1
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in n], pa.string()), pa.array([x for _, x in n], pa.int32()), *(pa.array([row[c] for row in n.values()], pa.int64()) for c in range(2 * k))], names=schema.names)

    label = lambda i, v: F.sum(F.when(F.col(categories[i]) == v, 1).otherwise(0))
    of_fold = {r["_fold"]: r for r in labelled.groupBy("_fold").agg(*(label(i, v).alias(f"n{i}_{v}") for i in range(k) for v in (0, 1))).collect()}
    total = {c: sum(r[c] for r in of_fold.values()) for c in counts}
    without = lambda c, f: total[c] - (of_fold[f][c] if f in of_fold else 0)
    choices = [(i, f) for i in range(k) for f in (None, *(range(folds) if i < k - 1 else ()))]
    choices = [(i, f) for i, f in choices if without(f"n{i}_0", f) and without(f"n{i}_1", f)]
    sums = [F.sum(c).alias(c) for c in counts] + [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(folds) for c in counts]
    seen = labelled.select(text, "_fold", *categories).mapInArrow(count, schema).groupBy("feature").agg(*sums)

    def z(i: int, f: int | None):
        none, some = without(f"n{i}_0", f), without(f"n{i}_1", f)
        of = lambda c: F.col(c) if f is None else F.col(c) - F.col(f"{c}_{f}")
        a, b = of(f"n{i}_1"), of(f"n{i}_0")
        pooled = (a + b + 1) / F.lit(float(some + none + 2))
        return (a / F.lit(float(some)) - b / F.lit(float(none))) / F.sqrt(pooled * (F.lit(1.0) - pooled) * F.lit(1 / some + 1 / none))

    out: dict[tuple[str, int | None], list[str]] = {(c, f): [] for c in categories for f in (None, *range(folds))}
    if choices:
        scored = seen.select("feature", F.posexplode(F.array(*(F.abs(z(i, f)) for i, f in choices))).alias("choice", "z")).where(F.col("z") >= min_z)
        rank = F.row_number().over(Window.partitionBy("choice").orderBy(F.desc("z"), F.length("feature"), "feature"))
        for r in scored.withColumn("rank", rank).where(F.col("rank") <= max_features).orderBy("choice", "rank").collect():
            i, f = choices[r["choice"]]
            out[categories[i], f].append(r["feature"])
    return out


def fit_chain(labelled: DataFrame, categories: Sequence[str], text: str = "text", id: str = "doc_id", sample: int = 10_000, max_features: int = 256, min_z: float = 4.0, folds: int = 5, l2: float = 0.3) -> Chain:
    """Fit the chain in the order of categories (columns of 0, 1 or null) on at most sample rows.

    Null texts count as empty; a row whose label is null is left out of that category's model
    only. Without rows of both classes a category gets probability 0 (or 1) throughout.
    """
    labelled = labelled.select(id, text, *categories).withColumn("_fold", F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(folds)).cast("int"))
    if labelled.count() > sample:
        some = labelled.select(id).distinct().orderBy(F.xxhash64(id), id).limit(sample)
        labelled = labelled.join(F.broadcast(some), id, "left_semi")
    chosen = select_features(labelled, text, categories, max_features, min_z, folds)
    names = sorted({f for fs in chosen.values() for f in fs})
    ids = {f: i for i, f in enumerate(names)}
    stub = Chain([Link("", dict.fromkeys(names, 0.0), [], 0.0)])
    k = len(categories)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = stub.scorer()
        for batch in slices(batches):
            active = [sorted(scorer.active(s)) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i + 2).cast(pa.int32()) for i in range(k + 1)), pa.array(active, pa.list_(pa.int32()))], names=["id", *categories, "_fold", "active"])

    schema = struct_of(("id", labelled.schema[id].dataType), *((c, T.IntegerType()) for c in (*categories, "_fold")), ("active", T.ArrayType(T.IntegerType())))
    rows = labelled.mapInArrow(encode, schema).toArrow().sort_by("id").combine_chunks()  # at most sample rows of a few ids each
    active = rows["active"].combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    x = np.zeros((rows.num_rows, len(names)), dtype=np.uint8)
    x[np.repeat(np.arange(rows.num_rows), active.value_lengths().to_numpy()), active.flatten().to_numpy()] = 1
    fold, labels = rows["_fold"].to_numpy(), {c: rows[c].to_pylist() for c in categories}
    del rows, active
    chain, earlier = Chain(), np.zeros((len(x), 0))
    for c in categories:
        own = [ids[f] for f in chosen[c, None]]
        there = np.array([v is not None for v in labels[c]], dtype=bool)
        y = np.array([v or 0 for v in labels[c]], dtype=float)
        if len(set(y[there])) < 2:
            sure = bool(there.any() and y[there][0])
            chain.links.append(Link(c, {}, [0.0] * earlier.shape[1], 40.0 if sure else -40.0))
            earlier = np.hstack([earlier, np.full((len(x), 1), float(sure))])
            continue
        inputs = np.hstack([x[:, own], earlier])
        w = fit_logistic(inputs[there], y[there], l2)
        chain.links.append(Link(c, {f: float(v) for f, v in zip(chosen[c, None], w, strict=False)}, [float(v) for v in w[len(own) : -1]], float(w[-1])))
        if len(chain.links) < k:  # a later model needs inputs as unreliable as those it will get
            p = _predict(inputs, w)
            del inputs  # one float matrix at a time: the driver's memory is small
            of_fold = lambda f, c=c, there=there, earlier=earlier: np.hstack([x[np.ix_(there, [ids[n] for n in chosen[c, f]])], earlier[there]])
            p[there] = out_of_fold(x, y[there], l2, fold[there], of_fold)
            earlier = np.hstack([earlier, p[:, None]])
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds p_<category> for every category; a null text is scored as the empty one. Columns
    of docs with such names (in whatever case) are replaced, all others are kept; every row is scored on its own."""
    names = [f"p_{c}" for c in chain.categories]
    taken = {n.lower() for n in names}
    return _scored(docs.drop(*[c for c in docs.columns if c.lower() in taken and c != text]), chain, text, names)


def _scored(docs: DataFrame, chain: Chain, text: str, names: Sequence[str]) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = chain.scorer()
        for batch in slices(batches):
            p = [scorer.probabilities(s) for s in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in p], pa.float64()) for i in range(len(names)))], names=schema.names)

    return docs.mapInArrow(run, schema)


#: The chain of the query: what the labels table annotates, toxicity last.
CATEGORIES = ("junk", "toxic")


def labelled_documents(spark, sf_dir: str, sample: int = 10_000) -> DataFrame:
    """At most sample labelled documents, dealt out evenly. The labels picked are a table of
    bounded size, so they may be broadcast to the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null and toxic is not null")
    labels = labels.groupBy("doc_id").agg((1 - F.max("quality")).cast("int").alias("junk"), F.max("toxic").cast("int").alias("toxic"))
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    picked = texts.join(F.broadcast(some), "doc_id").repartition(spread(spark))
    return materialize(picked, "labelled")


def fitted(spark, sf_dir: str) -> Chain:
    return fit_chain(labelled_documents(spark, sf_dir), CATEGORIES)


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs that the last category of the chain doesn't reach, with all their columns,
    whatever these are called. A null text is judged as the empty one, repeated rows are judged alike, an
    empty table stays empty."""
    names = [free_name(docs.columns, f"_p{i}") for i in range(len(chain.categories))]
    return _scored(docs, chain, text, names).where(F.col(names[-1]) < threshold).select(*docs.columns)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Probabilities of the chain's categories for every document, and the decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, fitted(spark, sf_dir))
    return scored.select("doc_id", "p_junk", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))
