"""Ranked lexical search by block-max WAND over an index of compressed posting blocks.

**Index.** Every scan task cuts its documents into *shards* of bounded size, numbers a shard's
documents in order of id and writes, per term, its postings in blocks of ``BLOCK``: gaps of document
numbers and term frequencies, each packed to as many bits as the block's largest needs. Beside
the bytes stand the block's first and last document and its greatest impact (the part of the score
that depends on the document). No posting is shuffled to build it; a row without a term holds the
shard's ids and length factors.

**Search.** A shard's blocks meet in one task, still compressed. For an item, only the *shallow*
data are looked at first: where blocks begin and end cuts the documents into intervals in which
the same blocks count, and the sum of their greatest impacts (by weight) bounds every score there. A cursor moves on to
the next interval whose bound is above the threshold, the k-th best score so far, skipping the blocks
between undecoded; only blocks that reach into an interval that may matter are decompressed,
and its documents scored. As documents come in order of id, one that only equals the threshold
can't get in any more.

Each shard starts with a threshold as high as the k-th best score of one shard, which is searched
first; of each shard's best the final ones are ranked by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, discard, materialize, slices, spread, struct_of

#: Postings a block; documents and terms (with repeats) a shard, at most but for one document.
BLOCK = 128
SHARD_DOCS, SHARD_TERMS = 1 << 15, 1 << 23
#: Documents that are scored together, about.
RUN = 4096
#: Items that are searched together, about: they are told to all tasks.
AT_ONCE = 2048
#: Different terms of all items that are told to the tasks that build an index for them.
MOST_TERMS = 1_000_000
#: What lies between terms; A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))

_INDEX = struct_of(
    ("shard", T.LongType()), ("term", T.BinaryType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("n", T.IntegerType()),
    ("peak", T.LongType()), ("postings", T.BinaryType()), ("ids", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType())),
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, repeats included, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs tf times adds to a score, but for its weight."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.packbits((values[:, None] >> np.arange(width)) & 1 == 1, bitorder="little").tobytes()


def _unpacked(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return bits @ (np.int64(1) << np.arange(width))


def pack(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """A block of postings in order of document: bits of a gap, bits of a frequency, all gaps, all
    frequencies; both less 1."""
    gaps, tf = np.diff(docs) - 1, tf - 1
    widths = [int(x.max(initial=0)).bit_length() for x in (gaps, tf)]
    return bytes(widths) + _packed(gaps, widths[0]) + _packed(tf, widths[1])


def unpack(raw: bytes, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    a, b = int(data[0]), int(data[1])
    middle = 2 + ((n - 1) * a + 7) // 8
    docs = np.full(n, first, dtype=np.int64)
    np.cumsum(_unpacked(data[2:middle], n - 1, a) + 1, out=docs[1:])
    docs[1:] += first
    return docs, _unpacked(data[middle:], n, b) + 1


# -- the index -------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers terms in order of appearance, or only those given; others are -1."""

    def __init__(self, terms: frozenset[bytes] | None):
        super().__init__(() if terms is None else zip(sorted(terms), range(len(terms)), strict=True))
        self.grows = terms is None

    def __missing__(self, term: bytes) -> int:
        if not self.grows:
            return -1
        self[term] = len(self)
        return len(self) - 1


class _Shard:
    """Documents of a task that are indexed together."""

    def __init__(self, numbers: _Numbers):
        self.numbers = numbers
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.posts: list[np.ndarray] = []
        self.held = 0

    def add(self, id: int | None, text: str | None) -> None:
        found = terms_of(text)
        at = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        self.posts.append(at[at >= 0])
        self.ids.append(id)
        self.lengths.append(len(found))
        self.held += len(found)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.held >= SHARD_TERMS

    def batches(self, shard: int, total: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        n, terms = total
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        m = 50 + (50 * np.array(self.lengths, dtype=np.int64)[order] * n) // max(terms, 1)
        doc = np.repeat(np.arange(len(order)), [len(self.posts[i]) for i in order])
        keys, tf = np.unique((np.concatenate([self.posts[i] for i in order]).astype(np.int64) << 32) | doc, return_counts=True)
        term, doc = keys >> 32, keys & 0xFFFFFFFF
        g = impacts(tf, m[doc])
        # blocks begin where a term does and every BLOCK postings from there
        fresh = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
        starts = np.flatnonzero((np.arange(len(term)) - np.repeat(fresh, np.diff(np.r_[fresh, len(term)]))) % BLOCK == 0)
        names = list(self.numbers)
        rows = [(shard, None, None, None, None, None, None, [self.ids[i] for i in order], m.tolist())]
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(term)].tolist(), strict=True) if len(term) else ():
            rows.append((shard, names[term[a]], int(doc[a]), int(doc[b - 1]), b - a, int(g[a:b].max()), pack(doc[a:b], tf[a:b]), None, None))
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_INDEX.names)


def corpus_counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = np.array([len(terms_of(s.as_py())) for s in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(n)], pa.int64()), pa.array([n.sum()], pa.int64())], names=["n", "terms"])

    counts = docs.select(text).mapInArrow(run, struct_of(("n", T.LongType()), ("terms", T.LongType())))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    return row["n"], row["terms"]


def build_index(docs: DataFrame, total: tuple[int, int], terms: frozenset[bytes] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs, one row a block and one a shard (see above). total: counts of the corpus
    that scores go by; terms: index only these (all that will be searched for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        own = _Shard(_Numbers(terms))
        for batch in slices(batches):
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own.add(i, s.as_py())
                if own.full():
                    yield from own.batches(at, total)
                    at, own = at + 1, _Shard(_Numbers(terms))
        if own.ids:
            yield from own.batches(at, total)

    return docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(run, _INDEX)


# -- search ----------------------------------------------------------------------------------


class Searcher:
    """One shard's blocks of the terms that are searched for."""

    def __init__(self, ids: list, lengths: np.ndarray, blocks: list[tuple]):
        self.ids, self.m = ids, lengths
        self.first, self.last, self.n, self.peak = (np.array([b[i] for b in blocks], dtype=np.int64) for i in range(1, 5))
        self.raw = [b[5] for b in blocks]
        self.of: dict[bytes, list[int]] = {}
        for i, b in enumerate(blocks):
            self.of.setdefault(b[0], []).append(i)
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        found = self.decoded.get(i)
        if found is None:
            docs, tf = unpack(self.raw[i], int(self.first[i]), int(self.n[i]))
            found = self.decoded[i] = docs, impacts(tf, self.m[docs])
        return found

    def top(self, weights: dict[bytes, int], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents whose score is above floor, best first."""
        own = [(i, w) for t, w in weights.items() for i in self.of.get(t, ())]
        docs = scores = np.zeros(0, dtype=np.int64)
        if not own:
            return docs, scores
        at, w = (np.array(x, dtype=np.int64) for x in zip(*own, strict=True))
        first, last = self.first[at], self.last[at]
        cuts, place = np.unique(np.concatenate([first, last + 1]), return_inverse=True)
        steps = np.zeros(len(cuts), dtype=np.int64)
        np.add.at(steps, place, np.concatenate([self.peak[at] * w, -self.peak[at] * w]))
        bounds = np.cumsum(steps)  # of the interval from each cut to the next one; 0 at last
        cursor = 0
        while True:
            hot = bounds[cursor:] > floor
            skip = int(hot.argmax())
            if not hot[skip]:
                return docs, scores
            cursor += skip
            low, end = int(cuts[cursor]), cursor + 1
            while bounds[end] > floor and cuts[end] - low < RUN:
                end += 1
            high = int(cuts[end])
            sums = np.zeros(high - low, dtype=np.int64)
            for j in np.flatnonzero((first < high) & (last >= low)).tolist():
                x, g = self.block(int(at[j]))
                if first[j] < low or last[j] >= high:
                    a, b = x.searchsorted((low, high))
                    x, g = x[a:b], g[a:b]
                sums[x - low] += w[j] * g
            better = np.flatnonzero(sums > floor)
            if len(better):
                docs, scores = np.concatenate([docs, better + low]), np.concatenate([scores, sums[better]])
                best = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    floor = max(floor, int(scores[-1]))
            cursor = end


def _searched(blocks: DataFrame, items: pa.Array, wanted: list[dict[bytes, int]], k: int, floors: dict[int, int], kind: T.DataType) -> DataFrame:
    """item, doc_id and score of the best of every shard."""
    schema = struct_of(("item", T.LongType()), ("item_id", kind), ("doc_id", T.LongType()), ("score", T.LongType()))

    def results(shard: Searcher) -> Iterator[pa.RecordBatch]:
        for i, weights in enumerate(wanted):
            docs, scores = shard.top(weights, k, floors.get(i, 0))
            if len(docs):
                own = pa.array(np.full(len(docs), i))
                yield pa.RecordBatch.from_arrays([own, items.take(own), pa.array([shard.ids[d] for d in docs.tolist()], pa.int64()), pa.array(scores)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = ids = lengths = None
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != number:
                    if held:
                        yield from results(Searcher(ids, lengths, held))
                    number, held = row[0], []
                if row[1] is None:
                    ids, lengths = row[7], np.array(row[8], dtype=np.int64)
                else:
                    held.append(row[1:7])
        if held:
            yield from results(Searcher(ids, lengths, held))

    dealt = blocks.repartition(spread(blocks.sparkSession), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first(), "first")
    return dealt.mapInArrow(run, schema)


def item_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id and its different terms, as UTF-8; items of one id are one query."""
    lower = F.translate(F.col(text), _UPPER, _UPPER.lower())
    found = items.select(F.col(id).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(PATTERN), F.lit(0))).alias("term"))
    return found.select("item_id", F.col("term").cast("binary").alias("term")).distinct()


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best documents of every item. An item's rows are first ranked in SALTS shares."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))
    some = salted.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank", "_salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def search(index: DataFrame, total: tuple[int, int], wanted: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score of the k best documents of each item, those of a
    score above 0 only; equal scores in order of doc_id.

    index: a written one (see build_index); wanted: item_id and term (see item_terms), of which
    about AT_ONCE items are searched at a time, in one scan of their terms' blocks."""
    spark = index.sparkSession
    posts = index.where("term is not null")
    df = posts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * total[0] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = materialize(wanted.join(df.select("term", weight.alias("w")), "term").where("w > 0").withColumn("_of", F.xxhash64("item_id")), "weights")
    parts = -(-weighed.select("item_id").distinct().count() // AT_ONCE) or 1
    one = posts.agg(F.min("shard")).first()[0]
    kind, out = wanted.schema["item_id"].dataType, []
    for part in range(parts):
        own = weighed.where(F.pmod("_of", F.lit(parts)) == part)
        told = own.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("t")).toArrow().combine_chunks()
        items = told["item_id"].combine_chunks() if told.num_rows else pa.array([])
        weights = [{x["term"]: x["w"] for x in t} for t in told["t"].to_pylist()]
        blocks = posts.join(own.select("term").distinct(), "term", "left_semi").select(*_INDEX.names).union(index.where("term is null"))
        floors = {}
        if one is not None and items:
            sample = _searched(blocks.where(F.col("shard") == one), items, weights, k, {}, kind)
            least = sample.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
            floors = {r["item"]: r["s"] - 1 for r in least.collect()}  # equal scores may still win by their id
        out.append(ranked(_searched(blocks, items, weights, k, floors, kind), k))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents for every item (see search). Every row of docs is a document, also where
    an id is repeated or null (null ids come last among equal scores); null texts have no terms;
    items of one id (null is one) are one query. Empty tables and items without terms give no rows.

    The index holds the terms of the items if these are at most MOST_TERMS, else all terms."""
    spark = docs.sparkSession
    total = corpus_counts(docs, text)
    wanted = materialize(item_terms(items, item_id, item_text), "item-terms")
    different = wanted.select("term").distinct()
    terms = frozenset(bytes(x.as_py()) for x in different.toArrow()["term"]) if different.count() <= MOST_TERMS else None
    index = materialize(build_index(docs, total, terms, id, text), "posting-blocks")
    out = materialize(search(index, total, wanted, k), "ranked")
    for done in (wanted, index):
        discard(done, spark)
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rank_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, c),
s AS (SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN m USING (r) WHERE score > 0)
SELECT * FROM o WHERE rank <= 50
"""
