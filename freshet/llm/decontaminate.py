"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words of documents and of benchmark items are hashed, and runs of ``k`` words (k-grams) get one
hash each. Of the k-grams of every ``window`` words in a row the least hash is picked, the last
one of equal ones; a fingerprint is emitted only where the pick changes, so that several windows
in a row share one. Windows with equal words pick equal k-grams at equal offsets, so every shared
span of at least ``window`` words shares a fingerprint.

Fingerprints of documents are joined with those of the items (few match). A match is extended
to all windows that may share its pick, and their words are compared with the items' windows, by
a join on the words themselves. An item shorter than ``window`` words is one window of its own
length, its fingerprint the hash of all its words.

The items' fingerprints and windows are broadcast only if they take at most ``most_broadcast``
bytes; otherwise the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that parts words, given that A-Z count as letters: everything in ASCII but 0-9, A-Z, a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN, -1), lambda w: w != "")


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased (and nothing else); those of null are none."""
    lowered = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(_split(text), lowered)


def grams(h: Column, k: int) -> Column:
    """The hash of every run of k words; h: hashes of the words. None if there are fewer."""
    each = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    return F.when(F.size(h) >= k, each).otherwise(F.array().cast("array<bigint>"))


def picked(g: Column, at: Column, n: int) -> Column:
    """The least of the n k-grams from ``at`` on, as one number: its hash, but in the last bits
    how many of the n come after it (so that the last of equal ones is least)."""
    keep = F.lit(-1 << _bits(n)).cast("long")
    own = [F.get(g, at + j).bitwiseAND(keep).bitwiseOR(F.lit(n - 1 - j).cast("long")) for j in range(n)]
    return F.least(*own) if n > 1 else own[0]


def _bits(n: int) -> int:
    return (n - 1).bit_length()


def _key(pick: Column, n: int) -> Column:
    return pick.bitwiseAND(F.lit(-1 << _bits(n)).cast("long"))


def _place(pick: Column, at: Column, n: int) -> Column:
    """Where the picked k-gram of the window at ``at`` lies."""
    return at + (n - 1) - pick.bitwiseAND(F.lit((1 << _bits(n)) - 1).cast("long")).cast("int")


def item_windows(items: DataFrame, id: str, text: str, window: int, k: int) -> DataFrame:
    """n, key, span, items: the distinct windows of all items (span: the words, space-joined), the
    fingerprint of each and the ids of the items it occurs in."""
    w = items.select(F.col(id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    at = w.select("item", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"))
    own = at.select("item", "n", F.slice("w", F.col("at") + 1, F.col("n")).alias("w"))  # n >= 1
    whole = own.groupBy("n", "w").agg(F.collect_set("item").alias("items"))
    slots = window - k + 1
    key = F.when(F.col("n") == window, _key(picked(F.col("g"), F.lit(0), slots), slots))
    for m in range(1, window):
        key = key.when(F.col("n") == m, F.xxhash64(*(F.get("h", F.lit(j)) for j in range(m))))
    hashed = whole.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("g", grams(F.col("h"), k))
    return hashed.select("n", key.alias("key"), F.array_join("w", " ").alias("span"), "items")


def contaminated(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 6, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_broadcast: int = 32 << 20) -> DataFrame:
    """For every row of docs: id, n_words, n_hit, n_items, items (sorted as strings), hits.

    A word is hit if a window of an item occurs at it; hits are the spans of words (from, to),
    ascending. Null texts have no words, items without words have no windows; null ids and
    repeated rows are kept as they are, rows of one id being looked at by their own texts. An
    item without an id hits words but isn't counted.
    """
    windows = materialize(item_windows(items, item_id, item_text, window, k), "windows")
    stats = windows.groupBy("n").agg(F.sum(F.octet_length("span") + 16 * F.size("items") + 64).alias("bytes")).collect()  # at most ``window`` rows
    lengths = sorted((r["n"] for r in stats), reverse=True)
    small = sum(r["bytes"] for r in stats) <= most_broadcast
    maybe = F.broadcast if small else lambda df: df
    known = maybe(windows.select("n", "key").distinct())

    split = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row"), words(F.col(text)).alias("w"))
    rows = split.select("doc_id", "_row", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    rows = rows.select("doc_id", "_row", "w", "h", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n")).where(F.size("h") >= F.col("n"))
    slots, n, at = window - k + 1, F.col("n"), F.col("at")
    g = F.when(n == window, grams(F.col("h"), k))
    for m in (x for x in lengths if x < window):
        g = g.when(n == m, grams(F.col("h"), m))
    rows = rows.select("doc_id", "_row", "w", "n", g.alias("g"))  # in a step before: a generator's other columns are worked out per row
    rows = rows.select("doc_id", "_row", "w", "n", "g", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("at"))
    now, before = picked(F.col("g"), at, slots), picked(F.col("g"), at - 1, slots)
    rows = rows.where((n < window) | (at == 0) | (_place(now, at, slots) != _place(before, at - 1, slots)))
    rows = rows.withColumn("key", F.when(n == window, _key(now, slots)).otherwise(F.get("g", at)))
    if small:
        met = rows.join(known, ["n", "key"]).select("doc_id", "_row", "w", "n", "at")
    else:  # the words travel only for documents that have a match
        light = rows.select("doc_id", "_row", "n", "at", "key").join(known, ["n", "key"], "left_semi")
        places = light.groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(F.collect_set(F.struct("n", "at")).alias("places"))
        back = split.dropDuplicates(["doc_id", "_row"]).join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")))
        met = back.select("doc_id", "_row", "w", F.inline("places"))
    # the windows that may share the pick
    last = F.when(n == window, F.least(at + (slots - 1), F.size("w") - n)).otherwise(at)
    met = met.select("doc_id", "_row", "w", "n", F.explode(F.sequence(at, last)).alias("at"))
    met = met.select("doc_id", "_row", "n", "at", F.array_join(F.slice("w", at + 1, n), " ").alias("span"))
    hits = met.join(maybe(windows.select("n", "span", "items")), ["n", "span"])
    found = hits.groupBy(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).agg(
        F.sort_array(F.collect_set(F.struct(at.alias("from"), (at + n).alias("to")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    # documents without a hit never travel but for their id and number of words
    total = docs.select(F.col(id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_row"), F.size(_split(F.col(text))).cast("long").alias("n_words"))
    joined = total.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    hit = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["from"], a["end"]))).alias("n"), F.greatest(a["end"], s["to"]).alias("end")))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(hit["n"], F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(names, F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("hits"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs in which no window of an item occurs. An id is judged by all its rows;
    rows without an id are kept."""
    name = free_name(docs.columns, "_bad")
    bad = contaminated(docs, items, id=id, text=text, **how).where("n_hit > 0 and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(id) == F.col(name), "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of documents that windows of 10 words of benchmark items hit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contaminated(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS span
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, span)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
