"""Change points, the quality classifier and ranked search: brute force, SQL, hard cases."""

import math
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from duck import duck_rows, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.llm import changepoints, lexical, quality

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"

# -- op11 --


def slow_cuts(x, min_days, penalty):
    """All cuttings by recursion over the last segment: (cost, segments, starts from the last back)."""

    def cost(part):
        n, s, q = len(part), sum(part), sum(v * v for v in part)
        return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))

    if len(x) < min_days:
        return cost(x), [0]
    best = {0: (0, 0, ())}
    for t in range(min_days, len(x) + 1):
        ways = [(best[s][0] + cost(x[s:t]) + (penalty if s else 0), best[s][1] + 1, (s, *best[s][2])) for s in best if t - s >= min_days]
        if ways:
            best[t] = min(ways)
    return best[len(x)][0], list(best[len(x)][2])[::-1]


def check_cuts(x, min_days, penalty):
    cuts = changepoints.Cuts(min_days, penalty)
    for v in x:
        cuts.push(v)
    parts, best = cuts.segments()
    assert (best, [a for a, _ in parts]) == slow_cuts(x, min_days, penalty)
    assert [b for _, b in parts] == [*[a for a, _ in parts[1:]], len(x)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-3, 40), min_size=1, max_size=40), st.integers(1, 6), st.sampled_from([0, 500, 9000]))
def test_cuts_equal_all_cuttings(x, min_days, penalty):
    check_cuts(x, min_days, penalty)


def test_cuts_of_flat_huge_and_late_winning_series():
    for x in ([0] * 50, [7] * 13, [7] * 14, [10**12, 5, 3 * 10**12] * 20, [3 * 10**9] * 20 + [1, 10**10] * 20, [1, 0] * 40 + [1, 2, 0] * 20):
        for penalty in (0, 1, 40_000):
            check_cuts(x, 14, penalty)
    with pytest.raises(ValueError):
        changepoints.Cuts(0)


def test_change_points_against_sql(spark):
    assert rows_of(changepoints.op11_change_points(spark, SF)) == duck_rows(changepoints.OP11_SQL, SF)


def test_change_points_of_hard_rows(spark):
    day = datetime(1969, 12, 25)
    rows = [(1, day + timedelta(days=i, hours=5), 9 if i < 20 else 900 * (i % 2), "x") for i in range(0, 60, 3)] * 2
    rows += [(None, day, 4, "x"), (None, day + timedelta(days=1), None, "x"), (2, None, 3, "x"), (3, day, -5, None)]
    df = spark.createDataFrame(rows, "VENDOR_ID long, at timestamp_ntz, n int, segment_no string")
    got = {}
    for r in changepoints.change_points(df, "VENDOR_ID", "at", "n").collect():
        got.setdefault(r["VENDOR_ID"], []).append(r)
    assert sorted(got, key=str) == [1, 3, None]
    x = [0] * 58
    for _, at, v, _ in rows[:40]:
        x[(at - day).days] += v
    cost, starts = slow_cuts(x, 14, 40_000)
    own = sorted(got[1], key=lambda r: r["segment_no"])
    assert [r["first_day"] + 7 for r in own] == starts and {r["best_cost"] for r in own} == {cost} and sum(r["total"] for r in own) == sum(x)
    assert [(r["n_days"], r["total"], r["spread"], r["cost"], r["best_cost"]) for r in (*got[None], *got[3])] == [(1, 4, 1, 0, 0), (1, -5, 1, 0, 0)]
    assert changepoints.change_points(df.limit(0), "VENDOR_ID", "at", "n").collect() == []


def test_a_hot_series_is_small_before_it_is_dealt_out(spark):
    df = spark.range(200_000).select(F.lit(7).alias("k"), (F.col("id") % 30).cast("int").alias("d"), F.lit(1).alias("v"))
    df = df.select("k", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("d"), "v")
    out = changepoints.change_points(df, "k", "d", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") > plan.index("hashpartitioning")  # the plan is printed from the result down
    assert sum(r["total"] for r in out.collect()) == 200_000


# -- op12 --


def plain_score(model, text):
    tokens = quality._TOKEN.findall(text or "")
    low, shapes = [t.lower() for t in tokens], [quality.shape(t) for t in tokens]
    of = quality.Indicators(model.bits)
    at = set()
    for i in range(len(tokens)):  # each n-gram by itself, as a text of its own would place it
        for parts, table in ((low[i : i + 1], of.words), (low[i : i + 2], of.words), (shapes[i : i + 1], of.shapes), (shapes[i : i + 2], of.shapes), (shapes[i : i + 3], of.shapes)):
            want = {id(of.words): (1, 2), id(of.shapes): (1, 2, 3)}[id(table)]
            if len(parts) in want:
                mix = 0
                for j, (p, t) in enumerate(zip(parts, tokens[i:], strict=False)):
                    mix = (mix + table[t] * int(quality._MIX[j])) % 2**64
                    assert p
                at.add(mix >> (64 - model.bits))
    at = sorted(at)
    size = math.sqrt(sum(float(model.power[a]) for a in at))
    margin = model.bias + (sum(float(model.weight[a]) for a in at) / size if size else 0)
    return 1 / (1 + math.exp(-max(-40, min(40, model.curve[0] * margin + model.curve[1]))))


def test_scores_equal_plain_sums_and_tell_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    model = quality.fit(quality.labelled_documents(spark, LARGER), "quality")
    got = {r["doc_id"]: r for r in quality.op12_quality(spark, LARGER).collect()}
    assert len(got) == docs.count()
    for r in docs.limit(60).collect():
        assert got[r["doc_id"]]["score"] == pytest.approx(plain_score(model, r["text"]), abs=1e-5)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    labels = [r for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert len(labels) > 500
    right = sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in labels) / len(labels)
    low = [got[r["doc_id"]]["predicted"] for r in labels if r["quality"] == 0]
    assert right > 0.98 and sum(low) < 0.1 * len(low)


def test_held_out_labels_play_no_part(spark, tmp_path):
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "labels":
            df = df.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    scores = [{r["doc_id"]: r["score"] for r in quality.op12_quality(spark, d).collect()} for d in (SF, str(tmp_path))]
    assert scores[0] == scores[1]


def test_dual_coordinate_descent_reaches_the_least_objective():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    y = np.sign(x @ [1, -2, 0.5, 0] + rng.normal(size=60) * 0.7)
    rows, values = [np.arange(4)] * 60, list(x)
    w, b = quality.dual_coordinate_descent(rows, values, y, 4, passes=3000, tolerance=1e-9)

    def objective(v):
        return (v @ v) / 2 + np.maximum(0, 1 - y * (x @ v[:4] + v[4])).sum()

    best = objective(np.r_[w, b])
    assert all(objective(np.r_[w, b] + rng.normal(size=5) * s) >= best - 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_ratios_by_hand():
    rows, y = [np.array([0, 1])] * 3 + [np.array([1, 2])] * 3, np.array([1.0] * 3 + [-1.0] * 3)
    r = quality.log_count_ratios(rows, y, 4)
    total = 6 + 3  # three places are used, each smoothed by one
    assert r == pytest.approx([math.log(4 / total) - math.log(1 / total), 0, -math.log(4), 0])


def test_quality_of_hard_rows(spark):
    good = [(i, f"The cat number {i % 5} sat on a mat. It slept.", 1) for i in range(30)]
    bad = [(100 + i, f"BUY!! NOW!! {i % 5}!! CHEAP!!", 0) for i in range(30)]
    df = spark.createDataFrame([*good, *bad, (200, None, 1), (201, "?", None), (None, "", 0)], "doc_id long, text string, label int")
    model = quality.fit(df, "label")
    rows = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "BUY!! NOW!!", "c"), (2, "A cat slept on a mat. " * 40_000, "d"), (2, "😀 __", "e")], "doc_id long, text string, SCORE string")
    got = quality.score(rows, model)
    assert got.columns == ["doc_id", "text", "score"]
    s = [r["score"] for r in got.collect()]
    assert s[0] == s[1] and s[2] < 0.3 < 0.7 < s[3] and all(0 <= v <= 1 for v in s)
    assert quality.score(rows.limit(0), model).collect() == []
    assert {r["score"] for r in quality.score(rows, quality.fit(df.limit(0), "label")).collect()} == {0.5}
    assert min(r["score"] for r in quality.score(rows, quality.fit(df.where("label = 1"), "label")).collect()) > 0.99


# -- op13 --


def slow_ranking(docs, items, k):
    found = {d: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for d, (_, t) in enumerate(docs)}
    n, total = sum(1 for w in found.values() if w), sum(map(len, found.values()))
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    out = set()
    for i, own in terms.items():
        scores = []
        for d, words in found.items():
            m = 50 + (50 * len(words) * n) // max(total, 1)
            score = 0
            for t in own & set(words):
                df = sum(1 for w in found.values() if t in w)
                tf = words.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, docs[d][0] is None, docs[d][0] or 0, docs[d][0]))
        out |= {(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_ranking_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "AT_ONCE", 3)
    rng = np.random.default_rng(k)
    words = [*"abcdefgh", "É", "Word", "x1", "日本"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30), p=np.arange(1, 13) / 78)) for _ in range(300)]
    docs = [(int(i), t) for i, t in zip(rng.permutation(300), texts, strict=True)]
    docs += [(7, "a a a"), (7, "a a a"), (None, "É Word"), (None, None), (900, "--"), (901, "word-É_x1"), (902, "h " * 50_000)]
    items = [(i, " ".join(rng.choice(words, 4))) for i in range(9)] + [(0, "H"), (50, None), (51, " ,"), (None, "word"), (52, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("TERM", F.lit(1)).repartition(5)
    got = lexical.rank_documents(d, spark.createDataFrame(items, "item_id long, text string"), k)
    assert {tuple(r) for r in got.collect()} == slow_ranking(docs, items, k)
    monkeypatch.setattr(lexical, "MOST_TERMS", 0)  # the index of all terms
    again = lexical.rank_documents(d, spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert lexical.rank_documents(docs.limit(0), items).collect() == []
    assert lexical.rank_documents(docs, items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, items).collect()] == [("i", 1, 1)]


def test_ranking_against_sql(spark):
    assert rows_of(lexical.op13_lexical_search(spark, SF)) == duck_rows(lexical.OP13_SQL, SF)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5000), st.integers(1, 300)), min_size=1, max_size=128), st.integers(0, 10**6))
def test_blocks_round_trip(posts, first):
    docs = first + np.cumsum([g for g, _ in posts]) - posts[0][0]
    tf = np.array([t for _, t in posts])
    x, y = lexical.unpack(lexical.pack(docs, tf), first, len(posts))
    assert x.tolist() == docs.tolist() and y.tolist() == tf.tolist()


def test_blocks_below_the_threshold_stay_compressed():
    n = 40_000
    rare, common = np.array([20, 300]), np.arange(0, n, 2)
    blocks = []
    for term, docs, tf in ((b"common", common, np.ones(len(common), int)), (b"rare", rare, np.full(2, 9))):
        g = lexical.impacts(tf, np.full(len(docs), 100))
        for a in range(0, len(docs), lexical.BLOCK):
            d = docs[a : a + lexical.BLOCK]
            blocks.append((term, int(d[0]), int(d[-1]), len(d), int(g[a : a + lexical.BLOCK].max()), lexical.pack(d, tf[a : a + lexical.BLOCK])))
    own = lexical.Searcher(list(range(n)), np.full(n, 100), blocks)
    docs, scores = own.top({b"common": 1, b"rare": 5000}, 2)
    assert docs.tolist() == [20, 300] and scores[0] == scores[1] > 0
    assert len(own.decoded) < len(blocks) // 4
