"""Columns whose names differ from ours in case only, any number of rules, the whole pipeline over odd documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import pieces, toxicity, url_rules

SF = "/root/testdata/sf0.001"


def test_toxicity_keeps_columns_of_clashing_names(spark):
    chain = toxicity.Chain([toxicity.Link("junk", {"x": 3.0}, [], -1.0), toxicity.Link("toxic", {"bad": 9.0}, [0.0], -4.0)])
    docs = spark.createDataFrame([(1, "a bad x", 7, "q"), (2, None, 8, "r"), (3, "", 9, "s")], "doc_id long, text string, P_TOXIC int, _p0 string")
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, None, 8, "r"), (3, "", 9, "s")]
    scored = toxicity.score(docs, chain)
    assert scored.columns == ["doc_id", "text", "_p0", "p_junk", "p_toxic"] and scored.where("p_toxic > 0.9").count() == 1
    assert toxicity.drop_toxic(docs.limit(0), chain).collect() == []


def test_rules_and_pieces_replace_columns_in_whatever_case(spark):
    urls = spark.createDataFrame([("http://a.com/ads/x", "1", "2")], "url string, RULE string, Verdict string")
    got = url_rules.judge(urls, [url_rules.Rule("r", "block", "/ads/")])
    assert sorted(c.lower() for c in got.columns) == ["host", "path", "rule", "tier", "url", "verdict"] and got.first()["rule"] == "r"
    model = pieces.public_model()
    coded = pieces.encode(spark.createDataFrame([("ab", 5), (None, 6)], "text string, IDS int"), model, round_trip="ok")
    assert coded.columns == ["text", "ids", "ok"] and all(r["ok"] for r in coded.collect())
    back = pieces.decode(coded.withColumn("DECODED", F.lit(1)), model)
    assert back.columns == ["text", "ids", "ok", "decoded"] and [r["decoded"] for r in back.collect()] == ["ab", ""]


@pytest.mark.parametrize("loose", [3, 25])
def test_any_number_of_rules_without_a_token(spark, monkeypatch, loose):
    monkeypatch.setattr(url_rules, "MOST_LOOSE", 10)
    rules = [url_rules.Rule(f"r{i:02}", "block", f"*{i:02}*") for i in range(loose)] + [url_rules.Rule("named", "allow", "/casino/")]
    urls = spark.createDataFrame([(f"http://h{i:02}.org/p",) for i in range(30)] + [("http://x.org/casino/07" + "y" * 20_000,), (None,)], "url string")
    one, two = (url_rules.judge(urls, rules, max_local_rules=n) for n in (1000, 0))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one.where("rule is not null").count() == loose + 1


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ("P_TOXIC", "Component_Id", "IDS", "_gone", "n_hit", "TOKEN", "Row", "node", "item_id")
    odd = docs.withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    null = odd.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in odd.dtypes})
    return odd.unionByName(null).unionByName(null.withColumns({"doc_id": F.lit(10**9), "text": F.lit("")}))


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_the_whole_pipeline_over_odd_documents(spark, tmp_path, rows):
    docs = odd_documents(spark) if rows == "odd" else odd_documents(spark).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert first.columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_ids", "ids", "round_trip"]
    ids = [r["doc_id"] for r in got.collect()]
    assert (rows == "none" and ids == []) or (len(ids) > 20 and None in ids)
