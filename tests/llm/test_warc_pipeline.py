import io
import zipfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import warc
from freshet.llm.files import RangeReader

SF = "/root/testdata/sf0.001"
BIG = "<p>" + "é" * 100
PAGES = [(5, "http://a/", BIG), (3, "http://b/\r\nX: y", BIG), (9, None, BIG), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (6, "u", ""), (7, "u", "z" * 200_000), (3, "http://c/", BIG), (None, "n", BIG)]


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    packages = warc.write_packages(df, "file://" + str(tmp_path), most=2000)
    index = warc.read_index(packages)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digests(index).collect())
    size = lambda h: len((h or "").encode())
    want = sorted((str(p), size(h), "revisit" if size(h) >= 100 and h == BIG and p not in (3, None) else "response", 3 if h == BIG and p not in (3, None) else None) for p, _, h in PAGES)
    assert got == want
    records = warc.read_records(index).collect()
    assert sorted(len(r["payload"]) for r in records if r["record_type"] == "response") == sorted(w[1] for w in want if w[2] == "response")
    assert all(r["headers"]["WARC-Type"] == r["record_type"] for r in records)
    assert warc.read_index(warc.write_packages(df.limit(0), "file://" + str(tmp_path / "none"))).count() == 0


def test_directories_with_zip64_and_comments(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
        z.writestr("é", b"yy")
        z.comment = b"PK\x05\x06 no end"
    files = RangeReader()
    members = {m.name: m for m in warc.central_directory(files, str(path))}
    assert set(members) == {"big", "é"}
    at = warc.data_offset(files, str(path), members["big"])
    assert files.read(str(path), at, 1000) == b"x" * 1000


def test_a_directory_of_more_than_65535_members(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        z.writestr(zipfile.ZipInfo("last"), b"here")
    files = RangeReader()
    members = warc.central_directory(files, str(path))
    assert len(members) == 65_601 and files.read(str(path), warc.data_offset(files, str(path), members[-1]), 4) == b"here"


def test_what_is_no_package_is_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        warc.central_directory(RangeReader(), str(tmp_path / "x"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 100)
    (tmp_path / "y").write_bytes(packed.getvalue())
    files = RangeReader()
    with pytest.raises(ValueError):
        warc.data_offset(files, str(tmp_path / "y"), warc.central_directory(files, str(tmp_path / "y"))[0])


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    before, n = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == docs.columns and after.count() <= n
        n, before = after.count(), after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == n and last.where("not round_trip or n_ids = 0").count() == 0
    assert n > 0.7 * docs.count()


def test_pipeline_catches_what_is_planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.where("doc_id < 40")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    copies = clean.withColumn("doc_id", F.col("doc_id") + 100_000)
    leaked = clean.limit(3).withColumn("doc_id", F.col("doc_id") + 200_000).withColumn("text", F.concat("text", F.lit(" "), F.lit(item), F.lit(" zz "), F.col("doc_id")))
    odd = spark.createDataFrame([(300_000, None, None, None, None), (None, "", "en", "s", 0)], docs.schema)
    planted = clean.union(copies).union(leaked).union(odd)
    kept = corpus_pipeline.near_duplicates_go(spark, planted, SF)
    assert kept.where("doc_id between 100000 and 199999").count() == 0
    left = corpus_pipeline.benchmark_passages_go(spark, planted, SF)
    assert left.where("doc_id >= 200000 and doc_id < 300000").count() == 0
