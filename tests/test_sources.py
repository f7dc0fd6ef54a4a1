"""Readers and writers on small files."""

import gzip
import json
import zipfile

from corpusmill.sources import readers as R
from corpusmill.sources import writers as W


def test_documents_and_metadata(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(json.dumps({"id": "1", "text": "x", "metadata": {"source_domain": "d.com", "url": "u"}}) + "\n")
        f.write(json.dumps({"dolma_id": "2", "text": "y", "metadata": json.dumps({"source_domain": "e.com"})}) + "\n{broken\n")
    got = sorted((r.id, r.source_domain, r.url) for r in R.documents(spark, str(tmp_path / "a.json.gz")).collect())
    assert got == [("1", "d.com", "u"), ("2", "e.com", None)]


def test_essays_json(spark, tmp_path):
    row = {"id": "1", "text": "abc", "edits": [[0, [[0, 1, "x"], [2, 2, None]]], [1, []]]}
    (tmp_path / "A.train.json").write_text(json.dumps(row) + "\n")
    r = R.essays_json(spark, str(tmp_path / "A.train.json")).first()
    assert (r.cefr, r.level, r.split, [tuple(e) for e in r.edits]) == ("N", "A", "train", [(0, 1, "x"), (2, 2, None)])


def test_zip_and_index(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("d/1.txt", "café".encode("latin-1"))
        z.writestr("d/2.txt", " ")
    index = spark.createDataFrame([("1.txt",), ("2.txt",), ("3.txt",)], "Text string")
    kept, missing = R.indexed_texts(R.zipped_texts(spark, str(tmp_path / "t.zip")), index, "Text")
    assert [(r.file, r.text) for r in kept.collect()] == [("1.txt", "café")]
    assert [r.file for r in missing.collect()] == ["3.txt"]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "k int, s string, x double")
    W.parquet(df, str(tmp_path / "p"), "s")
    W.csv(df, str(tmp_path / "c"))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 2]
    assert sorted(r.k for r in R.scored_csv(spark, str(tmp_path / "c"), "k int, s string, x double").collect()) == [1, 2]
    W.replace_partitions(df.where("k = 2").selectExpr("k + 5 as k", "s", "x"), str(tmp_path / "p"), "s")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 7]
    W.report(df.limit(1), str(tmp_path / "r"))
    W.report(df.limit(1), str(tmp_path / "r"), append=True)
    assert spark.read.text(str(tmp_path / "r")).count() == 2
    assert R.summary(spark, str(tmp_path / "none"), "a int") is None


def test_stream_is_keyed_and_resumes(spark, tmp_path):
    from corpusmill.streaming.ingest import ingest_once

    src, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(5).write.parquet(src)
    assert ingest_once(spark, src, ["id"], sink=sink, checkpoint=mark).count() == 5
    spark.range(3, 8).write.mode("append").parquet(src)
    assert ingest_once(spark, src, ["id"], sink=sink, checkpoint=mark).count() == 8
