"""Stages and operators with columns of the names that they use themselves."""

import pytest
from pyspark.sql import functions as F

from periodlens.llm import decontam, htmlcut, langid, pii, simhash
from periodlens.llm.common import read


@pytest.fixture(scope="module")
def docs(spark):
    out = read(spark, "/root/testdata/sf0.001", "documents")
    for c in ("__bytes", "__pii_bytes", "__row_id", "__row_none", "__row_content", "__lid_bytes", "__lid_host", "__LID_CODE", "__id", "content", "_bytes", "row", "c0"):
        out = out.withColumn(c, F.lit(7))
    return out


def test_clean(spark, docs):
    bench = read(spark, "/root/testdata/sf0.001", "benchmark")
    got = decontam.clean(docs, bench)
    plain = decontam.clean(read(spark, "/root/testdata/sf0.001", "documents"), bench)
    assert got.columns == docs.columns and got.count() == plain.count() == got.where("__bytes = 7").count()


def test_redact(docs):
    few = docs.where("n_chars < 400")
    got = pii.redact(few)
    assert got.columns == docs.columns and got.where("__pii_bytes = 7").count() == few.count()


def test_one_per_group(spark, docs):
    got = simhash.one_per_group(docs)
    plain = simhash.one_per_group(read(spark, "/root/testdata/sf0.001", "documents"))
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in plain.collect())
    assert got.where("__row_id = 7 AND row = 7").count() == got.count()


def test_one_per_group_has_a_defined_tie(spark):
    """Of rows equal in id and text the same one stays, however they are dealt out."""
    rows = [(1, "some words that are all the same here", f"x{i}") for i in range(40)]
    kept = {simhash.one_per_group(spark.createDataFrame(rows[::k], "doc_id long, text string, extra string").repartition(n)).first().extra for k, n in ((1, 1), (-1, 5), (1, 7))}
    assert len(kept) == 1


def test_one_per_group_keeps_repeated_rows_once(spark):
    """Rows equal in every column, with and without an id, beside others of their id; columns that cannot be hashed."""
    a, b, c = ("one text with these few words", "quite another text about trains", "x y z")
    rows = [(1, a, {"k": 1}, 5)] * 3 + [(1, a, {"k": 1}, 6)] * 2 + [(None, b, None, 5)] * 4 + [(2, None, None, None)] * 2 + [(3, c, {}, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, __row_order int").repartition(4)
    got = simhash.one_per_group(df)
    assert got.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (None, b), (2, None), (3, c)], key=str)


def test_identify(docs):
    got = langid.identify(docs, "text", "lang", host_col="source")
    assert got.columns == docs.columns + langid.RESULT and got.where("__lid_bytes = 7 AND __LID_CODE = 7").count() == docs.count()
    assert langid.accepted_rows(docs, "text", "lang").columns == docs.columns


def test_extract(spark):
    pages = read(spark, "/root/testdata/sf0.001", "pages").withColumn("__html_bytes", F.lit(7))
    got = htmlcut.extract(pages)
    assert got.where("__html_bytes = 7").count() == pages.count()
