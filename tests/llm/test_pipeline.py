import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from periodlens.llm import decontam, langid, pii
from periodlens.llm.common import read
from tests.llm import test_decontam, test_packing, test_simhash


def test_stages_one_by_one(spark, sf001):
    """Every stage against a plain version of its decision, on what the stage before it kept."""
    docs = read(spark, sf001, "documents")
    columns = docs.columns
    items = [tuple(r) for r in read(spark, sf001, "benchmark").select("item_id", "text").collect()]
    pairs = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    kept = {n: None for n, _ in cp.STAGES}
    for name, stage in cp.STAGES:
        before = pairs(docs)
        out = stage(spark, docs, sf001).cache()
        if name == "packing":
            test_packing.check(out.collect(), before)
            break
        assert out.columns == columns
        after = pairs(out)
        kept[name] = (len(before), len(after))
        if name == "language":
            found = langid.identify(docs, "text", "lang", host_col="source").where("accepted")
            assert after == pairs(found) and len(after) >= 0.97 * len(before)
        elif name == "near_duplicates":
            least = {c for _, _, c in test_simhash.brute(before)}
            assert {i for i, _ in after} == least and len(after) == len(least)
        elif name == "decontamination":
            bad = {d for d, _ in test_decontam.brute(before, items)}
            assert after == [x for x in before if x[0] not in bad] and bad
        else:
            assert [i for i, _ in after] == [i for i, _ in before]
            assert all(not pii.base_spans(t) for _, t in after)
            assert any(a != b for a, b in zip(after, before))
            assert out.where("n_chars <> length(text)").count() == 0
        docs = out


def test_run(spark, sf001):
    rows = cp.run(spark, sf001).collect()
    assert rows and len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_edge_rows(spark, sf001, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing extra columns; then an empty table."""
    docs = read(spark, sf001, "documents").where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", None, 0), (901, "", None, "src0", None), (902, " \n", "en", "src0", 2)], docs.schema)
    text = docs.orderBy(F.desc("n_chars")).first().text
    again = spark.createDataFrame([(None, text, None, None, None), (None, text, None, None, None), (3, text * 9, "xx", "", -1)], docs.schema)
    extra = docs.unionByName(odd).unionByName(again).unionByName(docs).withColumns(
        {"language": F.lit("x"), "accepted": F.lit(1), "ids": F.lit(2), "fp": F.lit(3), "component_id": F.lit("c"), "spans": F.lit(0), "label": F.lit(None).cast("int")})
    for table in (extra, extra.limit(0)):
        now = table
        for name, stage in cp.STAGES:
            before, now = now, stage(spark, now, sf001).cache()
            if name != "packing":
                assert now.columns == table.columns
                assert now.count() <= before.count()
        assert (now.count() > 0) == (table is extra)


def test_missing_import_is_not_hidden():
    with pytest.raises(ImportError):
        exec("from periodlens.llm import no_such_operator")
    assert decontam and 4 <= len(cp.STAGES) <= 5
