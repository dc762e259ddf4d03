import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as ent
from periodlens.llm import merkle, queries
from periodlens.plans import verify

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes):
    """Root, and per leaf the (left, right) siblings from the bottom up."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for j, i in enumerate(at):
            start = i // 3 * 3
            paths[j].append(("".join(level[start:i]), "".join(level[i + 1 : start + 3])))
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return (level[0] if level else None), paths


def fold(start, path):
    for left, right in path:
        start = H(left, start, right)
    return start


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = {}, {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s], paths[s] = tree([leaf(r) for r in by[s]])
    root, upper = tree([subs[s] for s in names])
    out = []
    for s, up in zip(names, upper):
        for r, own in zip(by[s], paths[s]):
            path = own + up
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            got = fold(leaf((*r[:4], text)), path)
            out.append((r[0], leaf(r), subs[s], root, H(*[a + b for a, b in path]), got, got == root))
    return out


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def run(spark, docs, every=4, shared=merkle.SHARED):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = merkle.manifest(docs, altered={"text": text}, every=every, shared=shared).withColumn("f", merkle.folded("altered"))
    return [tuple(r) for r in m.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(), "f", F.col("f") == F.col("root")).collect()]


def messy(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([None, "", "hot", "hot", "hot", "s1", "ß", "\U0001f600", "￮"])
        text = rng.choice([None, "", "a\nb", "ü\n\n x", "plain", "same\ntext"])
        rows.append((None if i % 37 == 0 else i // 2 if i % 11 == 0 else i, source, rng.choice([None, "en"]), rng.choice([None, -3, 12]), text))
    rows += [rows[5]] * 3 + [(7, "one", "de", 1, "x" * 300_000 + "\n")]
    return rows


@pytest.mark.parametrize("every,shared", [(1, 10), (2, 0), (4, merkle.SHARED)])
def test_against_plain_python(spark, every, shared):
    rows = messy()
    got = run(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), every, shared)
    assert sorted(got, key=_key) == sorted(brute(rows), key=_key)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 3, 82])
def test_sizes_around_a_subtree(spark, n):
    rows = [(i, "s", "en", i, f"t{i}\n") for i in range(n)]
    assert sorted(run(spark, spark.createDataFrame(rows, SCHEMA))) == sorted(brute(rows))


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, spark.createDataFrame([], SCHEMA)) == []
    rows = [(i, None, None, None, None) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("pos", "total", "part", "at", "leaf", "altered", "path", "items", "grp", "id", "root", "l0", "subtree", "_group"):
        docs = docs.withColumn(c, F.lit("x"))
    assert sorted(run(spark, docs)) == sorted(brute(rows))


def test_change_is_found(spark):
    """A proof folds to the root for its own leaf alone."""
    rows = messy(60, 9)
    m = merkle.manifest(spark.createDataFrame(rows, SCHEMA), altered={"n_chars": F.lit(99)})
    assert m.where(merkle.folded("leaf") != F.col("root")).count() == 0
    assert m.where(merkle.folded("altered") == F.col("root")).count() == 0


def test_query_matches_sql(spark, sf001):
    ok, said = verify.compare(spark, verify.duck(sf001), "op12_merkle", sf001, ent.queries(), ent.oracle_sql())
    assert ok, said
    types = dict(queries.op12_merkle(spark, sf001).dtypes)
    assert types["doc_id"] == "bigint" and types["verified"] == "boolean"
