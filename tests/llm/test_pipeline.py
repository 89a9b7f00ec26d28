"""The pipeline's stages, each judged on its own input, and the registered corpus queries."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from siftlake.llm import bwt, mixing, sigtree
from siftlake.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_on_the_small_tables(spark, tmp_path):
    docs, names = spark.read.parquet(f"{SMALL}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        names = names or before.columns
        if k < 4:
            assert docs.columns == names
        rows = {r["doc_id"]: r for r in before.collect()}
        if k == 0:
            assert docs.count() == before.count()
        if k == 1:
            groups = {r["doc_id"]: r["component_id"] for r in sigtree.jaccard_components(before).collect()}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(groups.values()))
        if k == 2:
            removed = {r["doc_id"]: r for r in bwt.remove_repeats(before).collect()}
            for r in docs.collect():
                cut = removed[r["doc_id"]]["n_removed"]
                assert len(r["text"]) == r["n_chars"] and (cut > 0 or r["text"] == rows[r["doc_id"]]["text"])
                assert len(rows[r["doc_id"]]["text"].encode()) - len(r["text"].encode()) - cut in range(0, 7 * (1 + removed[r["doc_id"]]["n_spans"]))
        if k == 3:
            want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(before).collect() if r["taken"]}
            assert Counter(r["doc_id"] for r in docs.collect()) == want
        if k == 4:
            total = Counter()
            for r in docs.collect():
                total[r["sequence_id"]] += r["length"]
            assert max(total.values()) <= 2048
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_stages_keep_odd_rows_apart(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the thing " * 9, "en", None, 90), (3, "the thing " * 9, "en", None, 90), (None, "the thing " * 9, "en", "a", 90), (4, "the thing " * 8 + "end", "en", "a", 83)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SMALL)
            assert out.count() <= 2 * len(rows) + 2, name


def test_one_id_on_different_texts(spark):
    """Documents are told apart by id and text, in the join, in the mix and in the stages."""
    a, b = ("alpha beta gamma delta epsilon " * 9).split(), [f"w{i}" for i in range(60)]
    near = [*b[:59], "end"]
    rows = [(1, " ".join(x), "en", "s", 0) for x in (a, b)] + [(2, " ".join(a + ["more"] * 0), "en", "s", 0), (3, " ".join(near), "en", "s", 0)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = {(r["doc_id"], r["component_id"]) for r in sigtree.jaccard_components(docs.repartition(parts)).collect()}
        assert got == {(1, 1), (2, 1), (3, 1)}
        kept = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), SMALL).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted((1, " ".join(x)) for x in (a, b))
    # Fifty documents without an id, of ten words each, are fifty documents.
    texts = [(None, " ".join(f"t{i}x{k}" for k in range(10)), "en", "s", 0) for i in range(50)] + [(None, "ten words " * 5, None, "s", k) for k in range(40)] + [(9, "a b c " * 400, "en", "t", 0)]
    docs = spark.createDataFrame(texts, docs.schema)
    for parts in (1, 4):
        taken = mixing.mix(docs.repartition(parts)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
        assert all(abs(r["sum(taken)"] - r["max(target)"]) < (11 if r["source"] == "s" else 1201) for r in taken)
    once = sorted(tuple(r) for r in mixing.mixed(docs).select("text").groupBy("text").count().collect())
    assert once == sorted(tuple(r) for r in mixing.mixed(docs.repartition(3)).select("text").groupBy("text").count().collect())
    assert sum(n for t, n in once if not t.startswith("a b")) * 10 == sum(r["taken"] for r in mixing.mix(docs).collect() if r["source"] == "s")


def test_documents_without_any_language_stay(spark):
    docs = spark.createDataFrame([(i, f"some text number {i}", None, "s", 0) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(corpus_pipeline.language_id(spark, docs, SMALL).collect()) == sorted(docs.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SMALL)
    assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_every_operator_has_a_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
