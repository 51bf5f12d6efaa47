import zlib

import duckdb
import pytest

import corpus_pipeline
from claimcheck.llm import entry

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept, names = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == names
        docs = out
        n = docs.count()
        assert 0 < n <= kept
        kept = n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == kept
    whole = corpus_pipeline.run(spark, D)
    assert sorted(map(str, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, empty tables, for each stage."""
    text = "the quick brown fox was over the lazy dog and then it was in the house "
    other = "le petit chat est dans la maison avec les enfants et il mange une pomme "
    rows = [(i, f"{text if i % 2 else other}{i} " * 3, "en" if i % 2 else "fr") for i in range(1, 41)]
    rows += [(50, None, "en"), (51, "", None), (52, "123 456", "en"), (53, text * 4000, "en"), (None, other * 2, "fr"), (7, rows[6][1], "en"), (7, rows[6][1], "en")]
    docs = spark.createDataFrame([(k, t, g, "s", len(t or ""), 1, 2) for k, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, language int, contamination int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and out.schema["language"].dataType.simpleString() == "int", name
        kept = [r["doc_id"] for r in out.collect()]
        if name == "language_id":
            assert not {50, 51, 52} & set(kept) and kept.count(7) == 3 and 53 in kept and None in kept
        elif name == "near_dedup":
            assert kept.count(7) == 1 and {50, 51, 52, 53, None} <= set(kept)
        else:
            assert kept.count(7) == 3 and {50, 51, 52, 53, None} <= set(kept)
        assert stage(spark, docs.limit(0), D).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.where("piece = 0").count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), D).count() == 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = entry.queries()[name](spark, D)
    cursor = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    columns = sorted(names)
    assert columns == sorted(got.columns)
    want = sorted(str([r[names.index(k)] for k in columns]) for r in cursor.fetchall())
    assert sorted(str([r[k] for k in columns]) for r in got.collect()) == want


def test_folds(spark):
    from claimcheck.llm.langid import fold

    assert [r[0] for r in spark.range(50).select(fold("id", 4)).collect()] == [zlib.crc32(str(k).encode()) % 4 for k in range(50)]
