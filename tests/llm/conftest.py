import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs or texts."""
    from sourceloom.llm.common import prepare
    prepare(spark)

    def make(rows, extra=None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            from pyspark.sql import functions as F
            for name in extra:
                df = df.withColumn(name, F.lit("x"))
        return df.repartition(3)
    return make


@pytest.fixture(scope="session")
def sample_docs():
    """(doc_id, text) of the smallest documents table."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
