"""Every stage of the pipeline against a plain restatement, on what the stage before it kept."""
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import brute
import corpus_pipeline
from sourceloom.llm import mixing, toxicity

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, each written as Parquet and read again."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = pq.read_table(f"{SOURCE}/documents.parquet")
    insulting = "you idiot, you moron. what a pathetic loser, and they said it twice"
    more = [(9001, insulting, "en", "src1", len(insulting)), (9002, None, "en", None, None), (9003, "", "de", "src2", 0)]
    rows = docs.to_pylist() + [dict(zip(docs.schema.names, r)) for r in more]
    sf_dir = str(root / "sf")
    (root / "sf").mkdir()
    pq.write_table(pa.Table.from_pylist(rows, schema=docs.schema), f"{sf_dir}/documents.parquet")
    pq.write_table(pq.read_table(f"{SOURCE}/labels.parquet"), f"{sf_dir}/labels.parquet")
    held, current = [("documents", rows)], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(root / name)
        stage(spark, current, sf_dir).write.parquet(path)
        current = spark.read.parquet(path)
        held.append((name, [r.asDict() for r in current.collect()]))
    return sf_dir, held


def texts(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_columns_are_kept(stages):
    for name, rows in stages[1][:-1]:
        assert list(rows[0]) == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_toxic_documents_go_and_no_other(spark, stages):
    sf_dir, held = stages
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    lexicon = toxicity.Lexicon(model.words, model.beginnings)
    want = {i for i, t in texts(held[0][1]) if model.score(t or "", lexicon) < 0.5}
    assert {r["doc_id"] for r in held[1][1]} == want and 9001 not in want and {9002, 9003} <= want


def test_repeated_lines_go(stages):
    before, after = stages[1][1][1], stages[1][2][1]
    plain = brute.delete_lines(texts(before))
    want = {i: kept for i, (kept, total, gone) in plain.items() if gone < total}
    assert {r["doc_id"]: r["text"] or "" for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1][2][1], stages[1][3][1]
    groups = brute.near_components(texts(before), size=5)
    assert sorted(r["doc_id"] for r in after) == sorted({component for _, component in groups.values()})
    assert {r["doc_id"]: r for r in after} == {r["doc_id"]: r for r in before if groups[r["doc_id"]][1] == r["doc_id"]}


def test_sources_are_mixed(stages, tmp_path):
    before, after = stages[1][3][1], stages[1][4][1]
    con = duckdb.connect()
    con.register("arrow_docs", pa.Table.from_pylist(before, schema=pq.read_schema(f"{SOURCE}/documents.parquet")))
    con.execute("CREATE VIEW documents AS SELECT * FROM arrow_docs")
    want = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.SQL})").fetchall())
    assert sorted(r["doc_id"] for r in after) == want


def test_all_is_packed(stages):
    before, after = stages[1][4][1], stages[1][5][1]
    by_doc, by_sequence = {}, {}
    for p in after:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    count = {}
    for r in before:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert {i: sum(p["length"] for p in own) for i, own in by_doc.items()} == {i: n * by_doc[i][0]["doc_tokens"] for i, n in count.items()}
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) <= 2048


def test_run_is_the_last_stage(spark, stages):
    sf_dir, held = stages
    rows = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length").collect()]
    assert sum(r[2] for r in rows) == sum(p["length"] for p in held[5][1])


def test_clashing_columns_and_empty_tables(spark, make_docs, tmp_path):
    pq.write_table(pq.read_table(f"{SOURCE}/labels.parquet"), str(tmp_path / "labels.parquet"))
    clash = ["rid", "row_key", "kept_rid", "copies", "marked_places", "place", "nth", "places", "fp", "component", "toxic", "rate"]
    for rows in ([(1, "some text of words here"), (1, "some text of words here"), (None, "no id"), (None, None), (4, "")], []):
        current = make_docs(rows, clash)
        columns = current.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, str(tmp_path))
            assert current.columns == columns, name
            current = spark.createDataFrame(current.collect(), current.schema)
        corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path)).collect()


def test_near_duplicates_are_the_groups_of_fingerprints(spark, make_docs):
    """A pair two bits apart is one group though its five-word shingles fall below Jaccard 0.8; one further apart is not."""
    words = [f"w{k}" for k in range(400)]
    texts = {1: words}
    for seed in (74, 245):
        texts[seed] = list(words)
        for k in range(9):
            texts[seed][40 * k + 5 + seed % 30] = f"n{seed}x{k}"
    rows = [(i, " ".join(text)) for i, text in texts.items()]
    apart = [(brute.simhash(text) ^ brute.simhash(rows[0][1])).bit_count() for _, text in rows]
    assert apart == [0, 2, 14]
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 245]
