"""The whole pipeline against its stages computed plainly: SQL, all pairs, and the whole tokenizer."""

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenseq.llm import queries, simhash
from lumenseq.llm.components import components, forest

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from read_parquet('{SF}/benchmark.parquet')")
    con.sql(f"create table documents as select * from read_parquet('{SF}/documents.parquet')")
    con.sql(f"create table kept as {queries.OP3_SQL}")
    con.sql("delete from documents where doc_id in (select doc_id from kept where not kept)")
    con.sql(f"create table cut as {queries.OP6_SQL}")
    con.sql("update documents set text = cut.text from cut where cut.doc_id = documents.doc_id")
    texts = dict(con.sql("select doc_id, text from documents").fetchall())
    sets = {k: set(simhash.shingles(v.encode(), 5).tolist()) for k, v in texts.items()}
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    roots = forest((a, b) for a in sets for b in sets if a <= b and alike(sets[a], sets[b]))
    least = sorted(set(roots.values()))
    once = simhash.keep_one(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(7))
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == least
    con.execute("delete from documents where doc_id not in (select unnest(?))", [least])
    con.sql(f"delete from documents where doc_id in (select doc_id from ({queries.OP7_SQL}))")
    whole = Tokenizer.from_file(queries.tokenizer_path())
    want = {k: [*whole.encode(v, add_special_tokens=False).ids, 2] for k, v in con.sql("select doc_id, text from documents").fetchall()}
    found = corpus_pipeline.run(spark, SF).toPandas()
    assert set(found.doc_id) == set(want) and len(want) < len(texts)
    for doc_id, pieces in found.sort_values("start").groupby("doc_id"):
        assert (pieces.start.to_numpy() == np.cumsum(pieces.length) - pieces.length).all() and pieces.length.sum() == len(want[doc_id]) == pieces.doc_tokens.iloc[0]
    for _, sequence in found.sort_values("offset").groupby("sequence_id"):
        assert (sequence.offset.to_numpy() == np.cumsum(sequence.length) - sequence.length).all() and sequence.length.sum() <= 4096


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", None, None), (1, "", "en", "s", 0), (None, "a few words " * 40, None, "s", 9), (2, "word " * 30000, "de", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == docs.columns, name
        assert corpus_pipeline.pack(spark, frame, SF).groupBy().agg(F.countDistinct("sequence_id")).first()[0] >= 0


def test_near_duplicates_runs_one_python_step_a_task(spark, monkeypatch):
    plans = []

    def seen(edges):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return components(edges)

    monkeypatch.setattr(simhash, "components", seen)
    copies = [(i, " ".join(f"w{(i % 40) * (j == i % 97) + j}" for j in range(120))) for i in range(60)]
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    assert simhash.keep_one(docs).count() < len(copies)
    assert plans and not any("InArrow" in plan for plan in plans)  # components begins with a Python step of its own
