"""The registered corpus queries on the smallest sample, and the pipeline."""

from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="sample tables are not here")

import corpus_pipeline  # noqa: E402
from check_oracles import compare, connect  # noqa: E402
from tenderloom.llm.catalog import QUERIES, SQL  # noqa: E402
from tenderloom.llm.common import table  # noqa: E402


OTHER_ROWS = ("op8_benchmark_leaks", "op11_embedding_whitening", "op13_conversation_trie")


@pytest.mark.parametrize("name", list(SQL))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, str(FOLDER))
    result = connect(str(FOLDER)).execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert compare(df.collect(), df.columns, result.fetchall(), columns) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in OTHER_ROWS])
def test_one_row_per_document(spark, name):
    ids = [r.doc_id for r in QUERIES[name](spark, str(FOLDER)).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in table(spark, str(FOLDER), "documents").select("doc_id").collect())


def test_pipeline_narrows_documents(spark):
    before = {r.doc_id for r in table(spark, str(FOLDER), "documents").collect()}
    docs = table(spark, str(FOLDER), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(FOLDER))
        assert kept.columns == docs.columns
    rows = corpus_pipeline.run(spark, str(FOLDER)).collect()
    assert rows and {r.doc_id for r in rows} < before and all(r.taken > 0 for r in rows)


def test_pipeline_of_odd_rows(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            kept = stage(spark, docs, str(FOLDER))
            assert kept.columns == docs.columns
            assert kept.count() <= docs.count()
