"""The registered corpus queries and the pipeline on the smallest tables."""

import corpus_pipeline
import pytest

from checks.compare import compare, duck
from tideline.llm.common import stored, table
from tideline.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twins(spark, name):
    good, note = compare(spark, duck(SMALL), name, QUERIES[name], ORACLE[name], SMALL)
    assert good, note


def test_there_is_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_every_query_has_a_row_per_input_row(spark):
    for name, fn in QUERIES.items():
        of = "pages" if name[:4] in ("op2_", "op6_") else "embeddings" if name.startswith(("op3_", "op11_")) else "documents"
        assert fn(spark, SMALL).count() == table(spark, SMALL, of).count(), name


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns, rows = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        rows.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(later <= earlier for earlier, later in zip(rows, rows[1:], strict=False))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() and set(columns) < set(last.columns)
    assert len(rows[3]) < len(rows[2]) <= len(rows[1]) < len(rows[0])
