"""The stages in a row against the same stages on plain lists, and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siftmark.llm import queries
from tests.llm import brute
from tests.llm.data import SF, odd_documents, ordered, pairs, rows


def plain_run(docs, items, tokenizer, rejected):
    docs = [d for d in docs if d[0] not in rejected]
    cut = dict(brute.line_texts(docs))
    docs = [(d, cut[d]) for d, _ in docs if cut[d] is not None]
    component = {d: c for d, _, c in brute.near_duplicates(docs)}
    docs = [d for d in docs if component[d[0]] == d[0]]
    dirty = {r[0] for r in brute.decontamination(docs, items) if r[-1]}
    return brute.pieces([d for d in docs if d[0] not in dirty], tokenizer)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_run(spark, which, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tokenizer.encode_special_tokens = True
    sf_dir = SF
    if which == "odd":
        sf_dir = str(tmp_path)
        odd_documents(spark, False).write.parquet(f"{sf_dir}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf_dir}/{name}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    rejected = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    got = corpus_pipeline.run(spark, sf_dir)
    want = plain_run(pairs(docs), items, tokenizer, rejected)
    assert rows(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == ordered(want)


def test_stages_on_empty_and_clashing_tables(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert os.path.exists(queries.TOKENIZER)
