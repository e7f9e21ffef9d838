"""Token counts of sections against the tokenizer's own offsets."""

import pytest

from siftmark.llm import attribution, queries
from tests.llm import brute
from tests.llm.data import SF, odd_documents, ordered, pairs, rows


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.TOKENIZER)
    made.encode_special_tokens = True
    return made


@pytest.mark.parametrize("rule", attribution.RULES)
@pytest.mark.parametrize("which", ["odd", "empty", "sf"])
def test_lines(spark, tokenizer, rule, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "sf" else odd_documents(spark)
    docs = docs.limit(0) if which == "empty" else docs.union(docs.limit(3))
    docs = docs.union(docs.limit(1).selectExpr("doc_id", "'a\n\n\nb \n \n c\n\n' as text", *docs.columns[2:]))
    got = attribution.section_tokens(docs, queries.TOKENIZER, rule)
    want = brute.section_tokens(pairs(docs), tokenizer, rule)
    plain = [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows(got, *got.columns)]
    assert ordered(plain) == ordered(tuple(round(float(x), 6) if i == 4 and rule == "split" else x
                                           for i, x in enumerate(r)) for r in want)


def test_given_sections(spark):
    docs = spark.createDataFrame(
        [(1, "abcdefgh ijkl", [(0, 3), (3, 9)]), (2, "xyz", None), (3, None, [])],
        "doc_id long, text string, parts array<struct<start:long,end:long>>",
    )
    got = attribution.section_tokens(docs, queries.TOKENIZER, "split", "parts").orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["section"], r["start"], r["end"]) for r in got] == [(1, 0, 0, 3), (1, 1, 3, 9), (2, None, None, None), (3, None, None, None)]
    assert sum(r["n_tokens"] for r in got) <= got[0]["doc_tokens"]
    bad = docs.selectExpr("doc_id", "text", "array(named_struct('start', 5L, 'end', 8L), named_struct('start', 0L, 'end', 6L)) as parts")
    with pytest.raises(Exception, match="disjoint"):
        attribution.section_tokens(bad, queries.TOKENIZER, "most", "parts").collect()
    with pytest.raises(ValueError):
        attribution.section_tokens(docs, queries.TOKENIZER, "last")
