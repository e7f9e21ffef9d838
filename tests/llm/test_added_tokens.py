"""Queries on texts with strings of added tokens, against an unmodified tokenizer."""

import corpus_pipeline
from siftmark.llm import queries
from tests.llm import brute
from tests.llm.data import ordered, pairs, rows

TEXTS = ["a <|endoftext|> b", "<|endoftext|> a", "x<|endoftext|><|endoftext|>", "it  <|endoftext|>\n\n b\nc <|endof",
         " <|endoftext|>", "<|endoftext|>", "two words  \n<|endoftext|>é tail", "plain text here", "", None]


def test_queries(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = ordered(brute.pieces(pairs(docs), tokenizer))
    for got in (queries.op2_binary_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert rows(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == want
    got = queries.op7_offset_token_counts(spark, str(tmp_path))
    assert rows(got, *got.columns) == ordered(brute.section_tokens(pairs(docs), tokenizer, "most"))
