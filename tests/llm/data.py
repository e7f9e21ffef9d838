"""Small tables with the awkward cases, and the driver's smallest tables."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

PASSAGE = " ".join(f"word{i}é" for i in range(90))
ODD = [
    None, "", " ", "\n\n", "a", "One two\tthree\x0bfour", "x" * 5000, "a b " * 700, PASSAGE, PASSAGE,
    "before it " + PASSAGE + " and after", PASSAGE.upper(), "tail joined   words\r\nnext", "<|endoftext|> a",
    "  two  blanks   here ", "it's a dog's life, they'll say: (no) \"yes\" 12345 1.5e9!",
    "line one is here\nline two is here\nline three\nfour", "line one is here\nline two is here\nother\nfour",
    "\U0001f600 smile é combine\u0085next​zero", "ab" * 900,
]


def odd_documents(spark, extra: bool = True):
    rows = [(i, t, ["en", None, "de"][i % 3], "s", len(t or "")) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # columns named like results and helpers of the operators
        for name in ("place", "row", "kept", "n_words", "fingerprint", "shard", "measures", "line", "stratum"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
