import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, extra=False, ids=None, parts=3):
        rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:  # names that the operators use inside
            for c in ("fp", "score", "label", "bucket", "item", "key", "spans", "n", "block", "held", "anchor", "shard", "weight"):
                df = df.withColumn(c, df["doc_id"])
        return df.repartition(parts)

    return docs


#: Texts that break naive code: nothing, blanks, one character, ties, repeats, odd white space, specials, long runs.
ODD = [None, "", " ", "\n\t ", "a", "a", "a b", "A B", "x" * 5000, "ab " * 3000, "é" * 300, "日本語" * 200, "a\x00b\x1cc d", "<|endoftext|> x <|startoftext|>", "don't I'LL '''s", "one two three four", "one two three four", "😀 " * 40, "  two  spaces  ", "ÀÉ ß Σς İ"]
