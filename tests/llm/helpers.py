"""Small inputs shared by the tests of the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty, white space, ties, repeats, odd characters, special-token strings and a long text.
ODD_TEXTS = [
    None, "", " ", "\n\n \t", "a", "a  b", "a \n b\n\n c ", "it's  we'll DON'T", "x\x1cy \x1d z", " non　break   end ",
    "é café Å", "1234 56.78%%% ***", "<|endoftext|> and <|startoftext|>x", "\U0001f600\U0001f600 emoji‍", "aaaaaaaaaaaa aaa",
    "Über straße İstanbul", "the quick brown fox " * 3000, "word" * 5000,
]


def documents(spark, texts=ODD_TEXTS, extra=True):
    """A documents table with a null id and a repeated row, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)]
    rows += [(None, "no id", None, None, 3), rows[-1], rows[0]]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("size", "part", "key", "label", "rank", "tie", "score", "value", "words", "target"):
            df = df.withColumn(name, F.lit("x"))
    return df
