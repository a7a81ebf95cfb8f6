import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, **constant):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(rows), "doc_id long, text string").coalesce(2)
        extra = {"row": F.lit("r"), "words": F.lit("w"), "pos": F.lit(1), "fp": F.lit(2), "doc": F.lit("d"), "size": F.lit(0), "key": F.lit("k"), "score": F.lit("s"), "n": F.lit(None).cast("int"), "lang": F.lit("en"), "source": F.lit("a")}
        return df.withColumns(extra | {k: F.lit(v) for k, v in constant.items()})

    return make


#: Texts that every operator has to take: null, empty, white space, controls, a long one, letters of many kinds.
ODD = [(None, "no id at all"), (100, None), (101, ""), (102, " \t\n\x0b\x0c\r "), (103, "a\x00b \x1f é É ñ 日本 😀 <|endoftext|>"), (104, "word " * 30_000), (105, "x" * 20_000), (106, "same same"), (106, "same same")]
