"""A small table with what operators must bear: nulls, blanks, repeats, ties, a long text, clashing columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("_id", T.StringType()), T.StructField("_t", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("n_chars", T.LongType()),
])


def sentence(i: int, n: int = 40) -> str:
    return " ".join(f"w{(i * 7919 + k * k * 31) % 9973}x" for k in range(n))


def texts() -> list[tuple]:
    a, b = sentence(1, 60), sentence(2, 60)
    shared = sentence(3, 45)
    return [
        (1, a), (2, a), (3, b + "\n" + shared), (4, sentence(5, 50) + "\n" + shared + " tail"), (5, None), (6, ""), (7, "   \n "), (8, "one two"), (9, "One two"), (10, b + " extra\n" + shared),
        (11, "ab " * 3000), (12, "short line"), (12, "short line"), (None, a), (13, sentence(6, 30000)), (14, "é" * 500 + " " + "é" * 500), (15, sentence(7, 36)),
    ]


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "x", 7, 3, None if t is None else len(t)) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
