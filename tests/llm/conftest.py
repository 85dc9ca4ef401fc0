import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


ODD = [
    (1, None, None, "s"), (1, "", "en", None), (2, "   \t\r\n", "en", "s"), (3, "one", None, "s"), (None, "a b c d e f", "en", None),
    (4, "Same text here twice over and more", "en", "t"), (4, "Same text here twice over and more", "en", "t"),
    (5, "The MIT License and the general, public LICENSE; token= 'abc.def' api_key:\"zzzzzz9\" secret=token:abcdefgh", "en", "t"),
    (6, "AKIA" + "Z" * 16 + " x AKIA" + "9" * 15 + " " + "0f" * 12 + "g " + "ab" * 30 + "\n\n" + "ab" * 11, "en", "u"),
    (7, "\U0001F600 passWORD\"  :  'päss secret = a.b-c_d/e+f== Passwd=12345 <|endoftext|> x   y   z", "fr", "u"),
    (8, " ".join(["spam"] * 300) + "\n" + "\n".join(["line of it"] * 9) + "\nline of it ", "en", "v"),
    (9, " ".join(f"w{i}" for i in range(30000)), "en", "v"), (10, "x" * 200000, "en", "v"),
    (11, "licensed under CC BY-NC 4.0. Released under the MIT License. MIT license mit License", "en", "v"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").repartition(3)
    return df.select("*", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("row"), F.lit("x").alias("rank"), F.lit(2).alias("size"), F.lit(0).alias("_n"))
