import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents with rows repeated, texts that are null, empty, blank and long, an id that is null, and a clashing column."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "x", 0), (900002, "", "en", "x", 0), (900003, " \n\t ", None, "x", 4), (None, "no id here at all", "en", "x", 17),
                                 (900004, "ab " * 20_000, "en", "x", 60_000), (900005, "word", "en", "x", 4), (900006, "Ünïcode\x1cÖ \U0001f642 x" * 3, "de", "x", 40)], docs.schema)
    return docs.unionByName(docs.where("doc_id < 5")).unionByName(odd).withColumn("kept", F.lit("mine")).cache()
