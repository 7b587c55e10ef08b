"""Query of language identification: learns on four fifths of the documents and predicts all."""

from pyspark.sql import functions as F

from .common import table
from .langid import learn, predict


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    return predict(docs, learn(docs.filter("not held_out")), ["doc_id", "held_out"])


QUERIES = {"op3_language_id": op3_language_id}
ORACLES = {}
