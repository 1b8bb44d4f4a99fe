"""A training corpus from ``documents`` in five stages.

Each stage works on all rows its predecessor kept, which are written and read
again in between.  Mixing settles the order of the rows, which packing takes from
the stage's files.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from factgraph.functions.storage import dropping_scratch, remove, shared_folder
from factgraph.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality_rules.keep(docs)),
    ("n-gram Jaccard join", lambda spark, docs, sf_dir: ngram_join.keep_one(docs)),
    ("suffix-array dedup", lambda spark, docs, sf_dir: suffix_dedup.remove(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(packing.in_written_order(docs))),
]

# compression, MinHash, suffix sorting and tokens are not for SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/factgraph/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        with dropping_scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:       # the stage before is read no more
            remove(spark, f"{folder}/{i - 1}")
    return docs
