"""A corpus pipeline: quality, near-duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from strandline.llm import decontam, mixing, quality, sharding, simhash
from strandline.llm.common import read_table, release, shared_dir

#: Words of a shingle and the Jaccard similarity from which documents are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8


def good_documents(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def first_of_near_duplicates(spark, docs, sf_dir):
    """The document with the smallest id of each group of near-duplicates.

    SimHash links as in op8 (4 of 64 bits, here of 5-word shingles) give candidates. They find 5 of the 293 pairs of sf0.1
    whose 5-word shingle sets are similar by 0.8 or more, so bands of minima give those farther apart. The sets decide.
    """
    return simhash.keep_first(docs, SHINGLE, SIMILARITY)


def without_benchmark(spark, docs, sf_dir):
    """Documents in which no window of a benchmark item occurs."""
    marked = decontam.mark(docs.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(docs.columns)}).withColumnRenamed(f"__c{docs.columns.index('text')}", "text"), read_table(spark, sf_dir, "benchmark"))
    clean = marked.filter("n_hit = 0")
    return clean.select(*[clean["text" if c == "text" else f"__c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def mixed(spark, docs, sf_dir):
    """Documents of each source as often as the mix takes them."""
    return mixing.mix_documents(docs)


def sharded(spark, docs, sf_dir):
    """Shard and slot of every document of the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", first_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL has no minima of XXH64, no training and no CRC32.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of all stages over the documents of sf_dir."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            release(spark, before)  # what the stage read is needed no more
        before = f"{folder}/{name}"
    return docs
