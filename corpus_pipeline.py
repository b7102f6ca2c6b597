"""The documents pipeline: five stages over the documents table, each one of the operators of brindle.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs being what its predecessor kept (written as
Parquet and read again), and returns the documents that go on. All but the last return the columns of documents.

1. toxicity: trained on the labels of training rows; documents that score 0.5 or more go.
2. near copies: documents link if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. SimHash groups
   found by pigeonring chains come first, an exact join completes them, and every link is verified on the whole sets
   (brindle.llm.near_copies); of each group the document with the least id stays.
3. suffix arrays: bytes that lie in a string of 50 bytes that also starts in an earlier document go from the texts.
4. mixing: documents repeat as often as the mix of sources to weights 1, 2, 3 takes them (0 to 3 times).
5. SentencePiece: sampled piece ids of each text and their decoding; rows that repeat get one row each.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, near_copies, sentencepiece_sampling, simhash, suffix_dedup, toxicity
from brindle.llm.common import drop_folders, scratch_folders, shared_folder


#: Folders that the last stage's result may read; the next stage deletes them, since it starts from what has been written.
_READ: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_folders(spark, *_READ)
        _READ.clear()
        before = set(scratch_folders())
        out = f(spark, docs, sf_dir)
        _READ.extend(x for x in scratch_folders() if x not in before)
        return out

    return run_stage


@_stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(toxicity.fold(F.col("doc_id")) != 0))
    return toxicity.drop_toxic(docs, model)


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, near_copies.near_copy_components(docs))


@_stage
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.round_trip(docs, sentencepiece_sampling.load_pieces(spark))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash near-dedup", one_of_each),
    ("suffix-array dedup", remove_repeats),
    ("source mixing", mix),
    ("sentencepiece encoding", encode),
]

#: SQL can't express the trained stages; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each over its predecessor's output written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
