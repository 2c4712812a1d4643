"""From raw documents to token ids, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept; all but the last return the columns of ``docs``:

1. toxicity: rows scored toxic go (the model learns from the labelled rows);
2. exact dedup: of equal texts the one with the largest id stays;
3. SimHash near-dedup: three-word shingles, at most two bits apart; of each
   group of linked documents the one with the smallest id stays;
4. mixing: every source gets the same expected share, by Poisson copies;
5. BPE: token ids of every text, with digests of them and of their decoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martwright.llm import bpe, exact_dedup, mixing, queries, simhash, toxicity
from martwright.llm.common import delete_folder, pin, scratch

#: a trained stage has no SQL equivalent; tests hold the rows against a brute-force version
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, words=3, radius=2)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, numbered=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.token_digests(bpe.encode_documents(docs, queries.tokenizer()), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("bpe_encode_decode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is pinned in the shared folder, and
    what its stage pinned on the way, and the result before it, deleted then."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = pin(stage(spark, docs, sf_dir))
            result = made.pop()
        if before:
            delete_folder(spark, before)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
