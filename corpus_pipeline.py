"""A cleaning pipeline over the documents table: each stage's rows are written and read again by the next."""

from __future__ import annotations

import public_tokenizers

from depthlens.llm.bpe_trie import encode_digests
from depthlens.llm.decontamination import remove_contaminated
from depthlens.llm.line_dedup import without_repeated_lines
from depthlens.llm.near_dedup import keep_one_of_each
from depthlens.llm.queries import CATEGORIES
from depthlens.llm.toxicity import toxicity
from depthlens.session import write_table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity chain rejects go; rows with a null id stay."""
    verdicts = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    rejected = verdicts.filter("rejected").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_lines(spark, docs, sf_dir):
    """Later copies of repeated line runs go, and with them documents of which nothing is left."""
    return without_repeated_lines(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates (similarity of 0.8 or more) stays."""
    return keep_one_of_each(docs, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a passage of the benchmark go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark, docs, sf_dir):
    """Token ids of what is left, as digests with the decoded text's."""
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The models and the tokenizer of the stages are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, one after the other, from the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
