"""Registered queries of the text operators and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from depthlens.llm.bpe_trie import encode_digests
from depthlens.llm.decontamination import contamination
from depthlens.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from depthlens.llm.language_crf import languages
from depthlens.llm.line_dedup import LINE_DEDUP_SQL, line_digests
from depthlens.llm.near_dedup import near_duplicates
from depthlens.llm.perplexity import quality_verdicts
from depthlens.llm.prefix_trie import CONVERSATION_TRIE_SQL, conversation_trie
from depthlens.llm.secret_scan import secret_digests
from depthlens.llm.substring_dedup import removal_digests
from depthlens.llm.text import documents
from depthlens.llm.token_counts import token_counts
from depthlens.llm.toxicity import toxicity
from depthlens.llm.url_filter import host_rules, pattern_rules, url_verdicts, verdict_sql


#: The links of the chain over the given labels, in order; the last one decides.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op1_toxicity(spark, sf_dir):
    """Probabilities of the chain's categories for every document, and whether it is rejected as toxic."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)


def op2_near_dedup(spark, sf_dir):
    """Components of documents whose 5-word shingle sets have a similarity of 0.85 or more."""
    return near_duplicates(documents(spark, sf_dir), percent=85)


def op3_token_counts(spark, sf_dir):
    """Tokens of every document under the byte-level vocabulary of 50k."""
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_dedup(spark, sf_dir):
    """Repeated runs of lines in every document: how much goes, and the digest of what is left."""
    return line_digests(documents(spark, sf_dir))


def op5_secret_scan(spark, sf_dir):
    """Secrets in every document: counts and digest of the base kinds, and all spans."""
    return secret_digests(documents(spark, sf_dir))


def op6_language_id(spark, sf_dir):
    """Language of every document by a model of the labelled documents outside the held-out fifth."""
    return languages(documents(spark, sf_dir))


def op7_bpe_roundtrip(spark, sf_dir):
    """Ids and decoded text of every document under the word vocabulary of 49k, as digests."""
    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_substring_dedup(spark, sf_dir):
    """Words of every document without windows of 50 words that start in an earlier document too."""
    return removal_digests(documents(spark, sf_dir))


def op9_decontamination(spark, sf_dir):
    """Benchmark windows of 10 words in every document."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_quality_rules(spark, sf_dir):
    """Base measures of every document and the verdict of its language's perplexity band."""
    return quality_verdicts(documents(spark, sf_dir))


#: Rules of ``op12_url_filter``: the given host rules, and patterns of pages that hold no text of their own (sign-in, baskets, reply
#: forms, downloads, further pages of a listing reached from a link), with the exception of help pages.
URL_RULES = [
    *host_rules([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]),
    *pattern_rules([
        "/login^", "/signin^", "/signup^", "/cart^", "/checkout^", "/wp-login.php", "?replytocom=", "^sessionid=", "?page=*&ref=", ".exe|", ".zip|",
        "@@||example.org/help/", "@@/docs/",
    ]),
]


def op11_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie over the rebuilt conversations."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_url_filter(spark, sf_dir):
    """Verdict of the host rules, and of url patterns where none fits, for every page."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of each anchor and positive, with labels moved on where the id is divisible by 7."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_bpe_roundtrip": op7_bpe_roundtrip,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_url_filter": op12_url_filter,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op4_line_dedup": LINE_DEDUP_SQL,
    "op11_conversation_trie": CONVERSATION_TRIE_SQL,
    "op12_url_filter": verdict_sql(URL_RULES),
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
