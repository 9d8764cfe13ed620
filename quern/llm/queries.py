"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import binary, chat, compression, media, minhash, mixing, packing, secrets, substring, toxicity
from quern.llm.common import table


def op1_chat(spark, sf_dir):
    """Every conversation, written down as a transcript in one of several marker styles, with some markers lost, parsed
    and rendered again."""
    conversations = table(spark, sf_dir, "conversations")
    return chat.formatted(chat.transcripts(conversations, mixed=True), chat.fit(spark, conversations))


def op2_toxicity(spark, sf_dir):
    """The documents that the lexicon rejects."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels"))).where(F.col("toxic"))


def op3_compression(spark, sf_dir):
    """Every document with its ratios and decision."""
    return compression.compression_bands(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark, sf_dir):
    """Every document that goes, with the one that stays for it."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark, sf_dir):
    """Every secret with its rule, place and digest."""
    return secrets.find(table(spark, sf_dir, "documents"))


def op5_media(spark, sf_dir):
    """Every page with its true type and the media in it."""
    pages = table(spark, sf_dir, "pages")
    return media.inspect(pages.withColumn("declared", media.declared_by_url("url")), "page_id", "html", "declared")


def op6_mixing(spark, sf_dir):
    """The order of the mixture: every document once at least."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    """Every piece with its bin."""
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op9_binary(spark, sf_dir):
    """All texts as coded blocks of token ids."""
    return binary.write(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    """Every span to remove."""
    return substring.repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_toxicity, op3_compression, op4_near_dedup, op5_media, op6_mixing, op7_secrets, op8_packing, op9_binary, op10_substring_dedup)}
SQL: dict[str, str] = {"op10_substring_dedup": substring.SQL}
