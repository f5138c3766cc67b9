"""Training-data pipeline over ``documents``: five stages, each a table of its own.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame; it is written as Parquet
and read again as the next one's documents. All but the last return the columns of
``documents``. None of them needs the ids to be unique or any column to be filled: rows
that repeat an id are judged alike or each for itself, and null texts go with the first
stage, for they have no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.decontaminate import without_leaks
from shelfmark.llm.frames import stored, table
from shelfmark.llm.language import fit_languages, with_known_language
from shelfmark.llm.near_dups import near_duplicates
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.repeats import remove_repeats

#: No stage can be said in SQL as a whole; tests compare each with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those without a letter, and those too short for an n-gram (a letter or two), go."""
    return with_known_language(docs, fit_languages(docs))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id.

    Rows without an id are in no class and stay; rows that repeat an id share its fate.
    """
    gone = near_duplicates(docs, percent=80).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == F.col("_gone"), "left_anti")


def _without_broken_characters(text: Column) -> Column:
    """Text without the parts of cut characters; replacement characters of its own stay.

    Those are written as a noncharacter and a letter meanwhile, as is the noncharacter.
    """
    mark, broken = "\ufdd0", "\ufffd"
    own = F.replace(F.replace(text, F.lit(mark), F.lit(mark + "a")), F.lit(broken), F.lit(mark + "b"))
    valid = F.translate(F.make_valid_utf8(own), broken, "")
    return F.replace(F.replace(valid, F.lit(mark + "b"), F.lit(broken)), F.lit(mark + "a"), F.lit(mark))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of 100 bytes; a document of which nothing is left goes.

    A character cut by a removed string goes as a whole.
    """
    found = remove_repeats(docs, window=100, carry=True)
    whole = F.col("kept").cast("string")
    cut = _without_broken_characters(whole)
    found = found.withColumn("_text", F.when(F.col("n_removed") > 0, cut).otherwise(whole))
    found = found.filter((F.col("n_removed") == 0) | (F.col("_text") != ""))
    length = F.when(F.col("n_removed") > 0, F.length("_text").cast("bigint")).otherwise(F.col("rest.n_chars"))
    made = {"text": F.col("_text"), "n_chars": length}
    return found.select(*[made[c].alias(c) if c in made else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, neither exact nor edited."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their token ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_dups", near_dups),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
