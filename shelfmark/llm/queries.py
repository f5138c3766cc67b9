"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import oracles
from shelfmark.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracles.ORACLE)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def remainder(n: int):
    """The split of a document: crc32 of its id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out third."""
    from shelfmark.llm.language import fit_languages, identify

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(remainder(3) != 1))
    found = identify(docs, model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    from shelfmark.llm.url_filter import filter_urls

    found = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces, packed into sequences of 1024 tokens."""
    import public_tokenizers

    from shelfmark.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to a content-addressed archive and read the records back."""
    from shelfmark.llm.warc import parse_records, read_archive, write_archive
    from shelfmark.runtime import work_path

    path = work_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return parse_records(read_archive(spark, path)).drop("url")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out quarter."""
    from shelfmark.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(remainder(4) != 2)
    found = score_quality(docs, fit_quality(docs, labels))
    return found.select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte of a 100-byte string that also starts earlier."""
    from shelfmark.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), window=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every word of a 13-word window that also starts in a document with a smaller id."""
    from shelfmark.llm.phrases import remove_phrases

    found = remove_phrases(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a Jaccard similarity of 85 percent."""
    from shelfmark.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal label linked at a cosine of 0.98 or more."""
    from shelfmark.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, exact or edited, with the item and the alignment's score."""
    from shelfmark.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn by their likeness to the benchmark texts."""
    from shelfmark.llm.resample import resample

    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest lexical score for every benchmark item."""
    from shelfmark.llm.lexical import lexical_search

    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


@query
def op13_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in as few sequences of 2048 tokens as the configuration program finds."""
    import public_tokenizers

    from shelfmark.llm.bestfit import pack_best_fit

    pieces = pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), room=2048)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
