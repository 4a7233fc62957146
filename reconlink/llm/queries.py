"""The query of each operator on its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chaining, ctw, decontam, divergence, html_extract, lengths, licences, merkle, simhash, spotsigs, toxicity, trie
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE of every document and its decoding, as digests."""
    return bpe.digests(table(spark, folder, "documents"))


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals, shares and truncated totals of the documents for every length as a context limit."""
    return lengths.token_counts(table(spark, folder, "documents"))


@query
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components that links of at most four bits make."""
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A calibrated toxicity score for every document."""
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every place where a document holds a benchmark item within a tenth of edits."""
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_chaining(spark: SparkSession, folder: str) -> DataFrame:
    """Every fuzzy passage of a document that an earlier document holds."""
    return chaining.passages(table(spark, folder, "documents"))


@query
def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return spotsigs.edited_pairs(table(spark, folder, "documents"))


@query
def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of every document with a known licence sentence."""
    return licences.licences(table(spark, folder, "documents"))


ORACLES["op10_licences"] = licences.licence_sql()


@query
def op4_ctw(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under a unigram base and the context-tree model."""
    return ctw.scores(table(spark, folder, "documents"))


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and whether its histograms are those of its language."""
    return divergence.judged(table(spark, folder, "documents"))


ORACLES["op11_divergence"] = divergence.judged_sql()


@query
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The Merkle proof of every document, and whether the root still holds after some are tampered with."""
    return merkle.manifest(table(spark, folder, "documents"))


ORACLES["op12_manifest"] = merkle.manifest_sql()


@query
def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return trie.prefix_trie(table(spark, folder, "conversations"))


ORACLES["op13_trie"] = trie.trie_sql()
