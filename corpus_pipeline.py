"""A corpus pipeline: run() writes each stage's documents to the checkpoint folder and reads them again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonegrid.llm import bpe_chunks, line_dedup, mixing, quality, simhash
from zonegrid.llm.common import cut_lineage, table

#: Every document is used; sources are repeated twice at most, towards an entropy of 97 % of the largest one.
MIXTURE = mixing.Target(entropy=0.97, repeats=2.0)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; it learns from their own labels.

    Nulls in any column count as empty text, empty names and no stated length; equal documents have equal
    scores, so repeated rows stay or go together; a score at the threshold stays. Without labels all stay.
    Extra columns stay; an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def strip_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; one that has no other line is a copy as a whole and stays as it is.

    Near-duplicate removal then keeps one of its copies; emptied, all such documents would be one. Null
    texts stay null, empty ones empty; a null source is a source; repeated rows and null ids are cleaned
    like any other; no row goes, extra columns stay, an empty table stays empty.
    """
    return line_dedup.clean(docs, spare_copies=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id (nulls last), then of the least hash of its text.

    Null, empty and blank texts are one class; of rows equal in id and text one stays. Extra columns stay;
    an empty table stays empty.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture uses it; the order of its blocks is not kept.

    A null source is a source; null ids and repeated rows are documents of their own; null and empty texts
    are used with their source, unless it has no token at all. Extra columns stay; an empty table stays empty.
    """
    return mixing.mixed(docs, MIXTURE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents' encodings, one row for each use.

    Null and empty texts have no token; ids are carried, null or repeated; other columns go; an empty table
    stays empty.
    """
    return bpe_chunks.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", strip_boilerplate),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned classifiers and a tokenizer have no SQL.
ORACLE_SQL = None
