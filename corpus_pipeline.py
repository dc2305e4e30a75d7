"""A cleaned, mixed and packed corpus from documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import lines, mixing, near_copies, packing, tokens, toxicity
from strandloom.llm.common import materialize


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null texts count as empty; texts of any length are scored whole; equal texts
    and repeated rows fare alike, and rows without an id are scored too. Other
    columns are kept, whatever their names. An empty table stays empty.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur on many sites, by their length, go, but at their first place; n_chars follows the text.

    A null text stays null; a null source is no site; ties for the first place
    go to the smaller id and position; rows with equal id and text fare alike.
    Texts of any length are read whole. Other columns are kept, whatever their
    names. An empty table stays empty.
    """
    cleaned = lines.without_boilerplate(docs, counts=False)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: five-word shingles, a similarity of 0.8 or more.

    Null texts and those without words are one class. Of rows that repeat id
    and text one stays; rows without an id stay; rows that share an id but not
    a text are documents of their own. Ties go to the smaller id. A text of any
    length is fingerprinted whole; other columns are kept, whatever their names;
    an empty table stays empty.
    """
    return near_copies.one_per_class(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows with null or repeated ids are documents of their own; null texts and
    those without words go; a null source is one, the last. Documents of one
    size are taken in the order of a hash, equal ones in any. Texts of any
    length count whole. Other columns are kept, whatever their names. An empty
    table stays empty.
    """
    # ids can be null or repeated: a stored key tells rows apart; the row in one column, so that no name clashes
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), "mixing-rows")
    taken = mixing.mix(keyed.select("key", "row.doc_id", "row.text", "row.source"), carry=("key",)).filter("copies > 0")
    met = keyed.join(taken.select(F.col("key").alias("taken"), "copies"), F.col("key") == F.col("taken"))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens.

    A null text has the end id alone. Every row is packed, however long and
    whether it repeats another or not; ties in length are broken by id and
    text. Other columns are not looked at. An empty table has no pieces.
    """
    return packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_filter), ("line_dedup", line_dedup), ("simhash_dedup", near_dedup), ("source_mixing", source_mixing), ("packing", sequence_packing)]

#: Classifier, fingerprints and tokenizer are not expressible in SQL; tests hold a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
