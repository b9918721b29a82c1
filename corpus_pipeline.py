"""A training corpus from documents: judged, deduplicated three ways, packed. Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import release, row_key, table, written
from keyloom.llm.exact_dedup import drop_exact_duplicates
from keyloom.llm.minhash import near_duplicates
from keyloom.llm.packing import pack
from keyloom.llm.quality_classifier import fit, score
from keyloom.llm.registry import _vocabulary
from keyloom.llm.substring_dedup import remove_repeated_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts. It is fitted on ``labels`` of the stage's own input. Null and empty texts
    are judged like others, repeated rows alike; without labels of both classes all stay."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), model, carry=True).where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; null and empty texts are one group, null ids stay
    only in groups without others, and of rows that repeat an id and a text one stays."""
    return drop_exact_duplicates(docs.select(*COLUMNS), keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that with the smallest id, and of rows that repeat an id the one with
    the smallest hash of its text. A null id goes before all others. Empty and null texts are near to nothing and stay."""
    row = F.struct("doc_id", F.xxhash64("text").alias("of"))
    kept = near_duplicates(docs.select(row.alias("row"), "text"), id_col="row").where("kept").select(F.col("row").alias("_row")).distinct()
    return docs.select(*COLUMNS).withColumn("_mine", row).join(kept, F.col("_mine").eqNullSafe(F.col("_row")), "left_semi").drop("_mine")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that are repeated; a text that had none is unchanged, the others have their words joined by
    one space. ``n_chars`` is counted anew; documents of which nothing is left stay, with an empty text."""
    keyed = docs.select("doc_id", "text", F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"}).alias("of"))
    cut = remove_repeated_passages(keyed, id_col="of", text_col="text", layout=True)
    of = F.from_json("of", "doc_id long, lang string, source string")
    return cut.select(of.alias("of"), "text").select("of.doc_id", "text", "of.lang", "of.source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths; a null or empty text is one piece, its end token. Repeated rows are packed each."""
    return pack(docs, _vocabulary()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packing", packed)]

#: A classifier fitted by gradient steps, components and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)  # what the stage before wrote; nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
