"""Corpus pipeline over ``documents``: language ID, line dedup, near-duplicate join, decontamination, BPE round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import encode_documents
from gridloom.llm.common import Scratch, table
from gridloom.llm.decontaminate import contained_items
from gridloom.llm.jaccard_join import jaccard_components
from gridloom.llm.language_id import predict_languages
from gridloom.llm.line_dedup import drop_template_lines
from gridloom.llm.queries import word_bpe

#: A text goes when its language is undetermined or its surest machine is no better than a coin.
LEAST_SCORE = 0.5


#: Keys of rows without an id of their own start here; ids from here on count as such too.
OTHERS = 1 << 62
KEY = "_row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key column: the id, or past all ids a hash of id and text where the id is null or more than one row has it.

    So decisions reach the row they were made for. Rows equal in id and text share a key.
    """
    again = docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id", F.lit(True).alias("_again"))
    again = Scratch(docs.sparkSession, "pipeline-ids").keep(again, "again")
    own = F.coalesce(F.col("doc_id") < OTHERS, F.lit(False))
    hashed = F.lit(OTHERS) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit(OTHERS - 1))
    if again.isEmpty():
        return docs.withColumn(KEY, F.when(own, F.col("doc_id").cast("long")).otherwise(hashed))
    return docs.join(again, "doc_id", "left").select(*docs.columns, F.when(own & F.col("_again").isNull(), F.col("doc_id").cast("long")).otherwise(hashed).alias(KEY))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (null text, no letter) or unsure go; all columns stay as they are."""
    told = predict_languages(docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("_row")))
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text. A document left without any text (or with a null one) goes too."""
    out = drop_template_lines(docs).filter(F.length(F.trim("text")) > 0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays.

    Documents with a null or repeated id are compared by their own texts, come after all others in a group, and one of rows
    equal in id and text stays. Null and wordless texts link with nothing and stay.
    """
    rows = keyed(docs)
    groups = jaccard_components(rows, id_col=KEY)
    first = Scratch(spark, "pipeline-groups").keep(groups.filter(F.col(KEY) == F.col("component_id")).select(KEY).distinct(), "first")
    kept = rows.join(first, KEY, "left_semi")
    return kept.filter(F.col(KEY) < OTHERS).union(kept.filter(F.col(KEY) >= OTHERS).dropDuplicates([KEY])).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, each by its own text whatever its id."""
    rows = keyed(docs)
    hits = contained_items(rows, table(spark, sf_dir, "benchmark"), id_col=KEY).select(KEY).distinct()
    return rows.join(hits, KEY, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; null texts count as empty."""
    return encode_documents(docs, word_bpe(), digests=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Language ID and BPE are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
