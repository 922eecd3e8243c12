"""A corpus pipeline in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the last returns the
packed pieces, the others the columns of documents. Columns beyond these pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import langid, mixing, pii
from skein.llm.common import Tables, checkpointed, documents, id_crc32, tune
from skein.llm.neardup import near_duplicates
from skein.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from four fifths of the labelled documents; a text without a language (null, empty, no letter) goes, and lang becomes the prediction."""
    tune(spark)
    model = langid.train(docs, id_crc32("doc_id") % 5 != 0)
    out = langid.identify(docs, model)
    return out.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """On five-word shingles at 0.8, the document with the least id of each component stays, once; a text without words stays.

    Rows are told apart by id and text (two hashes of it), as rows of one id, or of none, may lie in several components.
    """
    tune(spark)
    longest = max(docs.columns, key=len)
    names = (f"{longest}1", f"{longest}2")
    key = ("doc_id", *names)
    keyed = docs.withColumns({c: F.xxhash64(F.lit(i), "text") for i, c in enumerate(names)})
    found = near_duplicates(keyed.select("doc_id", "text", *names), shingle=5, threshold=0.8, carried=names).where("n_shingles > 0")
    texts = found.groupBy(*key, "group", "kept").agg(F.count("*").alias("copies"))
    # a component's kept rows are of one id; where their texts differ, one text stays
    stays = texts.where("kept").groupBy("group").agg(F.first("doc_id").alias("doc_id"), F.min(F.struct(*names, "copies")).alias("text"))
    stays = checkpointed(stays.select("doc_id", *(f"text.{c}" for c in names), "text.copies"))

    def joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(keys["doc_id"])
        for c in names:
            same &= rows[c] == keys[c]
        return rows.join(keys, same, how)

    gone = joined(texts.select(*key), stays, "left_anti")
    again = stays.where("copies > 1").select(*key)
    if again.isEmpty():
        return joined(keyed, gone, "left_anti").select(*docs.columns)
    once = joined(keyed, again, "left_semi").dropDuplicates(key)
    return joined(keyed, gone.unionByName(again), "left_anti").unionByName(once).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind; n_chars follows the text. Rows are independent: repeated ones and null ids stay, a null text stays null with null n_chars."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a row stays as often as it is drawn, none or twice at most. A null source is one of its own; a text without words has size 0 and stays once."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids' checksums. Rows are packed each for itself, also those of one id or none; a null or empty text is its end token."""
    tune(spark)
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: SQL can't express the classifier, the near duplicates or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written in the shared folder and read again, and dropped when the next one is written. The last table stays for the result."""
    tables, docs = Tables(spark), documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        before, docs = docs, tables.write(stage(spark, docs, sf_dir))
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
