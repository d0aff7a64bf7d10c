"""From raw documents to packed training sequences, stage by stage.

Each stage reads the whole table that the one before has written.  All take any
table with the columns of ``documents`` and drop further columns, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from edgetables.llm import langid, minhash, packing, pii
from edgetables.llm.common import Folder

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, with it; those without text or without a letter go.

    Languages are learned from the rows with a language and a text that are not
    held out.  Null, empty and letterless texts go; if nothing can be learned, all
    do.  Null languages are filled in, null ids stay.  Equal texts get one language,
    repeated rows stay as many; a tie goes to the language first in the alphabet.
    """
    model = langid.train(docs.filter(~langid.held_out()))
    guessed = langid.predict(docs.select(*DOCUMENTS), model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return guessed.withColumn("lang", F.col("lang_pred")).select(*DOCUMENTS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Texts without a word are near nothing and stay, so do rows without an id.
    Rows that repeat the smallest id of their group stay as many.
    """
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id"))
    return docs.select(*DOCUMENTS).join(kept.withColumnRenamed("doc_id", "kept_id"), same, "left_semi")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets.

    A null text becomes an empty one, ``n_chars`` is counted anew, null ids and
    repeated rows stay; spans that overlap are replaced as one, named by the first.
    """
    redacted = pii.redact(pii.find(docs.select(*DOCUMENTS)))
    return redacted.withColumn("n_chars", F.length("text").cast("bigint")).select(*DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, sequence and place in it.

    A null or empty text is its end id alone; repeated rows and null ids are
    documents of their own; a very long text spans sequences.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Language models, context patterns and tokenizers are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    folder = Folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = folder.store(stage(spark, docs, sf_dir), name)
    return docs
