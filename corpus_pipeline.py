"""Corpus cleaning pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of their input with their decisions applied.

Defined cases: null texts go in the first stage; rows with a null id are judged on their text (language, lines, benchmark) and are never
near-duplicates of others; rows that repeat an id and text stay or go together; further columns pass through; an empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontaminate, language_id, line_dedup, packing, simhash_dedup
from quarrykit.session import scratch, table

#: Name of the stages' own column, which no table has.
OWN = "__corpus_pipeline"
#: Least score of a text whose language is known, and the length (in characters) from which a score says enough. Clean texts of this
#: length score above 0.48 on the test tables, so the floor leaves room.
CLAIMED, ENOUGH = 0.4, 200


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that the model knows: null texts, texts without a letter and texts that no language's regressor
    claims (``ENOUGH`` characters or more with a score below ``CLAIMED``) are rejected. Where fewer than two languages could be learned, a letter is enough."""
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, into=OWN)
    if len(model.languages) < 2:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    claimed = (F.length("text") < ENOUGH) | (F.col(f"{OWN}.score") >= CLAIMED)
    return found.where((F.col(f"{OWN}.predicted") != language_id.UNDETERMINED) & claimed).select(*docs.columns)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the multi-line chunks that stand earlier in the corpus; ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs, into=OWN)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (shingles of five words, Jaccard similarity of 0.8 or more)."""
    return simhash_dedup.dedup(docs, k=5, least=simhash_dedup.LEAST)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), into=OWN)
    return found.where(F.size(OWN) == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 ids, placed in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", unrepeated_lines),
    ("simhash_dedup", near_unique),
    ("decontaminate", uncontaminated),
    ("packing", packed),
]

#: No SQL for models, SimHash, retrieval and tokenizers; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the table is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
