"""A corpus pipeline of four stages: language ID, line dedup, MinHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweir.llm import langid, linededup, minhash, packing
from rasterweir.llm.queries import vocabulary
from rasterweir.llm.shared import written

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; model and limits are fitted on labelled documents of the input.

    All labelled texts count: two thirds, by a hash, teach the model, the others the limits: what evidence and variety texts of a learnt
    language of such a length have. Texts without letters go (null and empty ones too), and so do other languages of the
    same script, source code, encoded data and mere repetitions. Short texts have to be farther off than long ones. Without
    labels there is nothing to reject by: every text with a letter stays. Repeated rows are judged alike; an empty table
    stays empty; columns of any name pass through.
    """
    taught = F.pmod(F.xxhash64(F.lit("taught"), "text"), F.lit(3)) != 1
    model = langid.fit(docs.where(taught), max_train=None)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.reject(docs, model, langid.calibrate(docs.where(~taught), model))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are boilerplate of their source; n_chars, if there is one, follows the text. All documents stay.

    Copies are still there, so each text counts once per source; otherwise a large group of copies would lose all its text.
    Null texts stay null, a null source is the empty one, repeated rows are cleaned alike, very long texts are read whole, an
    empty table stays empty, and other columns pass through.
    """
    cleaned = linededup.drop_boilerplate(docs, distinct=True, fellows=True, least_pages=2)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id.

    Documents without words (null and empty texts) are classes of their own and stay, and so do rows with a null id; rows
    that repeat an id are one document. Very long texts are compared whole. An empty table stays empty; columns pass through.
    """
    return minhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequence and offset.

    Null and empty texts are a separator alone; repeated rows are packed each by itself; very long texts are cut into full
    pieces; other columns are ignored; an empty table gives no rows.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near", near), ("packed", packed)]

#: Naive Bayes, BagMinHash and tokenising have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
