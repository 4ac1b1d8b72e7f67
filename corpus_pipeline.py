"""Corpus pipeline over documents: each stage calls one operator of tokenlake.llm.

A stage takes all rows its predecessor kept, written as Parquet and read again,
and its decisions take effect. All but the last return the columns of documents;
the last returns a row for each repetition in the mix, with ``repetition``
and ``words``.

Edge cases: an empty table passes all stages empty; a null text or source, a
null or repeated id and repeated rows pass as rows like others (copies, but
for texts without words, are near-duplicates of each other); documents without
words are in no mix; other columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import decontaminate, minhash, mixing, pii, toxicity
from tokenlake.llm.common import Scratch, opening, table


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, _others(docs), text=True)
    return scored.where(F.col("out.score") < 0.5).select("row.*", "text").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.one_of_each(docs, Scratch(spark, "near-duplicates")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), _others(docs), text=True)
    return judged.where(~decontaminate.contaminated(F.col("out"))).select("row.*", "text").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; a text's length is counted again."""
    done = pii.replace(docs, Scratch(spark, "pii"), pii.key_of(spark)).select("row.*", "text")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights; a row for each repetition of a document.

    Its ``repetition`` and ``words`` come after the columns of documents; where
    documents have such columns themselves, theirs stay and the new ones are called mix_repetition and mix_words.
    """
    mixed = mixing.repetitions(mixing.mix(docs, Scratch(spark, "mixing"), keep=_others(docs), text=True))
    own = [(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return mixed.select(*own, *[F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("repetition", "words")])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the trained model, nor the surrogates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again before the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with opening() as opened:
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = scratch.write(docs, name)
                for done in opened:
                    done.clear()
    return docs
