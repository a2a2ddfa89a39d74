"""From documents to sampled piece ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one piece ids
in place of texts. Other columns pass all stages, whatever their names; an empty table passes them empty. No stage can be said in SQL as a whole, so ORACLE_SQL is None; tests hold the
stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bag_minhash, language_id, mixing, piece_sampling, repeats
from causeway.llm.common import documents, stored

#: Of the tokens that reach the mixing stage, the part it may take.
MIX_SHARE = 0.8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; the model learns from the labels of docs.

    Null and empty texts, and texts without a letter, have no language. Null labels teach nothing. Equal texts are
    judged alike, so repeated rows all stay or all go; a tie between languages falls to the first of the model.
    """
    model = language_id.fit(docs)
    judged = language_id.identify(docs, model)
    return judged.where(~F.col("rejected")).select(*docs.columns)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts of fewer words than a shingle are alike only if they are equal; null and empty texts are each other's
    copies. Of rows that share an id one stays, the one with the smallest hash; rows with null ids are told apart.
    """
    return bag_minhash.one_per_class(docs).select(*docs.columns)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that occur earlier; other texts stay as they are.

    Null and empty texts stay. A text may end up empty. Rows with equal ids count as one document, null ids come
    first; of equal windows the first by id and place stays.
    """
    kept = repeats.without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture by the weights of domains, languages and sources, without repetition.

    Null sources and languages are leaves of their own. Null and empty texts have no tokens and cost nothing.
    Rows of equal id and text are taken or left together.
    """
    chosen = mixing.mix(docs, mixing.by_domain(), mixing.DOMAINS | mixing.LANGS, share=MIX_SHARE, max_epochs=1, seed=7)
    return chosen.select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """piece_ids, a sampled segmentation of each text, in place of the text.

    A null text has null piece ids, an empty one those of a lone space. Rows of equal id and text get equal
    segmentations, other rows with equal texts are drawn anew.
    """
    return piece_sampling.encode(docs).drop("text")


STAGES = [
    ("language ID", known_language),
    ("near-duplicate removal", no_near_duplicates),
    ("repeat removal", no_repeats),
    ("mixing", mixed),
    ("piece ids", as_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
