"""A corpus, from raw documents to packed training sequences: STAGES in order, each on what its predecessor kept.

Every stage takes an empty table to an empty one, keeps extra columns as they are (but the last, which returns pieces), and treats
equal rows alike: all of them stay or go, but for near-duplicates, of which one row stays. What null and empty texts, null and
repeated ids and ties give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import decontaminate, langid, packing, simhash, toxicity
from tidegauge.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled rows of docs outside the held-out part, as op10 does; rows predicted toxic (a score of 0.5 or more) go.

    Null and empty texts have no match and stay. Rows without an id are judged but teach nothing; of several rows of one id
    each is judged by its own text, and each text teaches under the id's label.
    """
    lexicon = toxicity.train(docs.where(~toxicity.held_out()), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, lexicon)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is unknown, or that no language takes a quarter of, go; a quarter itself stays.

    Null and empty texts, and those without a letter, have no language and go. Ids are looked at only to leave the held-out
    part, and rows without an id, out of training; without any lang to learn from, all rows go.
    """
    return langid.keep_languages(docs, langid.train(docs.where(~langid.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints stays: that with the smallest doc_id, and of several such rows that with
    the smallest digest.

    Texts without words have fingerprint zero and are linked like others. Rows without an id stay only if none of their
    component has one; rows of one id with different texts are judged apart.
    """
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a twentieth or more of their words under windows of benchmark items go; a twentieth itself goes.

    Null texts, and those without words, have no hit and stay. Ids are not looked at; without benchmark items all rows stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 tokens, as op6 gives them. A null or empty text is its end token; a null id stays
    null, and each of several equal rows is packed; other columns are left out."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Fingerprints, learned models and packing are beyond SQL; a test holds each stage's rows, and those of run(), against a plain version
#: on sf0.001 (the two models are trained by the package there, and languages are predicted by its Model one text at a time).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each leaves is a written table, read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
