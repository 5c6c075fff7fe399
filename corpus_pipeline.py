"""The corpus pipeline: documents in, encoded documents out.

Each stage gets the rows that its predecessor kept. A stage that the quality of its input decides (the classifier, the
budgets) fits itself to that input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametric.llm import budgets, covering, pieces, surrogates, weak_quality
from agorametric.llm.common import prepare, stored, table
from agorametric.llm.queries import MIX_WEIGHTS, SURROGATE_KEY, mix_levels, mix_tokens, piece_model

# Of the tokens that the earlier stages keep, the mixture takes nine tenths at most.
MIX_SHARE = 0.9


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    prepare(spark)
    return weak_quality.keep_good(docs, weak_quality.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays."""
    prepare(spark)
    return covering.representatives(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates."""
    prepare(spark)
    return surrogates.replace_entities(docs, SURROGATE_KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights, each at most once."""
    prepare(spark)
    return budgets.mix(docs, mix_levels(), MIX_WEIGHTS, F.floor(F.col("total") * MIX_SHARE), mix_tokens())


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hash of the token ids, and hash of the decoded text, per document."""
    prepare(spark)
    return pieces.digests(pieces.encode(docs, piece_model()))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", one_of_each_group),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

# A fitted classifier, keyed surrogates and a piece model have no SQL form; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again by the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"stage-{at}")
    return docs
