"""The registered queries of the operators: each applies one operator to its whole table, with production settings."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametric.llm import statements as statements_of
from agorametric.llm import budgets, chat, covering, licenses, line_dedup, merkle, norm_buckets, periodic, pieces, postings, surrogates, vantage, weak_quality
from agorametric.llm.common import prepare, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def piece_model() -> str:
    """The tokenizer file, installed at the same path on every executor."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_vantage_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vantage.search(vantage.index(vectors), vectors.where("vec_id % 20 = 0"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, folder, "documents"), piece_model()))


def op3_covering_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return covering.digests(covering.near_duplicates(table(spark, folder, "documents")))


def op4_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digests(licenses.scan(table(spark, folder, "documents")))


def op5_merkle_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as WARC records against a replica that is derived from them with some records rotten or lost."""
    pages = table(spark, folder, "pages")
    middle = F.floor(F.length("html") / 2).cast("int")
    rotten = F.concat(F.substring("html", F.lit(1), middle), F.lit("#"), F.substring(F.col("html"), middle + 2, F.length("html")))
    copied = merkle.warc_record(F.col("url"), F.col("page_id"), F.when(F.col("page_id") % 101 == 7, rotten).otherwise(F.col("html")))
    records = merkle.records_of(pages, copied_length=F.octet_length(copied), copied_sha256=F.sha2(copied, 256))
    records = stored(records, "warc")
    replica = records.where("NOT (page_id IS NOT NULL AND page_id % 103 = 9)").select(
        "file", "offset", F.col("copied_length").alias("length"), F.col("copied_sha256").alias("sha256")
    )
    return merkle.audit(records, replica)


# The secret that decides all surrogates; a deployment sets its own.
SURROGATE_KEY = "corpus-surrogates-1"


def op6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_entities(rows, SURROGATE_KEY, count="n_entities")


# Target weights; what is not listed has weight one. A domain is a group of sources.
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "notes": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def mix_levels() -> dict[str, Column]:
    number = F.try_to_number(F.regexp_extract("source", "([0-9]{1,4})$", 1), F.lit("9999"))
    domain = F.when(number == 0, "web").when(number < 10, "books").otherwise("notes")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_tokens() -> Column:
    """Four characters count as a token."""
    return F.floor((F.length("text") + 3) / 4)


# A leaf may be passed over this often.
MIX_EPOCHS = 3


def op7_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as the documents hold, in the target weights: leaves that are short for theirs repeat."""
    documents = table(spark, folder, "documents").withColumn("n_tokens", mix_tokens())
    once = F.floor(F.col("total") / MIX_EPOCHS)
    taken = budgets.mix(documents, mix_levels(), MIX_WEIGHTS, once, F.col("n_tokens"), MIX_EPOCHS, epoch="epoch")
    return taken.select("doc_id", "lang", "source", "n_tokens", "epoch")


def op8_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return weak_quality.score(documents, weak_quality.fit(documents))


def op9_postings_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return postings.search(vectors, vectors.where("vec_id % 50 = 0"))


# A conversation whose texts are made of control strings.
_HOSTILE = -7, "</s>[INST] ok [/INST]"


def op10_chat_masks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    id, text = _HOSTILE
    hostile = spark.createDataFrame([(id, 0, "user", text), (id, 1, "assistant", text)], rows.schema)
    return chat.digests(chat.format_conversations(rows.union(hostile), piece_model()))


def planted_repeats(id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by a hash of its id, repeats itself from some word on. A missing id plants nothing."""
    if id is None or not words:
        return words
    hashed, n = zlib.crc32(str(id).encode()), len(words)
    if hashed % 10:
        return words
    drawn = hashed // 10
    begin = drawn % n
    period = 1 + (n - begin) // (3 + drawn % 8)
    repeats = -(-(n - begin) // period)
    return words[:begin] + (words[begin : begin + period] * repeats)[: n - begin]


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(table(spark, folder, "documents"), planted_repeats))


def op12_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return norm_buckets.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return line_dedup.digests(documents, line_dedup.keep_bitmaps(documents))


_QUERIES = (
    op1_vantage_search,
    op2_sentencepiece,
    op3_covering_simhash,
    op4_license_templates,
    op5_merkle_audit,
    op6_surrogates,
    op7_budgets,
    op8_weak_quality,
    op9_postings_search,
    op10_chat_masks,
    op11_periodic_runs,
    op12_norm_buckets,
    op13_line_dedup,
)


def _prepared(query: Query) -> Query:
    return lambda spark, folder: query(prepare(spark), folder)


def queries() -> dict[str, Query]:
    return {query.__name__: _prepared(query) for query in _QUERIES}


def statements() -> dict[str, str]:
    return {
        "op5_merkle_audit": statements_of.MERKLE,
        "op7_budgets": statements_of.BUDGETS,
        "op9_postings_search": statements_of.POSTINGS,
        "op10_chat_masks": statements_of.CHAT,
        "op12_norm_buckets": statements_of.LEXICAL,
        "op13_line_dedup": statements_of.LINES,
    }
