"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepairs, chat, decontam, langid, merkle, packing, pieces, quality, secrets, sharding, simhash, suffix, urlfilter, whitening
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: A parameter: the place of the model file on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """langid.identified() of all documents: of two languages as likely the first by name; null or letterless texts are `und`."""
    return langid.identified(table(spark, sf_dir, "documents"))


@query
def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sharding.sharded() of all documents into 24 shards by the law `bytes`; repeated rows and null texts have slots of their own."""
    return sharding.sharded(stored(spark, sf_dir, "documents"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontam.found() of all documents and items: null and short texts match nothing; of windows as alike the greatest similarity counts."""
    return decontam.found(stored(spark, sf_dir, "documents"), stored(spark, sf_dir, "benchmark"))


ORACLES["op3_benchmark_decontamination"] = decontam.ORACLE


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality.judged() of all documents: null and blank texts have no words and fail the base; an empty table gives no rows."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urlfilter.judged() of all pages: null urls have an empty host and path; of rules that fit the longest counts."""
    return urlfilter.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLES["op5_url_filters"] = urlfilter.ORACLE


@query
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secrets.digest() of all documents' spans: null texts have none; spans that start together stand in the order of their kinds."""
    return secrets.digest(secrets.scanned(table(spark, sf_dir, "documents")))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat.collapsed() of all conversations: turns with one number go by role and text; repeated turns are one."""
    return chat.collapsed(table(spark, sf_dir, "conversations"))


ORACLES["op7_chat_formatting"] = chat.ORACLE


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pieces.encode() of all documents: of divisions as good the one with the longer last piece; null texts have no ids."""
    docs = table(spark, sf_dir, "documents")
    got = pieces.encode(docs, PIECE_MODEL)
    return got.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash.groups() of all documents: null texts and those without a word have the fingerprint 0, linked like any other."""
    return simhash.groups(table(spark, sf_dir, "documents")).select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suffix.deduplicated() of all documents: of equal doc_ids none costs the other anything; null texts are empty."""
    return suffix.deduplicated(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


#: Where 7 divides the unsigned crc32 of a row's decimal doc_id, the check of the manifest claims one more character than there is.
FORGED = 7


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merkle.manifest() of all documents, and what their proofs make of rows of which every seventh or so is forged; nulls stay as they are."""
    docs = stored(spark, sf_dir, "documents")
    forged = F.when(F.crc32(F.col("doc_id").cast("string")) % FORGED == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    columns = [forged if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    return merkle.tampered(merkle.manifest(docs, {"claimed": merkle.leaf(columns)}), "claimed")


ORACLES["op11_merkle_manifest"] = merkle.ORACLE


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitening.components() of all embeddings: broken vectors are left out; a component without variance is 0."""
    return whitening.components(stored(spark, sf_dir, "embeddings"))


def byte_model() -> str:
    """A parameter: the place of the tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packing.packed() of the pieces of all documents: null texts are one token; repeated rows are packed like others."""
    pieces_ = bytepairs.pieces(table(spark, sf_dir, "documents"), byte_model())
    return packing.packed(pieces_.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
