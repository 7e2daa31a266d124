"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import edit_embedding, language_id, media, minhash, mixing, ngram_join, packing, pii, search, secrets, sharding, twins, url_filters, whitening


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return pii.op3_personal_data(spark, sf_dir).drop("spans")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return secrets.op8_secret_scan(spark, sf_dir).drop("spans")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return media.op10_media_features(spark, sf_dir).drop("feature")


def embedding_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op11 that SQL can express."""
    return whitening.op11_whitening(spark, sf_dir).drop("whitened", "explained", "identity_error")


QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_language_id": language_id.op2_language_id,
    "op3_personal_data": pii.op3_personal_data,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_jump_sharding": sharding.op5_jump_sharding,
    "op6_edit_embedding": edit_embedding.op6_edit_embedding,
    "op7_mixing": mixing.op7_mixing,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_media_features": media.op10_media_features,
    "op11_whitening": whitening.op11_whitening,
    "op12_minhash": minhash.op12_minhash,
    "op13_search": search.op13_search,
    "personal_data_base": personal_data_base,
    "secret_base": secret_base,
    "media_payloads": media_payloads,
    "embedding_deviation": embedding_deviation,
}

SQL = {
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op5_jump_sharding": twins.JUMP_SHARDING,
    "op9_url_filters": url_filters.OP9_SQL,
    "op12_minhash": minhash.OP12_SQL,
    "op13_search": search.OP13_SQL,
    "personal_data_base": twins.PERSONAL_BASE,
    "secret_base": twins.SECRET_BASE,
    "media_payloads": twins.MEDIA_PAYLOADS,
    "embedding_deviation": whitening.DEVIATION_SQL,
}
