"""The operators as queries over whole tables, with production parameters, and SQL where SQL can
express them."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_bytes

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import eliasfano, langid, mixing, oracles, packing, piecewise, preferences, repetition, secrets, simhash, surrogates, tokens
from .common import documents


def tokenizer() -> str:
    return tokens.read_spec(public_tokenizers.path("byte_bpe_50k.json"))


#: The session's setting for the surrogates' key (redacted where Spark shows settings).
KEY_SETTING = "spark.foldlake.surrogate.secret"
_OWN_KEY = token_bytes(32)


def surrogate_key(spark: SparkSession) -> bytes:
    """The key that the session sets; without one a random key that ends with this process, so that
    nobody can undo its surrogates, and no other run repeats them."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _OWN_KEY


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the cell of each document, its words, weight and probability, and whether it is drawn."""
    rows = mixing.weighted(documents(spark, sf_dir), keep=["doc_id"])
    return rows.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_words").alias("n_words"),
        F.round("mix_weight", 9).alias("weight"), F.round("mix_probability", 9).alias("probability"), F.col("mix_sampled").alias("sampled"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(documents(spark, sf_dir))
    return found.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.pairs(preferences.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.entities(documents(spark, sf_dir), surrogate_key(spark))


def op9_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.neighbours(documents(spark, sf_dir))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return eliasfano.read(eliasfano.write(docs, tokenizer()), docs.schema["doc_id"].dataType.simpleString())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_mixing, op2_packing, op3_quality, op4_secrets, op5_language, op6_simhash, op7_preferences, op8_surrogates, op9_piecewise, op10_tokens]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
