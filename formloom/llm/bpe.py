"""Byte-level BPE encoding and decoding (operator 1).

The tiktoken library with a local rank file does the merges. Long texts are cut
at places that no match of the splitting pattern can span, so that memory and
time per call stay bounded and the ids are those of the whole text. Decoding
returns raw bytes: a run of ids may end within a character.

Defined results: a null text has no ids and decodes to no bytes; repeated rows are kept;
every column of the table stays, and an output column that exists already is an error.
Bytes that are not UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.arrow import fresh, per_row
from formloom.llm.tokens import rank_encoder, text_of
from formloom.session import load

RANKS = "byte_bpe_multi_50k.tiktoken"


def bpe_encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids``: the text's ids, packed as little-endian unsigned 32-bit integers.

    ``decoded`` names a column for the bytes decoded from these ids, in the same pass.
    ``keep`` lists the columns to keep, so that a text need not come back from Python.
    """
    fresh(df, ids, *([decoded] if decoded else []))
    out = T.StructType([T.StructField(x, T.BinaryType()) for x in (ids, decoded) if x])

    def make():
        encoder = rank_encoder(ranks, pattern)

        def one(value):
            packed = encoder.encode(text_of(value))
            return (packed, encoder.decode(packed)) if decoded else (packed,)

        return one

    return per_row(df, text, out, make, lambda row: sum(map(len, row)), keep)


def bpe_decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the raw bytes of packed ``ids``; null ids give no bytes."""
    fresh(df, decoded)

    def make():
        encoder = rank_encoder(ranks, pattern)
        return lambda value: (encoder.decode(value or b""),)

    return per_row(df, ids, T.StructType([T.StructField(decoded, T.BinaryType())]), make, lambda row: len(row[0]))


def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and the digests of its ids and of the bytes decoded from them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded="decoded", keep=["doc_id"])
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
