"""Cache tables of model results: keys, misses and merging. A row that cannot be read is a miss."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def cache_key(model: str, dimensions: int, text: Column) -> Column:
    """SHA-256 of model, dimensions and text, set apart by zero bytes."""
    return F.sha2(F.concat_ws("\0", F.lit(model), F.lit(str(dimensions)), text), 256)


def _ordered(value):
    return {k: _ordered(value[k]) for k in sorted(value)} if isinstance(value, dict) else [_ordered(v) for v in value] if isinstance(value, list) else value


def reply_key(url: str, body: dict) -> str:
    """SHA-256 of a request, its address and body, with the fields at every depth in the order of their names."""
    text = json.dumps(_ordered({"url": url, "body": body}), ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def reply_keys(requests: DataFrame, url_col: str, body_col: str) -> DataFrame:
    """requests with the key of each, its body being JSON text; a body that cannot be read has a null key."""

    def one(url: str | None, body: str | None) -> str | None:
        try:
            return None if url is None or body is None else reply_key(url, json.loads(body))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [one(u, b) for u, b in zip(batch.column(url_col).to_pylist(), batch.column(body_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], names=[*batch.schema.names, "key"])

    return requests.mapInArrow(run, StructType([*requests.schema.fields, StructField("key", StringType())]))


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The wanted rows (key, ...), each key once, that the cache (key, value) has no readable value for."""
    readable = cache.where("value IS NOT NULL").select("key").distinct()
    return wanted.dropDuplicates(["key"]).join(readable, "key", "left_anti")


def parsed_vectors(cache: DataFrame) -> DataFrame:
    """(key, value array<float>) of JSON rows (key, json); a broken row has a null value and so is a miss."""
    return cache.select("key", F.from_json("json", "array<float>").alias("value"))


def hits_only(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The wanted rows with their cached value; a miss is an error, as in a run that must not call a model."""
    missing = misses(wanted, cache).limit(1).count()
    if missing:
        raise LookupError("the cache lacks a wanted value and calls are not allowed")
    return wanted.join(cache.where("value IS NOT NULL"), "key")
