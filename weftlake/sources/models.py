"""Calls of models from tasks: embeddings and chat replies through an injected transport, with cache, batches and retries.

A transport is a picklable function of a list of texts (or of a request) that returns as many vectors (or a reply); tests
inject a fake. Only what the cache lacks is called, each text once; order does not matter, as results are keyed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from weftlake.sources.cache import misses

BATCH = 32


class TransientError(RuntimeError):
    """A call that may succeed later, with the seconds to wait if the service named them."""

    def __init__(self, message: str, wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


@dataclass(frozen=True)
class Policy:
    """How models are called: by how many tasks at most, the least seconds between any two calls, attempts and waits.

    Each task waits `workers` times the interval between its calls, so that all of them together keep it.
    """

    workers: int = 1
    interval: float = 1.5
    attempts: int = 4
    base_wait: float = 10.0
    longest_wait: float = 60.0


def with_retry(call: Callable, policy: Policy, sleep: Callable[[float], None] = time.sleep):
    """call(), again after a transient error: after the wait it names, else after doubling waits."""
    for attempt in range(1, policy.attempts + 1):
        try:
            return call()
        except TransientError as e:
            if attempt == policy.attempts:
                raise
            sleep(e.wait if e.wait is not None else min(policy.longest_wait, policy.base_wait * 2 ** (attempt - 1)))


def embed(wanted: DataFrame, cache: DataFrame, transport: Callable[[list[str]], list[list[float]]], policy: Policy | None = None) -> DataFrame:
    """(key, value, error) for the wanted texts (key, text) that the cache (key, value) lacks.

    A batch that fails for good has null values and its error, so a run can count failures and refuse to measure without
    its vectors. A transport that returns another number of vectors, or some of another size, is such a failure.
    """
    policy = policy or Policy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for frame in batches:
            for low in range(0, len(frame), BATCH):
                part = frame.iloc[low : low + BATCH]
                time.sleep(max(0.0, last + policy.workers * policy.interval - time.monotonic()) if last else 0.0)
                last = time.monotonic()
                try:
                    vectors = with_retry(lambda part=part: transport(part["text"].tolist()), policy)
                    if len(vectors) != len(part) or len({len(v) for v in vectors}) > 1:
                        raise ValueError(f"{len(part)} texts, but {len(vectors)} vectors of sizes {sorted({len(v) for v in vectors})}")
                    yield pd.DataFrame({"key": part["key"], "value": [[float(x) for x in v] for v in vectors], "error": None})
                except Exception as e:  # noqa: BLE001 - reported with the rows
                    yield pd.DataFrame({"key": part["key"], "value": None, "error": f"{type(e).__name__}: {e}"})

    return misses(wanted.select("key", "text"), cache).repartition(policy.workers).mapInPandas(run, "key string, value array<float>, error string")


def failures(embedded: DataFrame) -> int:
    """How many texts have no vector: what a run that measures the semantic branch must find to be none."""
    return embedded.where("value IS NULL").count()


def complete(requests: DataFrame, transport: Callable[[str, str], dict], policy: Policy | None = None) -> DataFrame:
    """(key, text, latency_ms, completion_tokens, prompt_tokens, error) for requests (key, system, user).

    A blank reply is an error; token counts are null if the service gives none, never guessed.
    """
    policy = policy or Policy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                time.sleep(max(0.0, last + policy.workers * policy.interval - time.monotonic()) if last else 0.0)
                last = began = time.monotonic()
                try:
                    reply = with_retry(lambda r=r: transport(r.system, r.user), policy)
                    text = (reply.get("text") or "").strip()
                    out.append((r.key, text or None, (time.monotonic() - began) * 1000, reply.get("completion_tokens"), reply.get("prompt_tokens"), None if text else "blank reply"))
                except Exception as e:  # noqa: BLE001 - reported with the row
                    out.append((r.key, None, (time.monotonic() - began) * 1000, None, None, f"{type(e).__name__}: {e}"))
            frame_out = pd.DataFrame(out, columns=["key", "text", "latency_ms", "completion_tokens", "prompt_tokens", "error"])
            yield frame_out.astype({"completion_tokens": "Int64", "prompt_tokens": "Int64"})

    return requests.select("key", "system", "user").repartition(policy.workers).mapInPandas(run, "key string, text string, latency_ms double, completion_tokens long, prompt_tokens long, error string")
