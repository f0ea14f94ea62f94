"""Transports over HTTP for `models.embed` and `models.complete`, and the endpoints they call.

A transport holds plain values only, so it travels to the tasks; each call opens its own connection.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, field

from weftlake.sources.models import TransientError

#: What stands in a configuration where the key is still to be filled in.
PLACEHOLDERS = {"", "changeme", "your-api-key", "xxx"}
TRANSIENT = {429, 503}


@dataclass(frozen=True)
class Endpoint:
    """Where a model is served; `extra` is merged into every request last, so it may override."""

    name: str
    url: str
    model: str
    key: str = ""
    local: bool = False
    timeout_s: float = 60.0
    extra: Mapping[str, object] = field(default_factory=dict)

    @property
    def available(self) -> bool:
        """Whether it can be called: it has a model, and a key unless it is local."""
        return bool(self.model) and (self.local or self.key.strip().lower() not in PLACEHOLDERS)

    def body(self, **fields: object) -> dict:
        return {"model": self.model, **fields, **self.extra}


def endpoint_of(name: str, known: Mapping[str, Mapping[str, object]], env: Mapping[str, str] | None = None) -> Endpoint:
    """The endpoint of a name; its key comes from the first of `key_variables` that is set. An unknown name is an error."""
    if name not in known:
        raise LookupError(f"unknown endpoint {name!r}, known are {sorted(known)}")
    env = os.environ if env is None else env
    found = dict(known[name])
    key = next((env[v] for v in found.pop("key_variables", []) if env.get(v)), "")
    return Endpoint(name=name, key=key, **found)


def post(endpoint: Endpoint, body: dict) -> dict:
    """One request; a busy service is a transient error, with the seconds it asks to wait if it names them."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {endpoint.key}"} if endpoint.key else {})
    request = urllib.request.Request(endpoint.url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=endpoint.timeout_s) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        if e.code in TRANSIENT:
            named = (e.headers.get("Retry-After") or "").strip()
            raise TransientError(f"status {e.code}", float(named) if named.replace(".", "", 1).isdigit() else None) from e
        raise


@dataclass(frozen=True)
class Embeddings:
    """Vectors of a batch of texts, in the order of the texts, whatever the order of the reply; 0 dimensions asks for none."""

    endpoint: Endpoint
    dimensions: int = 0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        size = {"dimensions": self.dimensions} if self.dimensions else {}
        rows = post(self.endpoint, self.endpoint.body(input=texts, **size))["data"]
        return [row["embedding"] for row in sorted(rows, key=lambda row: row["index"])]


@dataclass(frozen=True)
class Chat:
    """The reply to a system and a user text, with the token counts that the service gives."""

    endpoint: Endpoint
    temperature: float = 0.0

    def __call__(self, system: str, user: str) -> dict:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        reply = post(self.endpoint, self.endpoint.body(messages=messages, temperature=self.temperature))
        usage = reply.get("usage") or {}
        return {"text": reply["choices"][0]["message"]["content"], **{k: usage.get(k) for k in ("completion_tokens", "prompt_tokens")}}
