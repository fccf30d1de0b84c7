"""ai_query: a model call for each row.

Prompts are ordinary Spark columns. Each task calls its endpoint from a pool of
threads, which shares the endpoint's concurrency with all tasks that can run at
once; a failed call becomes the cell's text and never fails the query. The
endpoints' formats are their publicly documented ones.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import ConfigError

#: url, headers, body and timeout in seconds to the decoded answer.
Transport = Callable[[str, dict, dict, float], dict]
PROVIDERS = ("openai", "anthropic", "gemini")


@dataclass(frozen=True)
class AiConfig:
    name: str
    provider: str
    uri: str
    key: str = ""
    model: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    concurrency: int = 10
    timeout: float = 60.0
    max_tokens: int = 1024
    temperature: float = 0.0

    @classmethod
    def from_entry(cls, entry: dict) -> AiConfig:
        provider = str(entry.get("provider", "openai")).lower()
        if provider not in PROVIDERS:
            raise ConfigError(f"{entry['name']}: unknown provider {provider!r}")
        known = {k: entry[k] for k in ("key", "model", "headers", "concurrency", "timeout", "max_tokens", "temperature") if k in entry}
        return cls(entry["name"], provider, entry["uri"], **known)


def http(url: str, headers: dict, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def ask(config: AiConfig, model: str, prompt: str, transport: Transport) -> str:
    """The model's answer to one prompt."""
    turn, base = {"role": "user", "content": prompt}, config.uri.rstrip("/")
    if config.provider == "openai":
        headers = {"authorization": f"Bearer {config.key}"} if config.key else {}
        body = {"model": model, "messages": [turn], "max_tokens": config.max_tokens, "temperature": config.temperature}
        got = transport(f"{base}/chat/completions", headers | config.headers, body, config.timeout)
        return str(got["choices"][0]["message"]["content"])
    if config.provider == "anthropic":
        headers = {"x-api-key": config.key, "anthropic-version": "2023-06-01"}
        body = {"model": model, "messages": [turn], "max_tokens": config.max_tokens, "temperature": config.temperature}
        got = transport(f"{base}/v1/messages", headers | config.headers, body, config.timeout)
        return "".join(x["text"] for x in got["content"] if x.get("type") == "text")
    body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": config.max_tokens, "temperature": config.temperature}}
    got = transport(f"{base}/models/{model}:generateContent", {"x-goog-api-key": config.key} | config.headers, body, config.timeout)
    return "".join(x["text"] for x in got["candidates"][0]["content"]["parts"])


def apply(df: DataFrame, calls: list[tuple[str, AiConfig, str | None]], transport: Transport | None = None) -> DataFrame:
    """Replace prompt columns by answers, in place.

    calls: column, endpoint and model (null: the endpoint's). A null prompt stays
    null without a call; an error is the cell `[AI Error: ...]`. Where more tasks can
    run at once than the least concurrency allows calls, rows are taken together in
    as many partitions as that, in their order.
    """
    send = transport or http
    slots, least = df.sparkSession.sparkContext.defaultParallelism, max(1, min(c.concurrency for _, c, _ in calls))
    if slots > least:
        df, slots = df.coalesce(least), least
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in {c for c, _, _ in calls} else f.dataType) for f in df.schema.fields])
    names = df.columns

    def cell(config: AiConfig, model: str, prompt: str | None) -> str | None:
        if prompt is None:
            return None
        try:
            return ask(config, model, prompt, send)
        except Exception as e:  # noqa: BLE001  any failure is the cell's
            return f"[AI Error: {type(e).__name__}: {e}]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            for name, config, model in calls:
                at = names.index(name)
                with ThreadPoolExecutor(max(1, config.concurrency // slots)) as pool:
                    answers = list(pool.map(lambda p, c=config, m=model: cell(c, m or c.model, p), columns[at].to_pylist()))
                columns[at] = pa.array(answers, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)
