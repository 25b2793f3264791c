"""Remote reads that retry, back off and degrade: a Python data source over any page fetcher.

``fetch(url, params) -> (status, retry_after, rows)`` is injected, so nothing here needs a network.  A failed
part yields one row with ``degraded`` set and the reason, never a failed batch.
"""

from __future__ import annotations

import json
import random
import time

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = frozenset({429, 500, 502, 503, 504})


def backoff_s(attempt: int, retry_after: float | None, base: float = 0.5, cap: float = 30.0, seed: int = 0) -> float:
    """The server's wish if stated, else exponential with jitter, both capped."""
    if retry_after is not None:
        return min(cap, max(0.0, retry_after))
    return min(cap, base * 2**attempt) * (0.5 + random.Random(seed * 1000 + attempt).random() / 2)


def fetch_with_retry(fetch, url: str, params: dict, attempts: int = 4, sleep=time.sleep):
    """(rows, reason): reason is null unless all attempts failed or the answer cannot be retried."""
    reason = "not tried"
    for attempt in range(attempts):
        try:
            status, retry_after, rows = fetch(url, params)
        except OSError as error:
            status, retry_after, rows, reason = None, None, [], f"{type(error).__name__}: {error}"
        else:
            if status == 200:
                return rows, None
            reason = f"HTTP {status}"
            if status not in RETRIED:
                break
        if attempt + 1 < attempts:
            sleep(backoff_s(attempt, retry_after))
    return [], reason


class _Part(InputPartition):
    def __init__(self, params: dict):
        self.params = params


class _Reader(DataSourceReader):
    def __init__(self, fetch, url: str, parts: list[dict]):
        self.fetch, self.url, self.parts = fetch, url, parts

    def partitions(self):
        return [_Part(p) for p in self.parts]

    def read(self, partition):
        rows, reason = fetch_with_retry(self.fetch, self.url, partition.params)
        if reason is not None:
            yield json.dumps(partition.params, sort_keys=True), None, True, reason
        for row in rows:
            yield json.dumps(partition.params, sort_keys=True), json.dumps(row, ensure_ascii=False), False, None


def remote_source(name: str, fetch) -> type[DataSource]:
    """A data source class to register: options ``url`` and ``parts`` (a JSON array of parameter objects)."""

    class Remote(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "params string, record string, degraded boolean, reason string"

        def reader(self, schema):
            return _Reader(fetch, self.options.get("url", ""), json.loads(self.options.get("parts", "[{}]")))

    return Remote


def title_batches(titles: list[str], most: int = 20) -> list[dict]:
    """Parameters for lookups of at most ``most`` titles each."""
    return [{"titles": "|".join(titles[i : i + most])} for i in range(0, len(titles), most)]
