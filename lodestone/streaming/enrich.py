"""Captured responses find the requests that they belong to, as a stream.

Requests and responses come in one stream and any order. A response goes to the newest request of its
method and address that is not later than it, not older than `within` and has no response yet; each
request takes one response only. A response that finds none is an orphan. Each request gives one row once
nothing can reach it any more, each orphan one when its turn has come.

Rows wait in the state of their path until the watermark has passed them and are then taken in the order
of their time, so the result does not depend on how the stream was cut into batches, and a replayed batch
gives the same rows. State ends by timer: a key holds the rows of the watermark's delay, and the requests
of the last `within`. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

REQUEST, RESPONSE, ANY_METHOD = "request", "response", "?"
ROW = "at long, kind string, id string, method string, url string, body string, headers string"
OUT = "request_id string, response_id string, at long, method string, url string, body string, headers string, orphan boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ABSOLUTE, _PORTS = r"^[A-Za-z][A-Za-z0-9+.-]*://", {"http": 80, "https": 443}


def url_key(url: Column) -> Column:
    """The path of an absolute or relative address, else the address itself. Addresses that `same_url`
    holds equal have the same key."""
    rest = F.regexp_replace(url, _ABSOLUTE + "[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return F.when(url.rlike(_ABSOLUTE), F.when(path == "", "/").otherwise(path)).when(url.startswith("/"), path).otherwise(url)


def _parts(url: str) -> tuple[str, str, str] | None:
    """(host, path, search) of an absolute address."""
    if not re.match(_ABSOLUTE, url):
        return None
    try:
        s = urlsplit(url)
        port = f":{s.port}" if s.port and s.port != _PORTS.get(s.scheme.lower()) else ""
    except ValueError:
        return None
    return (s.hostname or "") + port, s.path or "/", f"?{s.query}" if s.query else ""


def same_url(request: str, response: str) -> bool:
    """Equal; or, for a response that knows its path only, equal path and query; or equal host and path."""
    if request == response:
        return True
    a = _parts(request)
    if response.startswith("/"):
        return a is not None and a[1] + a[2] == response.split("#")[0]
    b = _parts(response)
    return a is not None and b is not None and a[:2] == b[:2]


def merged_headers(own: str | None, more: str | None) -> str | None:
    """A request's headers and those of its response which it lacks, by lower-case name."""
    if not more:
        return own
    mine = json.loads(own) if own else {}
    for k, v in json.loads(more).items():
        if not mine.get(k.lower()):
            mine[k.lower()] = v
    return json.dumps(mine, sort_keys=True, ensure_ascii=False)


class Open:
    """Open requests in the order of their time, found by what `same_url` compares: each stands under its
    address, its path and query, and its host and path, with its method and without."""

    def __init__(self, requests: list[list]):
        self.requests: list[list | None] = []
        self.under: dict[tuple, list[int]] = {}
        for r in requests:
            self.add(r)

    def add(self, request: list) -> None:
        url, parts = request[4], _parts(request[4])
        for key in [("url", url)] + ([("path", parts[1] + parts[2]), ("place", parts[:2])] if parts else []):
            for method in {request[3], ANY_METHOD}:
                self.under.setdefault((method, *key), []).append(len(self.requests))
        self.requests.append(request)

    def take(self, at: int, method: str, url: str, within: int) -> list | None:
        """The newest open request that a response fits, which is open no more."""
        if url.startswith("/"):
            other = ("path", url.split("#")[0])
        else:
            parts = _parts(url)
            other = parts and ("place", parts[:2])
        best = -1
        for key in (("url", url), other):
            places = self.under.get((method, *key), []) if key else []
            while places and self.requests[places[-1]] is None:
                places.pop()
            best = max(best, places[-1] if places else -1)
        if best < 0 or at - self.requests[best][0] > within:
            return None
        request, self.requests[best] = self.requests[best], None
        return request

    def left(self) -> list[list]:
        return [r for r in self.requests if r is not None]


class Enricher(StatefulProcessor):
    def __init__(self, within_ms: int):
        self.within = within_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.open = handle.getListState("open", ROW)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in ("at", "kind", "id", "method", "url", "body", "headers")) for r in rows if r["kind"] in (REQUEST, RESPONSE)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(r[0] for r in new) + self.within + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting, requests, out = list(self.waiting.get()), [list(r) for r in self.open.get()], []
        due = sorted((r for r in waiting if r[0] <= now), key=lambda r: (r[0], r[1] != REQUEST, r[2]))
        found = Open(requests)
        for row in due:
            if row[1] == REQUEST:
                found.add(list(row))
                continue
            at, _, name, method, url, body, headers = row
            r = found.take(at, method, url, self.within)
            if r is None:
                out.append(self._row(None, name, at, "UNKNOWN" if method == ANY_METHOD else method, url, body, headers, True))
                continue
            out.append(self._row(r[2], name, r[0], r[3], r[4], body, merged_headers(r[6], headers), False))
        requests = found.left()
        out += [self._row(r[2], None, r[0], r[3], r[4], None, r[6], False) for r in requests if r[0] + self.within < now]
        for state, left in ((self.waiting, [r for r in waiting if r[0] > now]), (self.open, [tuple(r) for r in requests if r[0] + self.within >= now])):
            state.put(left) if left else state.clear()
        return iter(out)

    @staticmethod
    def _row(request, response, at, method, url, body, headers, orphan) -> Row:
        return Row(request_id=request, response_id=response, at=at, method=method, url=url, body=body, headers=headers, orphan=orphan)

    def close(self) -> None:
        pass


def enriched(stream: DataFrame, within_ms: int = 2000, late: str = "0 seconds") -> DataFrame:
    """`stream` has at (timestamp), kind (request or response), id, method, url, body and headers (a JSON
    object or null). Rows of another kind only move the clock. Needs the RocksDB state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark("at", late)
    rows = rows.select(url_key(F.coalesce("url", F.lit(""))).alias("key"), F.unix_millis("at").alias("at"), "kind", "id", F.coalesce("method", F.lit(ANY_METHOD)).alias("method"), F.coalesce("url", F.lit("")).alias("url"), "body", "headers", F.col("at").alias("event_time"))
    # no filter on the kind: it would be pushed below the watermark, and clock rows would not move it
    made = rows.groupBy("key").transformWithState(statefulProcessor=Enricher(within_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return made.withColumn("at", F.timestamp_millis("at"))
