"""Documents from a web service: a paced, retrying fetcher, a Spark data source over it, and a fetch of whole key tables.

The transport is a parameter: a function of a path that returns a status and a body, named as ``module:function`` so that every
task can make its own. ``http`` asks a service, ``folder`` answers from files.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The paths of the three kinds of documents.
PATHS = {"calendar": "/calendar/day/{}", "race": "/races/{}", "game": "/games/{}"}
#: Seconds between requests, attempts, seconds before the second attempt and of patience.
DELAY, ATTEMPTS, BACKOFF, TIMEOUT = 0.4, 4, 1.0, 30.0

Transport = Callable[[str], tuple[int, str]]


class FetchError(RuntimeError):
    """A document could not be had: refused, or every attempt failed."""


def http(base_url: str = "", user_agent: str = "furlong", timeout: str = str(TIMEOUT), **_: str) -> Transport:
    def get(path: str) -> tuple[int, str]:
        request = urllib.request.Request(base_url + path, headers={"User-Agent": user_agent})
        try:
            with urllib.request.urlopen(request, timeout=float(timeout)) as answer:
                return answer.status, answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            return e.code, ""

    return get


def folder(root: str = "", **_: str) -> Transport:
    """Answers from <root>/<kind>/<key>.json; a file that is missing is not found."""
    names = {form.rsplit("/", 1)[0]: kind for kind, form in PATHS.items()}

    def get(path: str) -> tuple[int, str]:
        at, key = path.rsplit("/", 1)
        file = f"{root}/{names[at]}/{key}.json"
        if not os.path.exists(file):
            return 404, ""
        with open(file, encoding="utf-8") as f:
            return 200, f.read()

    return get


def made(name: str, options: dict[str, str]) -> Transport:
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)(**options)


class Fetcher:
    """Requests one after the other, at least ``delay`` seconds from the end of one to the start of the next.

    Not found (404) is None. Too many requests (429), a server's errors (500 and above), a broken connection and a body that is no JSON are tried
    again, after ``backoff`` seconds and then twice as long each time, ``attempts`` times in all. Other errors of the request (400 and above) fail at once.
    """

    def __init__(
        self, get: Transport, delay: float = DELAY, attempts: int = ATTEMPTS, backoff: float = BACKOFF,
        clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        self.get, self.delay, self.attempts, self.backoff, self.clock, self.sleep = get, delay, attempts, backoff, clock, sleep
        self.last: float | None = None
        self.requests = 0

    def _ask(self, path: str) -> tuple[int, str]:
        if self.last is not None and (rest := self.last + self.delay - self.clock()) > 0:
            self.sleep(rest)
        self.requests += 1
        try:
            return self.get(path)
        finally:
            self.last = self.clock()

    def fetch(self, path: str) -> str | None:
        wait = self.backoff
        for attempt in range(1, self.attempts + 1):
            try:
                status, body = self._ask(path)
                if status == 404:
                    return None
                if status < 400:
                    json.loads(body)
                    return body
                problem = f"status {status}"
                if status < 500 and status != 429:
                    raise FetchError(f"{path}: {problem}")
            except (OSError, ValueError) as e:
                problem = f"{type(e).__name__}: {e}"
            if attempt < self.attempts:
                self.sleep(wait)
                wait *= 2
        raise FetchError(f"{path}: {problem} after {self.attempts} attempts")

    def document(self, kind: str, key: str) -> tuple[str | None, str | None]:
        """(body, failure) of a document; both None where there is none."""
        try:
            return self.fetch(PATHS[kind].format(key)), None
        except FetchError as e:
            return None, str(e)


def _fetcher(options: dict[str, str], readers: int) -> Fetcher:
    """The fetcher of one of ``readers`` tasks: each waits so much longer that all together keep the delay."""
    own = {k: v for k, v in options.items() if k not in ("transport", "delay", "attempts", "backoff", "kind", "keys", "first", "last", "readers", "path")}
    get = made(options.get("transport", f"{__name__}:http"), own)
    delay, backoff = float(options.get("delay", DELAY)) * readers, float(options.get("backoff", BACKOFF))
    return Fetcher(get, delay, int(options.get("attempts", ATTEMPTS)), backoff)


class Keys(InputPartition):
    def __init__(self, keys: list[str]) -> None:
        self.keys = keys


class DocumentSource(DataSource):
    """``spark.read.format("racing_documents")``: documents by key, not found ones left out.

    Options: ``kind`` (calendar, race, game); ``first`` and ``last``, days of a calendar, or ``keys``, separated by commas; ``transport`` with its own
    options (for http ``base_url``, for folder ``root``); ``delay``, ``attempts``, ``backoff``; ``readers``, the number of input partitions, by default
    one a day. All readers together keep the delay, if as many run at a time. A document that cannot be had has a ``failure`` instead of a text.
    """

    @classmethod
    def name(cls) -> str:
        return "racing_documents"

    def schema(self) -> str:
        return "kind string, key string, json string, failure string"

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.kind = options.get("kind", "calendar")
        if self.kind not in PATHS:
            raise ValueError(f"unknown kind {self.kind!r}, one of {', '.join(PATHS)}")
        if "keys" in options:
            self.keys = [k for k in options["keys"].split(",") if k]
        else:
            first, last = (dt.date.fromisoformat(options[k]) for k in ("first", "last"))
            self.keys = [(first + dt.timedelta(days=i)).isoformat() for i in range((last - first).days + 1)]
        self.readers = max(1, min(int(options.get("readers", len(self.keys))), len(self.keys)))

    def partitions(self) -> list[Keys]:
        return [Keys(self.keys[i :: self.readers]) for i in range(self.readers)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        fetcher = _fetcher(self.options, self.readers)
        for key in partition.keys:
            body, failure = fetcher.document(self.kind, key)
            if body is not None or failure is not None:
                yield self.kind, key, body, failure


def fetch_keys(keys: DataFrame, kind: str, options: dict[str, str], readers: int = 1) -> DataFrame:
    """``keys`` (day, key) with json and failure, both null where nothing was found; fetched by ``readers`` tasks that together keep the delay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = _fetcher(options, readers)
        for batch in batches:
            got = [fetcher.document(kind, k) for k in batch.column(1).to_pylist()]
            columns = [pa.array([x[i] for x in got], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["day", "key", "json", "failure"])

    return keys.select("day", "key").repartition(readers).mapInArrow(run, "day date, key string, json string, failure string")
