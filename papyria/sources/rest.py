"""A Python data source for opinions of a REST service: one partition for each case, two requests each.

    spark.dataSource.register(OpinionSource)
    spark.read.format("opinions").option("base", url).option("cases", '{"slug": 1}').option("token", "...").load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Waits of a rate limit, and attempts with waits of 2, 4, 8 seconds between them.
MOST_WAITS, ATTEMPTS = 8, 4


class RequestFailed(RuntimeError):
    pass


def open_url(url: str, token: str | None) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, headers={"Authorization": f"Token {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=30) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), b""


def get_json(url: str, token: str | None = None, fetch: Callable = open_url, sleep: Callable = time.sleep) -> dict:
    """429 waits what the service says and a second; other 4xx fail at once; 5xx and network errors are tried again."""
    waits = failures = 0
    while True:
        try:
            status, headers, body = fetch(url, token)
        except OSError as e:
            status, headers, body = 599, {}, str(e).encode()
        if status < 300:
            return json.loads(body)
        if status == 429:
            waits += 1
            if waits > MOST_WAITS:
                raise RequestFailed(f"{url}: still limited after {MOST_WAITS} waits")
            sleep(float(headers.get("Retry-After", 60)) + 1)
        elif status < 500:
            raise RequestFailed(f"{url}: status {status}")
        else:
            failures += 1
            if failures >= ATTEMPTS:
                raise RequestFailed(f"{url}: {ATTEMPTS} attempts failed")
            sleep(2**failures)


class _Case(InputPartition):
    def __init__(self, slug: str, number: int):
        self.slug, self.number = slug, number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.base, self.token = options["base"].rstrip("/"), options.get("token")
        only = {x for x in options.get("only", "").split(",") if x}
        self.cases = {k: v for k, v in json.loads(options["cases"]).items() if not only or k in only}

    def partitions(self):
        return [_Case(k, int(v)) for k, v in self.cases.items()]

    def read(self, partition) -> Iterator[tuple]:
        opinion = get_json(f"{self.base}/opinions/{partition.number}/", self.token)
        cluster = get_json(opinion["cluster"], self.token) if opinion.get("cluster") else {}
        yield partition.slug, json.dumps({"opinion": opinion, "cluster": cluster}, ensure_ascii=False)


class OpinionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "opinions"

    def schema(self) -> str:
        return "slug string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
