"""A wiki's spaces, pages and attachments over its REST interface, as a Spark data source.

``spark.read.format("wiki").option("url", ...).option("entity", "pages").option("spaces", "A,B").load()`` has a partition
for each space. Lists are read page by page as long as the answer names a next one and is full; status 429 and 500 up are
tried again after 1, 2, 4 ... seconds; any other failure ends that list with what was read.

Options narrow what is read, on the server: ``ids`` (pages by id, a partition for some of them), ``keys`` (spaces by key),
``query`` (a text that pages of a space hold) and ``since`` (pages or attachments that changed at or after a time), the
latter two by the search endpoint, whose query language quotes values.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

SCHEMAS = {
    "spaces": "id string, key string, name string, type string, status string",
    "pages": "id string, title string, space_key string, body string, version bigint, last_modified string",
    "attachments": "id string, page_id string, space_key string, name string, extension string, mime_type string, url string",
}


class WikiError(Exception):
    pass


def get_json(url: str, token: str | None = None, attempts: int = 4, wait_s: float = 1.0, timeout_s: float = 30.0) -> dict:
    """The answer to a GET; waits and tries again while the server is busy."""
    for attempt in range(attempts):
        try:
            request = urllib.request.Request(url, headers={"Accept": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {}))
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                raise WikiError(f"status {e.code}") from e
        except (OSError, ValueError) as e:
            if attempt == attempts - 1:
                raise WikiError(str(e)) from e
        if attempt < attempts - 1:
            time.sleep(wait_s * 2**attempt)
    raise WikiError("the server stays busy")


def listed(base: str, path: str, parameters: dict, limit: int, **how) -> Iterator[dict]:
    """The results of a list, page by page; an error ends it with what was read."""
    start = 0
    while True:
        query = urllib.parse.urlencode({**parameters, "limit": limit, "start": start})
        try:
            answer = get_json(f"{base}{path}?{query}", **how)
        except WikiError:
            return
        results = answer.get("results") or []
        yield from results
        if not (answer.get("_links") or {}).get("next") or len(results) < min(limit, answer.get("limit", limit)):
            return
        start += len(results)


def _page(p: dict, space: str) -> tuple:
    version, history = p.get("version") or {}, (p.get("history") or {}).get("lastUpdated") or {}
    body = ((p.get("body") or {}).get("storage") or {}).get("value")
    return str(p.get("id")), p.get("title"), space, body, version.get("number"), version.get("when") or history.get("when")


def quoted(value: str) -> str:
    """A value of a search, in quotes."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def get_bytes(url: str, token: str | None = None, attempts: int = 4, wait_s: float = 1.0, timeout_s: float = 60.0) -> bytes | None:
    """What is at an address, waiting and trying again while the server is busy; None if it can't be had."""
    for attempt in range(attempts):
        try:
            request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500:
                return None
        except OSError:
            pass
        if attempt < attempts - 1:
            time.sleep(wait_s * 2**attempt)
    return None


#: Pages that one partition of a lookup by id reads.
IDS = 100


class _Part(InputPartition):
    """A space, or some ids."""

    def __init__(self, space: str | None = None, ids: tuple[str, ...] = ()) -> None:
        super().__init__((space, ids))
        self.space, self.ids = space, ids


class WikiReader(DataSourceReader):
    def __init__(self, options: dict, entity: str) -> None:
        several = lambda name: [x for x in options.get(name, "").split(",") if x]
        self.base, self.entity = options["url"].rstrip("/"), entity
        self.spaces, self.ids, self.keys = several("spaces"), several("ids"), several("keys")
        self.since, self.query, self.limit = options.get("since"), options.get("query"), int(options.get("limit", "250"))
        self.how = {"token": options.get("token"), "wait_s": float(options.get("wait", "1"))}

    def partitions(self):
        if self.entity == "spaces":
            return [_Part()]
        if self.ids:
            return [_Part(ids=tuple(self.ids[i : i + IDS])) for i in range(0, len(self.ids), IDS)]
        keys = self.spaces or [s["key"] for s in listed(self.base, "/rest/api/space", {}, self.limit, **self.how)]
        return [_Part(k) for k in keys] or [_Part()]

    def one(self, path: str, parameters: dict) -> dict | None:
        """A single object; None if there is none."""
        try:
            return get_json(f"{self.base}{path}?{urllib.parse.urlencode(parameters)}", **self.how)
        except WikiError:
            return None

    def read(self, partition):
        if self.entity == "spaces":
            named = (self.one(f"/rest/api/space/{urllib.parse.quote(k, safe='')}", {}) for k in self.keys)
            for s in named if self.keys else listed(self.base, "/rest/api/space", {}, self.limit, **self.how):
                if s and s.get("key") and s.get("name"):
                    yield str(s.get("id")), s["key"], s["name"], s.get("type") or "GLOBAL", s.get("status") or "CURRENT"
            return
        expand = {"expand": "body.storage,version,history.lastUpdated,space"}
        if partition.ids:
            pages = (self.one(f"/rest/api/content/{urllib.parse.quote(i, safe='')}", expand) for i in partition.ids)
            pages = (p for p in pages if p and p.get("id") is not None)
        elif partition.space is None:
            return
        elif self.entity == "attachments" and self.since:
            yield from self.changed_attachments(partition.space)
            return
        elif self.since or (self.query or "").strip():
            wanted = [f"space = {quoted(partition.space)}", "type = page"]
            wanted += [f"text ~ {quoted(self.query.strip())}"] if (self.query or "").strip() else []
            wanted += [f"lastModified >= {quoted(self.since)}"] if self.since else []
            pages = (r.get("content") or r for r in listed(self.base, "/rest/api/content/search", {"cql": " AND ".join(wanted), **expand}, self.limit, **self.how))
        else:
            pages = listed(self.base, "/rest/api/content", {"spaceKey": partition.space, **expand}, self.limit, **self.how)
        for p in pages:
            space = partition.space or (p.get("space") or {}).get("key")
            if self.entity == "pages":
                yield _page(p, space)
                continue
            for a in listed(self.base, f"/rest/api/content/{p['id']}/child/attachment", {}, 200, **self.how):
                yield _attachment(a, str(p["id"]), space)

    def changed_attachments(self, space: str) -> Iterator[tuple]:
        cql = f"space = {quoted(space)} AND type = attachment AND lastModified >= {quoted(self.since)}"
        for a in listed(self.base, "/rest/api/content/search", {"cql": cql, "expand": "container,version,metadata"}, self.limit, **self.how):
            a = a.get("content") or a
            yield _attachment(a, str((a.get("container") or {}).get("id") or ""), space)


def _attachment(a: dict, page_id: str, space: str) -> tuple:
    name = a.get("title") or ""
    dot = name.rfind(".")
    ext = name[dot + 1 :].lower() if 0 < dot < len(name) - 1 else ""
    return str(a.get("id")), page_id, space, name, ext, (a.get("metadata") or {}).get("mediaType"), (a.get("_links") or {}).get("download")


def downloaded(attachments: DataFrame, base: str, *, token: str | None = None, wait_s: float = 1.0, longest: int = 256 << 20) -> DataFrame:
    """``attachments`` with ``content``, the bytes of each; null where there is no link, the server has none, or more than ``longest``.

    Attachments are read by the tasks that hold their rows, one at a time, so a task's memory holds one of them.
    """
    columns = attachments.columns
    link = columns.index("url")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                url = row.column(link)[0].as_py()
                data = get_bytes(urllib.parse.urljoin(base.rstrip("/") + "/", url.lstrip("/")), token, wait_s=wait_s) if (url or "").strip() else None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data if data is None or len(data) <= longest else None], pa.binary())], [*columns, "content"])

    schema = StructType([*attachments.schema.fields, StructField("content", BinaryType())])
    return attachments.mapInArrow(fetch, schema)


class WikiDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("entity", "pages")]

    def reader(self, schema):
        return WikiReader(dict(self.options), self.options.get("entity", "pages"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WikiDataSource)


def pages_since(pages: DataFrame, instant: str) -> DataFrame:
    """Pages of a stored copy that changed at or after an instant; a filter that reaches a Parquet scan."""
    return pages.where(F.col("last_modified") >= instant)


def search(pages: DataFrame, space_key: str, text: str) -> DataFrame:
    """Pages of a space whose title or body holds a text."""
    return pages.where((F.col("space_key") == space_key) & (F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("body"), F.lit(text.lower()))))


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new copy of the spaces, or the old one where nothing was read."""
    return new if new.limit(1).count() else old
