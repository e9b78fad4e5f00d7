"""WebDAV: PROPFIND answers as scans, breadth first, by a Python data source; ranged reading that goes on after breaks."""

from __future__ import annotations

import base64
import re
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from email.utils import parsedate_to_datetime
from urllib.parse import quote, urlsplit
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCAN = "path string, size bigint, mtime bigint, etag string"
_D = "{DAV:}"


def href_path(href: str) -> str:
    """Path of a link without its query: percent escapes as the characters of their numbers, no trailing slash; ``/`` if nothing is left."""
    latin = href.split("?", 1)[0].encode().decode("latin-1")
    path = re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), latin)
    if "://" in path:
        path = "/" + path.split("://", 1)[1].partition("/")[2]
    return path.rstrip("/") or "/"


def entries(xml: str) -> Iterator[tuple[str, bool, int, int, str | None]]:
    """(path, is_folder, size, mtime, etag) of a PROPFIND answer; unreadable times and sizes are 0."""
    for r in ElementTree.fromstring(xml).iter(f"{_D}response"):
        prop = next(r.iter(f"{_D}prop"), None)
        text = lambda tag: (prop.findtext(f"{_D}{tag}") if prop is not None else None) or ""  # noqa: B023, E731
        try:
            mtime = int(parsedate_to_datetime(text("getlastmodified")).timestamp())
        except (TypeError, ValueError):
            mtime = 0
        size = int(text("getcontentlength")) if text("getcontentlength").isdigit() else 0
        folder = prop is not None and prop.find(f"{_D}resourcetype/{_D}collection") is not None
        yield href_path(r.findtext(f"{_D}href") or ""), folder, size, mtime, text("getetag").strip('"') or None


def scan(root: str, propfind: Callable[[str], str]) -> list[tuple[str, int, int, str | None]]:
    """(path, size, mtime, etag) of all files below a root. ``propfind`` gives the answer, of depth 1, for a path."""
    found, todo, seen = [], deque([href_path(root)]), set()
    while todo:
        folder = todo.popleft()
        if folder in seen:
            continue
        seen.add(folder)
        for path, is_folder, size, mtime, etag in entries(propfind(folder)):
            if path != folder:
                todo.append(path) if is_folder else found.append((path, size, mtime, etag))
    return found


def scan_table(spark: SparkSession, url: str, user: str | None = None, secret: str | None = None) -> DataFrame:
    """Files below a WebDAV folder, listed by the executors: a task for each folder within it and one for its own files."""
    spark.dataSource.register(WebDavSource)
    reader = spark.read.format("webdav_scan").option("url", url)
    for name, value in (("user", user), ("secret", secret)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()


def http_propfind(url: str, user: str | None = None, secret: str | None = None) -> Callable[[str], str]:
    """A ``propfind`` that asks the server of ``url``, at depth 1."""
    at = urlsplit(url)

    def ask(path: str) -> str:
        request = urllib.request.Request(f"{at.scheme}://{at.netloc}{quote(path.encode('latin-1'))}", method="PROPFIND", headers={"Depth": "1"} | _login(user, secret))
        with urllib.request.urlopen(request, timeout=60) as answer:  # noqa: S310 - the caller names the server
            return answer.read().decode()

    return ask


def _login(user: str | None, secret: str | None) -> dict[str, str]:
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{secret or ''}".encode()).decode()} if user else {}


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:  # noqa: FBT001
        super().__init__(0)
        self.path, self.deep = path, deep


class WebDavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.user, self.secret = options["url"], options.get("user"), options.get("secret")

    def partitions(self) -> list[InputPartition]:
        root = href_path(urlsplit(self.url).path)
        below = [path for path, is_folder, *_ in entries(http_propfind(self.url, self.user, self.secret)(root)) if is_folder and path != root]
        return [_Folder(root, deep=False), *(_Folder(p, deep=True) for p in below)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        ask = http_propfind(self.url, self.user, self.secret)
        if partition.deep:
            yield from scan(partition.path, ask)
        else:
            yield from ((path, size, mtime, etag) for path, is_folder, size, mtime, etag in entries(ask(partition.path)) if not is_folder and path != partition.path)


class WebDavSource(DataSource):
    """``spark.read.format("webdav_scan").option("url", ...)``: one row per file below the folder."""

    @classmethod
    def name(cls) -> str:
        return "webdav_scan"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema: object) -> WebDavReader:
        return WebDavReader(dict(self.options))


class Changed(OSError):
    """The file was replaced while it was read."""


Answer = tuple[int, Mapping[str, str], bytes]


def http_get(url: str, user: str | None = None, secret: str | None = None) -> Callable[[dict[str, str]], Answer]:
    """A ``get`` that asks a server, for ``read_ranged``."""

    def get(headers: dict[str, str]) -> Answer:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers | _login(user, secret)), timeout=60) as answer:  # noqa: S310
            return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read()

    return get


def read_ranged(get: Callable[[dict[str, str]], Answer], block: int = 8 << 20, tries: int = 4, wait: Callable[[float], None] | None = None) -> Iterator[bytes]:
    """A file block by block through ``get(headers)``, which gives (status, headers in lower case, body) or raises OSError.

    A broken transfer goes on where it stopped, on condition that the file is the one begun with
    (``If-Range``); each answer must be for the range asked. The wait before each new try is 200 ms
    longer than the one before. Raises ``Changed`` if the file was replaced, OSError after ``tries``
    tries without progress. A server without ranges gives the whole file at once.
    """
    at, total, mark, failed = 0, None, None, 0
    while total is None or at < total:
        headers = {"Range": f"bytes={at}-{at + block - 1}"} | ({"If-Range": mark} if mark else {})
        try:
            status, given, body = get(headers)
        except OSError:
            status, given, body = 0, {}, b""
        if status == 200:
            if at:
                raise Changed("the file was replaced while it was read")
            yield body
            return
        if status == 206:
            m = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+)", given.get("content-range", ""))
            if not m or int(m[1]) != at or len(body) > int(m[2]) - int(m[1]) + 1:
                raise OSError(f"answer for another range than bytes from {at}")
            if total is not None and int(m[3]) != total:
                raise Changed("the file was replaced while it was read")
            total, mark = int(m[3]), mark or given.get("etag") or given.get("last-modified")
        if status == 416 and not at:  # an empty file has no range
            return
        if body and status == 206:
            at, failed = at + len(body), 0
            yield body
            continue
        failed += 1
        if failed >= tries:
            raise OSError(f"transfer stopped at {at} of {total if total is not None else '?'} bytes")
        if wait:
            wait(0.2 * failed)
