"""A Python data source over a paged API: cursor following, duplicate removal, page shrinking. The client is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST_LIMIT = 25
#: What a cursor may carry on; anything else in it is a change of the interface.
PAGING = frozenset({"after", "before", "limit", "since", "until"})
#: Good pages after which a shrunken page doubles again.
GROW_AFTER = 3


class ApiError(RuntimeError):
    """An answer that is no data: HTTP status, the service's own code, and the trace id to report."""

    def __init__(self, message: str = "", status: int | None = None, code: int | None = None, trace: str | None = None):
        super().__init__(message)
        self.status, self.code, self.trace = status, code, trace


class ServerError(ApiError):
    """The server failed; a smaller page may work."""


class CursorLoop(RuntimeError):
    """A cursor came twice."""


def raise_for(status: int, body: dict) -> None:
    """Turns an error answer into a typed error; 5xx and the codes of a passing fault are ``ServerError``."""
    error = body.get("error") if isinstance(body, dict) else None
    if status < 400 and not error:
        return
    error = error or {}
    kind = ServerError if status >= 500 or error.get("is_transient") else ApiError
    raise kind(error.get("message", f"status {status}"), status, error.get("code"), error.get("fbtrace_id") or error.get("trace_id"))


class HttpClient:
    """GET with parameters; the opener is injected (``urllib`` by default). Timeouts and broken connections count as server errors."""

    def __init__(self, base: str, token: str, *, timeout: float = 30.0, opener: Callable | None = None):
        self.base, self.token, self.timeout, self.opener = base.rstrip("/"), token, timeout, opener

    def get(self, path: str, **parameters) -> dict:
        import json
        import urllib.error
        import urllib.parse
        import urllib.request

        url = f"{self.base}/{path.lstrip('/')}?{urllib.parse.urlencode({k: v for k, v in parameters.items() if v is not None})}"
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.token}"})
        try:
            with (self.opener or urllib.request.urlopen)(request, timeout=self.timeout) as answer:
                status, body = answer.status, json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as e:
            raw = e.read()
            try:
                body = json.loads(raw or b"{}")
            except ValueError:
                body = {}
            status = e.code
        except (TimeoutError, urllib.error.URLError, ConnectionError) as e:
            raise ServerError(str(e)) from e
        raise_for(status, body)
        return body


def cursor_parameters(next_url: str | None) -> dict | None:
    """The paging parameters of a next link; None at the end, an error for parameters that are none of paging."""
    from urllib.parse import parse_qsl, urlsplit

    if not next_url:
        return None
    given = dict(parse_qsl(urlsplit(next_url).query))
    known = {k: v for k, v in given.items() if k in PAGING}
    strange = set(given) - PAGING - {"fields", "access_token", "metric", "period", "breakdown"}
    if strange:
        raise ApiError(f"unknown paging parameters {sorted(strange)}")
    return known


def pages(fetch: Callable[[str | None, int], dict], *, limit: int = FIRST_LIMIT, lenient: Callable[[str | None], dict] | None = None) -> Iterator[dict]:
    """Items over all pages, each id once. ``fetch(cursor, limit)`` gives {"data": [...], "after": cursor or None}.

    On a server error or timeout the page is halved down to one item, and doubled again after ``GROW_AFTER`` good pages. An item
    that still fails alone is asked for by ``lenient(cursor)``, which leaves out the field that breaks it; without it the error
    is raised. Other errors pass through.
    """
    seen_cursors, seen_ids, cursor, size, good = set(), set(), None, limit, 0
    while True:
        try:
            page = fetch(cursor, size)
            good += 1
        except (ServerError, TimeoutError):
            good = 0
            if size > 1:
                size = max(1, size // 2)
                continue
            if lenient is None:
                raise
            page = lenient(cursor)
        if good >= GROW_AFTER and size < limit:
            size, good = min(limit, 2 * size), 0
        for item in page["data"]:
            if item["id"] not in seen_ids:
                seen_ids.add(item["id"])
                yield item
        cursor = page.get("after")
        if cursor is None:
            return
        if cursor in seen_cursors:
            raise CursorLoop(cursor)
        seen_cursors.add(cursor)


class PagedSource(DataSource):
    """``spark.read.format("paged").option("module", ...).option("function", ...)``: the named function is ``fetch`` and gets the
    value of option ``account`` first; one partition per comma-separated account. Rows: id, payload (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "account string, id string, payload string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(a) for a in self.options.get("accounts", "me").split(",")]

    def read(self, partition):
        import importlib
        import json

        fetch = getattr(importlib.import_module(self.options["module"]), self.options["function"])
        for item in pages(lambda cursor, limit: fetch(partition.value, cursor, limit)):
            yield partition.value, item["id"], json.dumps(item, ensure_ascii=False)
