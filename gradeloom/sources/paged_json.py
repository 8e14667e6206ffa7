"""Paged JSON as a Spark data source.

``register_paged_json(spark, name, fetch)`` makes ``spark.read.format(name)``
available. ``fetch(params, body)`` is any picklable callable that returns the
parsed payload of one request; credentials and transport live inside it.

Options: ``mode`` (none, page, offset, next_token), ``config`` (JSON object with
the paging options), ``params`` and ``body`` (JSON), ``records_path``,
``page_size`` (override), ``parallel_pages``; for streams ``pages_per_task`` (page
and offset mode) and ``pages_per_trigger`` (token mode).

In page and offset mode ``parallel_pages`` tasks read neighbouring pages. A few requests
tell about where the pages end; the last task goes on until the source says it is done, so
no page is left out, and ``paging.cut_tail`` drops pages read past the end. Token paging is
a chain and runs in one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    SimpleDataSourceStreamReader,
)

from gradeloom.functions.mapping import path_steps
from gradeloom.sources.paging import DEFAULT_NAMES, MODES, OFFSET_PAGE_SIZE

SCHEMA = "page_index long, position string, has_more boolean, request string, payload string"
MAX_PAGES_PER_TRIGGER = 100

Fetch = Callable[[dict, object], object]


def lookup(payload: object, path: str | None) -> object:
    """Plain value at a path without wildcards; NULL when it is not there."""
    here = payload
    for step in path_steps(path):
        if isinstance(step, int) and isinstance(here, list) and step < len(here):
            here = here[step]
        elif isinstance(step, str) and isinstance(here, dict) and step in here:
            here = here[step]
        else:
            return None
    return here


def _whole(value: object, default: int | None) -> int | None:
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        return default
    try:
        return int(value)
    except ValueError:
        return default


def _holds_items(payload: object) -> bool:
    """Whether any list in the payload has an element.

    A reader that runs by itself must end; a non-empty object alone, which a
    person paging by hand may take as a reason to go on, is not enough.
    """
    if isinstance(payload, list):
        return bool(payload)
    return isinstance(payload, dict) and any(_holds_items(v) for v in payload.values())


class Pager:
    """Requests and page links of one source."""

    def __init__(self, options: dict[str, str]) -> None:
        self.mode = options.get("mode", "none")
        if self.mode not in MODES:
            raise ValueError(f"Unsupported pagination mode: {self.mode}")
        self.config = json.loads(options.get("config", "{}"))
        self.params = json.loads(options.get("params", "{}"))
        self.body = json.loads(options["body"]) if options.get("body") else None
        self.records_path = options.get("records_path")
        self.parallel = int(options.get("parallel_pages", "1"))
        size = _whole(options.get("page_size"), None)
        if size is None:
            default = OFFSET_PAGE_SIZE if self.mode == "offset" else None
            size = _whole(self.config.get("page_size"), default)
        self.size = size

    def start(self) -> object:
        if self.mode == "page":
            return _whole(self.config.get("start_page"), 1)
        if self.mode == "offset":
            return _whole(self.config.get("start_offset"), 0)
        return self.config.get("initial_token") if self.mode == "next_token" else None

    def jump(self, pages: int) -> object:
        """Position that many pages after the start (page and offset mode)."""
        return self.start() + pages * (1 if self.mode == "page" else self.size)

    def request(self, position: object) -> tuple[dict, object]:
        def name(kind: str, option: str) -> str:
            return str(self.config.get(option, DEFAULT_NAMES[kind]))

        values: dict[str, object] = {}
        if self.mode == "page":
            values[name("page", "page_param")] = position
            if self.size is not None and self.config.get("page_size_param"):
                values[str(self.config["page_size_param"])] = self.size
        elif self.mode == "offset":
            values = {name("offset", "offset_param"): position, name("limit", "limit_param"): self.size}
        elif self.mode == "next_token" and position not in (None, ""):
            values = {name("token", "token_param"): position}
        if self.config.get("placement") == "body" and isinstance(self.body, dict):
            return dict(self.params), {**self.body, **values}
        return {**self.params, **values}, self.body

    def following(self, position: object, payload: object) -> object | None:
        """Position of the next page, or None at the end."""
        if self.mode == "none":
            return None
        if self.mode == "next_token":
            token = lookup(payload, str(self.config.get("response_token_path", "next_token")))
            return None if token == "" else token
        more = None
        if self.config.get("has_more_path"):
            more = lookup(payload, str(self.config["has_more_path"]))
        if not isinstance(more, bool):
            found = lookup(payload, self.records_path) if self.records_path else payload
            more = _holds_items(found)
        return position + (1 if self.mode == "page" else self.size) if more else None

    def read(self, fetch: Fetch, index: int, position: object) -> tuple[tuple, object | None]:
        params, body = self.request(position)
        payload = fetch(params, body)
        after = self.following(position, payload)
        shown = json.dumps({"params": params, "body": body}, ensure_ascii=False)
        text = json.dumps(payload, ensure_ascii=False)
        where = None if position is None else str(position)
        return (index, where, after is not None, shown, text), after


def first_end(leads_on: Callable[[int], bool], low: int, most: float = float("inf")) -> int:
    """Number of the first page that does not lead on, from ``low`` on, by doubling the
    distance up to ``most`` and then halving it."""
    step = 1
    while step <= most and leads_on(low + step - 1):
        low, step = low + step, step * 2
    high = low + step - 1  # pages below low lead on, page high does not
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if leads_on(middle) else (low, middle)
    return low


class _Pages(InputPartition):
    """Pages from ``first`` up to ``last``, or until the source says it is done."""

    def __init__(self, first: int, last: int | None) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    #: A source that leads on after so many pages is not asked for farther ones in advance.
    MOST_PAGES = 1 << 40

    def __init__(self, pager: Pager, fetch: Fetch) -> None:
        self.pager, self.fetch = pager, fetch

    def _leads_on(self, index: int) -> bool:
        """Whether a page names a next one. One that cannot be read is taken as behind the end;
        the task that gets there reads it again and fails, if it is not."""
        position = self.pager.jump(index)
        try:
            return self.pager.following(position, self.fetch(*self.pager.request(position))) is not None
        except Exception:
            return False

    def partitions(self) -> list[InputPartition]:
        if self.pager.mode not in ("page", "offset") or self.pager.parallel <= 1:
            return [_Pages(0, None)]
        pages = first_end(self._leads_on, 0, self.MOST_PAGES) + 1
        tasks = min(self.pager.parallel, pages)
        cuts = [pages * k // tasks for k in range(tasks)]
        return [_Pages(a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        index = partition.first
        position = self.pager.jump(index) if index else self.pager.start()
        while position is not None or index == partition.first:
            row, position = self.pager.read(self.fetch, index, position)
            yield row
            index += 1
            if index == partition.last:
                return


def item_count(payload: object, path: str | None) -> int:
    """Items of a page: of the list at ``path``, else 1 for a payload that holds any."""
    found = lookup(payload, path) if path else payload
    return len(found) if isinstance(found, list) else int(_holds_items(found))


def with_items(payload: object, path: str | None, first: int, last: int | None) -> object:
    """The payload with only items ``first`` to ``last`` of the list at ``path``."""
    steps = list(path_steps(path)) if path else []

    def cut(here: object, depth: int) -> object:
        if depth == len(steps):
            return here[first:last] if isinstance(here, list) else here if first == 0 else None
        step = steps[depth]
        if isinstance(here, list) and isinstance(step, int) and step < len(here):
            return [cut(x, depth + 1) if i == step else x for i, x in enumerate(here)]
        if isinstance(here, dict) and step in here:
            return {**here, step: cut(here[step], depth + 1)}
        return here

    return cut(payload, 0)


class _Range(InputPartition):
    """Pages ``first`` to ``last``; of the first one ``skip`` items were read before, of the last one ``upto`` count."""

    def __init__(self, first: int, last: int, skip: int, upto: int | None) -> None:
        self.first, self.last, self.skip, self.upto = first, last, skip, upto


class _PageStreamReader(DataSourceStreamReader):
    """Numbered pages, read by many tasks.

    The offset is the number of pages that are complete and the number of items of the
    page after them. That page stays open: it is asked for again and gives the items
    that were added. A page is complete when the response says that more follow, or,
    without such a flag, when it has ``page_size`` items or a later page exists.

    The driver only asks whether pages exist, doubling the distance and then halving it,
    so a thousand new pages cost about twenty small probes. A page with the content of an
    earlier one does not exist: some sources answer any number.
    """

    MOST_PROBES = 200

    def __init__(self, pager: Pager, fetch: Fetch, per_task: int) -> None:
        self.pager, self.fetch, self.per_task = pager, fetch, per_task
        self.known = 0

    def _probe(self, index: int, seen: dict[int, object]) -> tuple[int, bool | None]:
        """Items of a page (0: it does not exist) and what its flag says."""
        if len(seen) > self.MOST_PROBES:
            raise RuntimeError("the source does not say where its pages end")
        if index not in seen:
            seen[index] = self.fetch(*self.pager.request(self.pager.jump(index)))
        payload = seen[index]
        if any(payload == other for i, other in seen.items() if i < index):
            return 0, None
        flag = self.pager.config.get("has_more_path")
        more = lookup(payload, str(flag)) if flag else None
        return item_count(payload, self.pager.records_path), more if isinstance(more, bool) else None

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"pages": 0, "open": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        seen: dict[int, object] = {}

        def leads_on(index: int) -> bool:
            items, more = self._probe(index, seen)
            return items > 0 and more is not False

        low = first_end(leads_on, self.known)
        items, _ = self._probe(low, seen)
        if not items and low:  # the page before may still fill up
            before, more = self._probe(low - 1, seen)
            full = more is True or (self.pager.size is not None and before >= self.pager.size)
            low, items = (low, 0) if full else (low - 1, before)
        self.known = low
        return {"pages": low, "open": items}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["pages"], end["pages"] + (end.get("open", 0) > 0)
        parts = []
        for i in range(first, last, self.per_task):
            stop = min(i + self.per_task, last)
            skip = start.get("open", 0) if i == first else 0
            parts.append(_Range(i, stop, skip, end["open"] if stop > end["pages"] else None))
        return parts

    def read(self, partition: _Range) -> Iterator[tuple]:
        for index in range(partition.first, partition.last):
            (number, position, more, request, payload), _ = self.pager.read(self.fetch, index, self.pager.jump(index))
            skip = partition.skip if index == partition.first else 0
            upto = partition.upto if index == partition.last - 1 else None
            if skip or upto is not None:
                payload = json.dumps(
                    with_items(json.loads(payload), self.pager.records_path, skip, upto), ensure_ascii=False
                )
            yield number, position, more, request, payload

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["pages"])


class _ChainStreamReader(SimpleDataSourceStreamReader):
    """Follows tokens: each page names the next one, so a trigger reads a bounded few
    (``pages_per_trigger``) in order. The offset is the page to ask for and how many of its
    items were read. A page that names no next one stays open and is asked for again."""

    def __init__(self, pager: Pager, fetch: Fetch, limit: int) -> None:
        self.pager, self.fetch, self.limit = pager, fetch, limit

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
        return {"index": 0, "position": self.pager.start(), "open": 0}

    def _walk(self, offset: dict, end: dict | None) -> tuple[list[tuple], dict]:
        rows, index, position, skip = [], offset["index"], offset["position"], offset["open"]
        path = self.pager.records_path
        while len(rows) < self.limit if end is None else index <= end["index"]:
            upto = end["open"] if end is not None and index == end["index"] else None
            if upto is not None and upto <= skip:
                break
            row, after = self.pager.read(self.fetch, index, position)
            payload = json.loads(row[4])
            items = item_count(payload, path) if upto is None else upto
            if items > skip:
                rows.append((*row[:4], json.dumps(with_items(payload, path, skip, upto), ensure_ascii=False)))
            if after is None or upto is not None:
                return rows, {"index": index, "position": position, "open": max(items, skip)}
            index, position, skip = index + 1, after, 0
        return rows, {"index": index, "position": position, "open": skip}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, after = self._walk(start, None)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._walk(start, end)[0])


def register_paged_json(spark: SparkSession, name: str, fetch: Fetch) -> None:
    """Register a batch and streaming source called ``name`` around ``fetch``."""

    class PagedJson(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return _Reader(Pager(dict(self.options)), fetch)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
            pager = Pager(dict(self.options))
            if pager.mode not in ("page", "offset"):
                raise PySparkNotImplementedError(
                    errorClass="NOT_IMPLEMENTED", messageParameters={"feature": "parallel token paging"}
                )
            return _PageStreamReader(pager, fetch, int(self.options.get("pages_per_task", "10")))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
            limit = int(self.options.get("pages_per_trigger", MAX_PAGES_PER_TRIGGER))
            return _ChainStreamReader(Pager(dict(self.options)), fetch, limit)

    spark.dataSource.register(PagedJson)
