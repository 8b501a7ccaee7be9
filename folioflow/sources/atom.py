"""A data source of paper feeds.

    spark.dataSource.register(AtomDataSource)
    spark.read.format("folioflow_atom").option("terms", json).option("cap", n).option("folder", path).load()

Terms are read one after the other, a page at a time, by one task, since a feed wants pauses between requests and
the budget is one for all terms: no page is asked for beyond it. Pages come from `fetch`, "package.module:name" or "/path/file.py:name" of a
callable that is given a request's parameters, or are files of the folder, `{term slug}-{page}.xml`. A term ends at
its first empty page. Filters on `published` and `primary_category` go into the feed's query, so that fewer pages are asked for; Spark
applies them again to what comes. A request that fails is tried again with waits that double; when it fails for good, what was
read stays and the rest is left. Known ids are asked for in chunks instead.

    spark.readStream.format("folioflow_atom").option("terms", json).option("fetch", name).load()

follows the terms as they grow, oldest entries first: its offset is how many entries of each term have been read, so a
query that starts again from its checkpoint neither skips nor repeats one.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
import logging
import re
import time
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from folioflow.functions.dates import compact_date

SCHEMA = "paper_id string, version string, title string, abstract string, authors array<string>, categories array<string>, published date, updated date, pdf_url string, primary_category string, term_pos int, pos int"
ATOM = "{http://www.w3.org/2005/Atom}"
#: The feed's names for the two orders.
ORDERINGS = {"freshest_first": ("submittedDate", "descending"), "relevance": ("relevance", "descending")}
#: The order in which a stream reads: what is new comes last.
GROWING = ("submittedDate", "ascending")
CATEGORY = re.compile(r"[a-z-]+(\.[A-Za-z-]+)?")


def search_query(term: str, categories: list[str] | None = None, after: str | None = None, before: str | None = None) -> str:
    """The feed's query for a term with optional categories and submission dates; an error for what it can't quote."""
    if '"' in term or "\\" in term:
        raise ValueError(f"a term has a quote or backslash: {term!r}")
    parts = [f'all:"{term}"']
    if categories:
        for c in categories:
            if not CATEGORY.fullmatch(c):
                raise ValueError(f"not a category: {c!r}")
        parts.append("(" + " OR ".join(f"cat:{c}" for c in categories) + ")")
    if after or before:
        lo, hi = (f"{d:%Y%m%d}{time_}" if (d := compact_date(x)) else "*" for x, time_ in ((after, "0000"), (before, "2359")))
        parts.append(f"submittedDate:[{lo} TO {hi}]")
    return " AND ".join(parts)


def entries(xml: str) -> list[tuple]:
    """Rows of a page of the feed, without places."""
    out = []
    for e in ET.fromstring(xml).iter(f"{ATOM}entry"):
        text = lambda tag: " ".join((e.findtext(f"{ATOM}{tag}") or "").split())  # noqa: B023, E731
        base, version = re.fullmatch(r"(.*?)(v\d+)?", text("id").rsplit("/", 1)[-1]).groups()
        day = lambda tag: date.fromisoformat(text(tag)[:10])  # noqa: B023, E731
        authors = [" ".join((n.text or "").split()) for n in e.iter(f"{ATOM}name")]
        categories = [c.attrib["term"] for c in e.iter(f"{ATOM}category")]
        out.append((base, version or "v1", text("title"), text("summary"), authors, categories, day("published"), day("updated"), f"https://arxiv.org/pdf/{base}", categories[0] if categories else None))
    return out


#: Entries of a page and ids of a request at most; seconds between requests.
PAGE, IDS, PAUSE_S = 100, 50, 3.0


def _callable(where: str):
    """Of "package.module:name", or of "file.py:name" with the file's whole path."""
    module, _, name = where.rpartition(":")
    if not module.endswith(".py"):
        return getattr(importlib.import_module(module), name)
    spec = importlib.util.spec_from_file_location(Path(module).stem, module)
    loaded = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(loaded)
    return getattr(loaded, name)


def page_requests(query: str, ordering: str, start: int, most: int) -> dict:
    by, order = ORDERINGS[ordering]
    return {"search_query": query, "start": start, "max_results": min(PAGE, most), "sortBy": by, "sortOrder": order}


class AtomReader(DataSourceReader):
    def __init__(self, options: dict):
        self.terms, self.ids = json.loads(options.get("terms", "[]")), json.loads(options.get("ids", "[]"))
        self.folder, self.fetch = options.get("folder"), options.get("fetch")
        self.cap, self.ordering = int(options.get("cap", 10_000)), options.get("ordering", "freshest_first")
        if self.ordering not in ORDERINGS:
            raise ValueError(f"ordering is one of {sorted(ORDERINGS)}")
        self.attempts, self.pause = int(options.get("attempts", 4)), float(options.get("pause_s", PAUSE_S))
        self.categories = json.loads(options.get("categories", "null"))
        self.after, self.before = (compact_date(options.get(k)) for k in ("after", "before"))

    @property
    def queries(self) -> list[str]:
        day = lambda d: d and d.isoformat()
        return [search_query(t, self.categories, day(self.after), day(self.before)) for t in self.terms]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Bounds of the days and the first categories narrow the feed's query; all filters are left to Spark as well."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("published",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.after = max(filter(None, (self.after, f.value)))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.before = min(filter(None, (self.before, f.value)))
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("primary_category",):
                named = [f.value] if isinstance(f, EqualTo) else list(f.value)
                # an entry of these has one of them among its categories; the options' own limits hold too
                if named and self.categories is None and all(isinstance(c, str) and CATEGORY.fullmatch(c) for c in named):
                    self.categories = named
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def asked(self, request: dict, term: str = "") -> list[tuple]:
        """Entries of one request; none when it has failed for good."""
        if not self.fetch:
            p = Path(self.folder) / f"{re.sub('[^A-Za-z0-9]+', '_', term)}-{request['page']}.xml"
            return entries(p.read_text()) if p.exists() else []
        call = _callable(self.fetch)
        for n in range(self.attempts):
            try:
                return entries(call(request) or "<feed/>")
            except Exception as e:  # noqa: BLE001  what a client may raise isn't known
                logging.getLogger(__name__).warning("request %s failed: %s", request, e)
                if n + 1 < self.attempts:
                    time.sleep(self.pause * 2**n)
        logging.getLogger(__name__).warning("the feed was cut short at %s", request)
        raise EOFError

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            yield from self.by_id() if self.ids else self.by_term()
        except EOFError:
            return

    def by_id(self) -> Iterator[tuple]:
        pos = 0
        for at in range(0, len(self.ids), IDS):
            if at:
                time.sleep(self.pause)
            some = self.ids[at : at + IDS]
            for r in self.asked({"id_list": ",".join(some), "max_results": len(some), "page": at // IDS}, "ids"):
                yield (*r, 0, pos)
                pos += 1

    def by_term(self) -> Iterator[tuple]:
        left, first = self.cap, True
        for t, (term, query) in enumerate(zip(self.terms, self.queries, strict=True)):
            pos, page = 0, 0
            while left > 0:
                if not first and self.fetch:
                    time.sleep(self.pause)
                first = False
                rows = self.asked({**page_requests(query, self.ordering, pos, left), "page": page}, term)
                if not rows:
                    break
                for r in rows[:left]:
                    yield (*r, t, pos)
                    pos += 1
                left -= len(rows[:left])
                page += 1


class AtomStream(SimpleDataSourceStreamReader):
    """Pages of the terms in turn, `pages` a batch at most with a pause between, oldest entries first."""

    def __init__(self, options: dict):
        self.feed, self.pages = AtomReader({**options, "ids": "[]"}), int(options.get("pages", 10))

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"read": [0] * len(self.feed.terms)}

    def _page(self, term: int, start: int, most: int) -> list[tuple]:
        request = {**page_requests(self.feed.queries[term], "freshest_first", start, most), "sortBy": GROWING[0], "sortOrder": GROWING[1], "page": start // PAGE}
        rows = self.feed.asked(request, self.feed.terms[term])
        return [(*r, term, start + i) for i, r in enumerate(rows[:most])]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at, out, asked = list(start["read"]), [], 0
        try:
            for term in range(len(at)):
                while asked < self.pages:
                    if asked:
                        time.sleep(self.feed.pause)
                    asked += 1
                    rows = self._page(term, at[term], PAGE)
                    at[term] += len(rows)
                    out += rows
                    if len(rows) < PAGE:
                        break
        except EOFError:  # what came is a batch, the rest is asked for in the next
            pass
        return iter(out), {"read": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802  Spark's name
        """A batch again, after a failure: just the entries it had."""
        for term, (a, b) in enumerate(zip(start["read"], end["read"], strict=True)):
            while a < b:
                rows = self._page(term, a, min(PAGE, b - a))
                if not rows:
                    raise RuntimeError(f"the feed has lost entries {a} to {b} of {self.feed.terms[term]!r}")
                yield from rows
                a += len(rows)


class AtomDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folioflow_atom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return AtomReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802  Spark's name
        return AtomStream(self.options)


def register(spark: SparkSession) -> None:
    """The source, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AtomDataSource)


def stream(spark: SparkSession, terms: list[str], **options: str) -> DataFrame:
    """Entries of the terms as a stream (fetch; pages, pause_s, categories as JSON, after, before)."""
    register(spark)
    return spark.readStream.format("folioflow_atom").options(terms=json.dumps(terms), **options).load()


def _feed(spark: SparkSession, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("folioflow_atom").options(**options).load()


def harvest(spark: SparkSession, terms: list[str], cap: int, known: DataFrame | None = None, **options: str) -> DataFrame:
    """Latest versions of the first `cap` rows over all terms in turn, without the papers of `known` (paper_id); the cap counts rows before versions are merged.

    options: folder or fetch; ordering, categories (JSON), after, before, attempts, pause_s.
    """
    from folioflow.operators.parsing import latest_versions

    first = _feed(spark, terms=json.dumps(terms), cap=str(cap), **options)
    seen = F.row_number().over(Window.partitionBy("paper_id").orderBy("term_pos", "pos"))
    out = latest_versions(first.withColumn("seen", seen)).drop("seen", "primary_category", "term_pos", "pos")
    return out if known is None else out.join(known.select("paper_id"), "paper_id", "left_anti")


def fetched_by_ids(spark: SparkSession, ids: list[str], **options: str) -> DataFrame:
    """The references of known papers, asked for IDS at a time; unknown ids have no row."""
    return _feed(spark, ids=json.dumps(ids), **options).drop("primary_category", "term_pos", "pos")


def by_ids(refs: DataFrame, ids: list[str]) -> DataFrame:
    """The references asked for, in that order; unknown ids have no row."""
    spark = refs.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "ord int, paper_id string")
    return refs.join(F.broadcast(wanted), "paper_id").orderBy("ord").drop("ord")
