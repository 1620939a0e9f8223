"""Listings of stock exchanges: CSV with a preamble, HTML tables, and their union."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LISTING = "ticker string, name string, country string, exchange string, industry string, path string, position long"


def column_role(header: str) -> str | None:
    """What a column of a listing holds, told from its header."""
    h = header.lower().strip()
    if "code" in h or "ticker" in h or "epic" in h or "symbol" in h:
        return "ticker"
    if "company" in h or h in ("name", "issuer", "instrument name"):
        return "name"
    if "industry" in h or "gics" in h or "sector" in h:
        return "industry"
    return None


def parse_csv_listing(text: str) -> list[dict[str, str]]:
    """Rows of a CSV whose header follows some lines of preamble."""
    lines = text.splitlines()
    start = next((i for i, x in enumerate(lines) if "ASX code" in x or "Company name" in x), 0)
    return _rows(list(csv.reader(io.StringIO("\n".join(lines[start:])))))


class _Tables(HTMLParser):
    """All tables of a page as lists of rows of cells."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def parse_html_listing(html: str) -> list[dict[str, str]]:
    """Rows of the first table of a page with a column of tickers and one of names."""
    parser = _Tables()
    parser.feed(html)
    for table in parser.tables:
        if table and {"ticker", "name"} <= {column_role(h) for h in table[0]}:
            return _rows(table)
    return []


def _rows(table: list[list[str]]) -> list[dict[str, str]]:
    if not table:
        return []
    roles: dict[str, int] = {}
    for i, header in enumerate(table[0]):
        roles.setdefault(column_role(header) or "", i)  # of columns with one role, the first
    roles.pop("", None)
    return [{k: r[i].strip() for k, i in roles.items() if i < len(r)} for r in table[1:] if any(x.strip() for x in r)]


def read_listing(spark: SparkSession, path: str, exchange: str, country: str, form: str = "csv") -> DataFrame:
    """Listings of all files under ``path``, each file parsed whole in one task.

    Rows without a ticker, or with the text nan for one, are dropped; of rows with one
    ticker the first stays.
    """
    parse = {"csv": parse_csv_listing, "html": parse_html_listing}[form]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"], strict=True):
                rows = parse(content.decode("utf-8", "replace"))
                yield pd.DataFrame(
                    [(r.get("ticker"), r.get("name"), country, exchange, r.get("industry"), path, i) for i, r in enumerate(rows)],
                    columns=["ticker", "name", "country", "exchange", "industry", "path", "position"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return first_by_ticker(files.mapInPandas(run, LISTING))


def first_by_ticker(listings: DataFrame, order: tuple[str, ...] = ("path", "position", "name")) -> DataFrame:
    """Listings with a usable ticker, the first row of each by ``order``: pages by their paths, rows by their places in them."""
    usable = listings.withColumn("ticker", F.trim("ticker")).filter("ticker IS NOT NULL AND lower(ticker) NOT IN ('', 'nan')")
    ranked = Window.partitionBy("ticker").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return usable.withColumn("n", F.row_number().over(ranked)).filter("n = 1").drop("n", "path", "position")


def union_listings(listings: list[DataFrame]) -> DataFrame:
    """All listings under one schema; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), listings)
