"""Registry records (LEI): nested JSON pages, flat Level-1 CSV files, and a paged data source."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinspark.functions.normalize import join_address

PAGE_SCHEMA = (
    "data array<struct<attributes struct<lei string, entity struct<legalName struct<name string>, "
    "legalAddress struct<country string, city string, postalCode string, addressLines array<string>>, status string>, "
    "registration struct<status string>>>>"
)
FLAT_SCHEMA = "lei string, name string, country string, city string, postal_code string, address string, status string"
#: Columns of the Level-1 CSV files.
LEVEL1_COLUMNS = {
    "LEI": "lei",
    "Entity.LegalName": "name",
    "Entity.LegalAddress.Country": "country",
    "Entity.LegalAddress.City": "city",
    "Entity.LegalAddress.PostalCode": "postal_code",
    "Registration.RegistrationStatus": "status",
    "Entity.RegistrationAuthority.RegistrationAuthorityID": "registration_authority",
    "Entity.RegistrationAuthority.RegistrationAuthorityEntityID": "registration_id",
}


def flatten_pages(pages: DataFrame) -> DataFrame:
    """One flat row a record of API pages in PAGE_SCHEMA. Blank addresses are null."""
    a = pages.select(F.explode("data.attributes").alias("a"))
    where = F.col("a.entity.legalAddress")
    return a.select(
        F.col("a.lei").alias("lei"),
        F.col("a.entity.legalName.name").alias("name"),
        where["country"].alias("country"),
        where["city"].alias("city"),
        where["postalCode"].alias("postal_code"),
        join_address(where["addressLines"]).alias("address"),
        F.col("a.entity.status").alias("status"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``flatten_pages`` of a folder of JSON pages."""
    return flatten_pages(spark.read.schema(PAGE_SCHEMA).option("multiLine", True).json(path))


def normalize_level1(df: DataFrame) -> DataFrame:
    """Level-1 columns under our names; the address from its lines; lei, name and country always there."""
    lines = [c for c in df.columns if "AddressLine" in c or "Address.Line" in c]
    if lines and "address" not in df.columns:
        parts = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in lines])
        df = df.withColumn("address", F.trim(F.array_join(parts, " ")))
    df = df.withColumnsRenamed(LEVEL1_COLUMNS)
    return df.withColumns({c: F.lit(None).cast("string") for c in ("lei", "name", "country") if c not in df.columns})


def read_level1(spark: SparkSession, path: str) -> DataFrame:
    return normalize_level1(spark.read.option("header", True).csv(path))


class PagedRegistry(DataSource):
    """``spark.read.format("paged_registry")``: pages of a registry, one partition a run of pages.

    Options: ``path``, a folder of page_<n>.json files; ``pages_per_partition`` (10);
    ``max_records``. All pages that are there are read, whatever their numbers, so an
    interrupted download is read as far as it came and resumed by adding files.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_registry"

    def schema(self) -> str:
        return FLAT_SCHEMA

    def reader(self, schema: T.StructType) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.per = int(options.get("pages_per_partition", "10"))
        self.most = int(options["max_records"]) if "max_records" in options else None

    def partitions(self) -> list[InputPartition]:
        pages = sorted(Path(self.folder).glob("page_*.json"), key=lambda p: (len(p.name), p.name))
        return [InputPartition(tuple(map(str, pages[i : i + self.per]))) for i in range(0, max(len(pages), 1), self.per)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for file in map(Path, partition.value):
            for item in json.loads(file.read_text())["data"]:
                a = item.get("attributes") or {}
                entity = a.get("entity") or {}
                where = entity.get("legalAddress") or {}
                address = " ".join(where.get("addressLines") or []).strip() or None
                yield (a.get("lei"), (entity.get("legalName") or {}).get("name"), where.get("country"), where.get("city"), where.get("postalCode"), address, entity.get("status"))


def read_paged(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Records of a folder of pages through the data source, the first ``max_records`` by LEI if given."""
    spark.dataSource.register(PagedRegistry)
    df = spark.read.format("paged_registry").option("path", path).load()
    return df.orderBy("lei").limit(max_records) if max_records else df
