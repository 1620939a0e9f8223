import datetime

import pytest

COMPANY = "rec_id long, name string, name_norm string, country string, lei string, wikidata_qid string, aliases string, address string, city string, postal_code string, source string, updated_at timestamp_ntz, loaded_at timestamp_ntz"
FIELDS = [x.split()[0] for x in COMPANY.split(", ")]
ALIASES = [("US", "US", "USA", "840"), ("USA", "US", "USA", "840"), ("GB", "GB", "GBR", "826"), ("DE", "DE", "DEU", "276")]


@pytest.fixture(scope="session")
def companies(spark):
    """A maker of company tables from dicts; missing fields are null. An extra column must not disturb."""

    def make(*rows):
        data = [tuple(r.get(f) for f in FIELDS) + (i,) for i, r in enumerate(rows)]
        return spark.createDataFrame(data, COMPANY + ", form int")

    return make


@pytest.fixture(scope="session")
def country_aliases(spark):
    return spark.createDataFrame(ALIASES, "alias string, iso2 string, iso3 string, numeric string")


@pytest.fixture(scope="session")
def day():
    return lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
