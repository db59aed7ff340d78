"""Work that is dear for each row isn't left to the one task that a small file is read by."""

import pytest
from pyspark.sql import functions as F

from formloom import catalogue_queries as c
from formloom.session import load, spread

SF = "/root/testdata/sf0.01"


def sizes(df):
    """Rows of each partition of a query's result."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_spread_is_even_and_whole(spark):
    table = load(spark, SF, "customer")
    assert len(sizes(table)) == 1
    dealt = sizes(spread(table))
    assert len(dealt) == 4 and dealt[-1] - dealt[0] <= 4 and sum(dealt) == table.count()
    assert spread(table).exceptAll(table).isEmpty()


@pytest.mark.parametrize("name", ["record_json", "form_record_flat", "form_record_long", "form_record_nested", "form_name_fallback"])
def test_forms_are_spread(spark, name):
    dealt = sizes(c.QUERIES[name](spark, SF))
    assert len(dealt) == 4 and dealt[0] > 0.9 * dealt[-1]
