import pytest
from oracle import assert_same, connection

from sparrowplan import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert_same(df, connection(SF), catalog.SQL[name])
    else:
        assert df.count() > 0
