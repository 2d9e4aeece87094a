import pytest

from derlemspark.llm import queries as Q
from derlemspark.llm import sql

from ..duck import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_equals_duckdb(spark, name):
    same(Q.queries()[name](spark, SF), connect(SF), sql.oracle_sql()[name])


def test_reading_levels_on_held_out_ratings(spark):
    """Fitted on the ratings of three quarters of the documents; nine tenths of the others within the raters' noise."""
    from derlemspark.llm import reading
    from derlemspark.session import table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "reading_labels").filter("reading_level is not null")
    model = reading.fit(docs, labels.filter("doc_id % 4 <> 0"))
    got = reading.levels(docs, model).join(labels.filter("doc_id % 4 = 0").withColumnRenamed("reading_level", "rated"), "doc_id").filter("reading_level is not null").collect()
    assert sum(r["reading_level"] == r["rated"] for r in got) >= 0.8 * len(got)
    assert sum(abs(r["reading_level"] - r["rated"]) <= 1 for r in got) >= 0.97 * len(got)
