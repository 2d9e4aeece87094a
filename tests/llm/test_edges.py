"""Every query of the subpackage on empty tables and on odd rows: nulls in every column, empty and very long texts, repeated rows, extra columns."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from derlemspark.llm import queries as Q
from derlemspark.session import table

SF = "/root/testdata/sf0.001"
TABLES = ("birimler", "birim_iletisim_tablosu", "page_results", "static_slugs_output", "test_seed", "documents", "eval_items", "reading_labels")
IDS = {"birim_iletisim_tablosu": "kayit_id", "page_results": "page_id", "static_slugs_output": "slug_page_id", "test_seed": "seed_id", "documents": "doc_id", "eval_items": "item_id", "reading_labels": "label_id"}
TEXTS = {"birim_iletisim_tablosu": "adres", "page_results": "body_content", "static_slugs_output": "content_preview", "test_seed": "content", "documents": "text", "eval_items": "passage"}
LONG = ("Uzun metin sürer ve bir yerde biter. " * 12 + "\n") * 300


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        table(spark, SF, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small tables with odd rows: all null but the id, an empty, a white, a very long and a repeated text; columns with clashing names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    for name in TABLES:
        t = table(spark, SF, name)
        if name in IDS:
            key, text = IDS[name], TEXTS.get(name)
            nulls = t.select(*[(F.lit(900_000) + F.row_number().over(Window.orderBy(key))).cast(f.dataType).alias(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema.fields]).limit(3)
            more = [nulls]
            for k, value in enumerate(("", " \n\t ", LONG, "aynı metin " * 30, "aynı metin " * 30)):
                if text:
                    row = t.orderBy(key).limit(1)
                    more.append(row.withColumn(key, F.lit(910_000 + k).cast(t.schema[key].dataType)).withColumn(text, F.lit(value)))
            for m in more:
                t = t.unionByName(m)
        for clash in ("line_no", "tbl", "rec_id", "n", "site", "key", "level", "fold", "class", "copy", "h", "item", "doc"):
            if clash not in t.columns and name != "birimler":
                t = t.withColumn(clash, F.lit("x"))
        t.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return folder


#: One query for each operator; the others only project or filter these.
BASES = ("p1_found", "p2_residue", "p3_bodies", "p3_found", "p4_restored", "p5_found", "p6_found", "p7_pieces", "p8_ids", "p9_overlaps", "p10_levels")


@pytest.mark.parametrize("name", BASES)
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", BASES)
def test_odd_rows(spark, odd, name):
    df = Q.queries()[name](spark, odd)
    rows = df.collect()
    if name == "p8_ids":
        by = {r["doc_id"]: r["ids"] for r in rows}
        assert len(rows) == 108 and by[900_001] == [] and by[910_000] == []
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
        assert not [r for r in rows if any(isinstance(v, int) and 900_000 < v <= 900_003 for v in r)]
    if name == "p7_pieces":
        assert {r["n_pieces"] for r in rows if r["rec_id"] == 910_000} == {1} and max(len(r["piece"]) for r in rows) <= 1200
    if name == "p5_found":
        assert ("test_seed", 910_003, 910_004) in {tuple(r) for r in rows}
    if name == "p10_levels":
        assert {r["doc_id"]: r["reading_level"] for r in rows}[910_000] is None


def test_stated_columns(spark, empty):
    for name, columns in (("p1_found", ["kayit_id_a", "kayit_id_b"]), ("p3_found", ["page_id", "line_no"]), ("p7_found", ["tbl", "rec_id"]), ("p8_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "item_id"])):
        assert Q.queries()[name](spark, empty).columns == columns
