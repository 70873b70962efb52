"""Identifiers and structure strings: the fixed cases, exactly."""

import hashlib

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import ids


def parsed(spark, items, **std):
    std = {"std_key": "STD", "name": "ISO 26262", "year": "2018", "original_year": 2011, "digits": 11, "part_shift": 0, "part_digits": 0} | std
    df = spark.createDataFrame([(*std.values(), items)], [*std, "items"])
    rows = ids.parse_items(ids.expand_items(df)).orderBy("ord").collect()
    return rows


def test_ranges_expand_in_order(spark):
    rows = parsed(spark, "1-r4.{1..3} 2-5 3-1.{1..2}.{4..3}")
    assert [r.clause_id.split(" ")[-1] for r in rows] == ["4.1", "4.2", "4.3", "5", "1.1.4", "1.1.3", "1.2.4", "1.2.3"]
    assert [r.type for r in rows][:4] == ["r", "r", "r", "u"] and rows[0].std_part == "-1"
    assert rows[0].hash == hashlib.md5(b"ISO 26262-1:2018 4.1").hexdigest() and rows[0].legacy_hash == hashlib.md5(b"ISO 26262:2011-1 4.1").hexdigest()


def test_wide_segments(spark):
    assert [r.uid for r in parsed(spark, "1-t3.+{1..2}", part_digits=2, digits=12)] == ["010300100000", "010300200000"]


def test_annex_with_type_and_number(spark):
    (r,) = parsed(spark, "2-9:mA.1", part_shift=1)
    assert (r.type, r["index"], r.level, r.uid) == ("m", "A.1", "3.9.1", "30A01000000")


def test_supplement_part(spark):
    (r,) = parsed(spark, "3§1-2", part_shift=1)
    assert (r.std_part, r.uid, r.level, r.clause_id) == ("-3-1", "30200000000", "3.2", "ISO 26262-3-1:2018 2")


def test_colliding_uids_are_reported(spark):
    df = spark.createDataFrame([("S", "N 1", "2025", 0, 12, 0, 0, "r7.2.2.4.1 r7.2.2.4.10")], "std_key string, name string, year string, original_year int, digits int, part_shift int, part_digits int, items string")
    rows = ids.parse_items(ids.expand_items(df))
    (c,) = ids.uid_collisions(rows).collect()
    assert c.uid == "070202041000" and len(c.clause_ids) == 2
    assert {r.clause_id[-1]: r.warning for r in rows.collect()} == {"1": None, "0": "multi-digit sub-level"}


def test_too_many_levels_warn(spark):
    (r,) = parsed(spark, "1.1.1.1.1.1.1", digits=30)
    assert r.warning == "too many levels" and r["index"] == "1.1.1.1.1.1"


IDS = ["IEC 61508-1:2010 7.2.1", "EN 50129:2018 ZZ", "ISO PAS 8926:2024 4", "IEC 61508-0:2005 0", "ISO/TS 5083:2025 1", "IEC 61508-3-1:2016 1", "", None]


def test_row_ids_and_clause_ids(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "c string")
    rows = df.select(ids.row_id_parts(F.col("c")).alias("r"), ids.clause_id_parts(F.col("c")).alias("k")).collect()
    assert [tuple(r.r) for r in rows[:4]] == [("IEC 61508", "1", "7.2.1"), ("EN 50129", "", "Z"), ("ISO PAS 8926", "", "4"), (None, None, None)]
    assert [tuple(r.k) for r in rows[:4]] == [("IEC61508", "1", "7.2.1", 3), ("EN50129", "", "ZZ", 1), ("ISOPAS8926", "", "4", 1), ("IEC 61508-0:2005 0", "", "0.0", 0)]
    assert rows[4].r.series is None and rows[5].r.series is None


def test_generic_ids(spark):
    row = spark.range(1).select(ids.clause_id_parts(F.lit("Guide-2-A.1"), generic=True).alias("k"), ids.parent_path(F.lit("A.1.2")).alias("p"), ids.parent_path(F.lit("A")).alias("q"), ids.parent_id(F.lit("A"), F.lit(1)).alias("n")).first()
    assert tuple(row.k) == ("Guide", "2", "A.1", 2) and (row.p, row.q, row.n) == ("A.1", "A", None)


def test_context_and_natural_order(spark):
    df = spark.createDataFrame([(c,) for c in ("10", "2", "A.1", "2.10", "2.9", "1")], "c string")
    assert [r.c for r in df.orderBy(ids.natural_key(F.col("c"))).collect()] == ["1", "2", "2.9", "2.10", "10", "A.1"]
    row = spark.range(1).select(*[ids.context_sentence(F.lit("t"), F.lit(k), F.lit("P"), F.lit("T")).alias(f"c{k}") for k in range(3)]).first()
    assert tuple(row) == ("is top level content", 'is a subclause of clause "P"', 'is contained in subclause "P" under "T"')


@pytest.mark.parametrize("basic", [False, True])
def test_titles(spark, basic):
    items = ids.parse_items(ids.expand_items(spark.createDataFrame([("S", "N 12345", "2020", 2010, 8, 0, 0, "r1.{1..4} u2")], "std_key string, name string, year string, original_year int, digits int, part_shift int, part_digits int, items string")))
    h = lambda c, y=2020: hashlib.md5(f"N 12345:{y} {c}".encode()).hexdigest()
    toc = spark.createDataFrame([("S", h("1.1"), "Alpha", "r", False), ("S", h("1.2"), "Beta", "R", False), ("S", h("1.3", 2010), "Old", "r", False), ("S", h("1.1"), "Other", "o", False)], "std_key string, hash string, heading string, marker string, is_local boolean")
    texts = spark.createDataFrame([("S", h("1.1"), "Head", 'A "b"~c', False), ("S", h("1.4"), "Line", "", False)], "std_key string, hash string, headline string, text string, is_local boolean")
    rows = {r["index"]: r for r in ids.join_titles(items, toc, texts, basic=basic, readable=True).collect()}
    assert rows["1.1"].text == "    A b\n    c" and rows["1.1"].title in ("Alpha", "Other")
    assert rows["1.2"].title == ("REQUIREMENT" if basic else "Beta") and rows["1.3"].title == "Old" and rows["1.4"].title == "Line"
    assert rows["2"].title == "TOC" and rows["2"].locator == "N 12345:2020 2" and rows["1.2"].header == rows["1.2"].title[:40]


def test_local_titles_replace_all_others(spark):
    items = ids.parse_items(ids.expand_items(spark.createDataFrame([("S", "N 12345", "2020", 2010, 8, 0, 0, "r1 r2")], "std_key string, name string, year string, original_year int, digits int, part_shift int, part_digits int, items string")))
    h = lambda c: hashlib.md5(f"N 12345:2020 {c}".encode()).hexdigest()
    toc = spark.createDataFrame([("S", h("1"), "Data", "r", False), ("S", h("2"), "Data", "r", False), ("S", h("1"), "Mine", "o", True)], "std_key string, hash string, heading string, marker string, is_local boolean")
    texts = spark.createDataFrame([("S", h("2"), "H", "T", False)], "std_key string, hash string, headline string, text string, is_local boolean")
    rows = {r["index"]: r for r in ids.join_titles(items, toc, texts).collect()}
    assert (rows["1"].title, rows["1"].marker, rows["1"].marker_mismatch) == ("Mine", "r", True)
    assert rows["2"].title == "H" and rows["2"].text == "    T"
