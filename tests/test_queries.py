"""Every query with SQL gives the rows that its SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from clauseloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", list(plans.SQL))
def test_query(spark, duck, name):
    df = plans.Q[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(plans.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


def test_generated_headings_of_every_letter_with_a_case(spark, tmp_path):
    """One character to one, with no expansion (ß, ﬁ), no title case, no final sigma; number signs are no letters."""
    chars = [c for c in map(chr, range(0x20, 0x110000)) if c.upper() != c.lower() or c.isalnum() and not c.isalpha()] + ["\U0002ebf0", "\u0e33", None]
    texts = [c and f"{c}abc abc{c}def abcd{c} {c}abc {c * 4}" for c in chars] + ["ßein nicht ßein", "ΟΔΟΣ ΟΔΟΣ οδοσ οδος", "ab²cd x²word½four Ⅳword", "", "abc"]
    docs = duckdb.connect()
    docs.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    docs.execute("INSERT INTO documents SELECT unnest(range(len(?::VARCHAR[]))), unnest(?::VARCHAR[])", [texts, texts])
    docs.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = {r.clause_id: r.heading for r in plans.generated_headings(spark, str(tmp_path)).collect()}
    assert got == {i: h for i, h, _, _ in docs.execute(plans.SQL["generated_headings"]).fetchall()}
    assert [got.get(str(len(chars) + k)) for k in range(5)] == ["ẞein Nicht", "Οδοσ Οδος", "Word Four", None, None]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
