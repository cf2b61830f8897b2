"""Every query with SQL against DuckDB over the small tables; the others run."""

import duckdb
import pytest
from scriptorium.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        rows = lambda rs: sorted((tuple(plain(r[n] if hasattr(r, "asDict") else r[i]) for i, n in enumerate(names)) for r in rs), key=repr)
        assert rows(got) == rows(found.fetchall())


def test_marked_lines_of_capitals_with_accents(spark, tmp_path):
    """Such capitals are signs of a legacy font: a text full of them is looked at, not converted, and its edits keep their lines."""
    texts = ["Uno.\nOSÓ!! DOÑ!! CIÓNMIÓÓ,!! QUEÓ\nDos.", "ÓÓ ,ÓÓ\n\nÓÓ  ÓÓ\nÓÓ", "ÓÓÓÓ", "plain !!\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["marked_lines"](spark, str(tmp_path)).select("doc_id", "n_lines", "n_marked").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(ORACLE_SQL["marked_lines"]).fetchall()) == [(0, 3, 1), (1, 4, 2), (2, 1, 0), (3, 2, 1), (4, 1, 0)]
