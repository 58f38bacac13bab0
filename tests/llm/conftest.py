import duckdb
import pytest

TABLES = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 700} and{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra
    columns named like those the operators make."""
    poem = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [
        (1, poem, "en", "src0", 1),
        (1, poem, "en", "src0", 1),
        (2, poem, None, "src1", 2),
        (3, None, "en", "src2", None),
        (4, "", "en", None, 0),
        (5, " \t\n ", "de", "src3", 4),
        (6, "123 456 !!", "en", "src0", 10),
        (None, poem + " again", "en", "src0", 1),
        (None, None, None, None, None),
        (7, LONG, "en", "src1", len(LONG)),
        (8, "ein kurzer Satz über Bäume", "de", "src1", 26),
        (9, poem.upper(), "en", "src9", 5),
    ]
    df = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    names = (
        "shard slot score tokens n_tokens epoch row fold band root seed item_id size key full rest"
        " last_key last_tokens leaf_budget taken_tokens level0 whole from to base piece file at old low"
        " other terms toxic _from _to _base _size _piece _file _at _old _key cell side id copy vec h1"
    )
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"x-{n}").alias(n) for n in names.split()))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture
def same_as_sql(spark):
    """Compares a query over the smallest tables with its SQL, columns by name."""

    def check(query, sql, *tables):
        con = duckdb.connect()
        for table in tables:
            con.execute(f"create view {table} as from '{TABLES}/{table}.parquet'")
        df = query(spark, TABLES)
        result = con.execute(sql)
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        want = [tuple(row[columns.index(c)] for c in df.columns) for row in result.fetchall()]
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))

    return check
