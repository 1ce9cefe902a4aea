"""Queries give DuckDB's rows on inputs that the small tables have not."""

import datetime
import random

import pytest

import __spark_entry__


def both(spark, at, name, rows, schema, query):
    """The query's rows and its SQL's over a table of these rows."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
    got = __spark_entry__.queries()[query](spark, str(at))
    want = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[query]})").fetchall()
    return sorted((tuple(r) for r in got.collect()), key=str), sorted(want, key=str)


def test_concurrency(spark, tmp_path):
    # .29 * 60000 is just below 17400: such an event ends at 17.4 s, not at 17.399; halves of a millisecond go to the even one; null times come last
    begins, us = datetime.datetime(2024, 1, 1), datetime.timedelta(microseconds=1)
    rows = [(0, begins, 0, 0.29), (1, begins + 17_399_500 * us, 10, 1.0), (2, begins + 17_400_000 * us, 20, 0.5 / 60000), (3, begins + 17_400_500 * us, 0, 1.5 / 60000), (4, begins + 17_402_000 * us, 0, 2.5 / 60000), (5, begins + 17_404_500 * us, 0, 1.0), (6, begins, 0, None), (7, None, 0, 1.0), (8, begins, 3, 1.0)]
    schema = "event_id long, ts timestamp_ntz, user_id long, value double"
    got, want = both(spark, tmp_path, "events", rows, schema, "concurrency")
    assert got == want and len(want) == 9
    assert (0, 1, 3, True) in got


DOCUMENTS = "doc_id long, text string"


def test_pii_mask(spark, tmp_path):
    rnd = random.Random(8)
    parts = ["a", "b.c", "x@y.com", "@", "_", ".", "-", "%", " ", "é", "m@n.org_", "q@r.co.uk1", "z@w.c", "13812345678", "110101199003070011", "\n", "$1", "A@B.Cd@e.fg"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "a@b.com_x@c.org"), (1003, "tel 13812345678"), (1004, "a" * 200_000 + " " + "x@" + "b" * 200_000)]
    got, want = both(spark, tmp_path, "documents", rows, DOCUMENTS, "pii_mask")
    assert got == want and len(want) == 605


def test_section_assembly(spark, tmp_path):
    rows = [(1, "\n".join(f"heading {i}\n{'body ' * 12}" for i in range(1203))), (2, "one\ntwo\n\nthree"), (3, None), (4, "long " * 20)]
    got, want = both(spark, tmp_path, "documents", rows, DOCUMENTS, "section_assembly")
    assert got == want and (1, "S100", 2 + 20, 198) in got
