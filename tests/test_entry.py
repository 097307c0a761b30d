from __future__ import annotations

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def normal(rows) -> list:
    def f(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(f, v))
        return v

    return sorted((tuple(map(f, r)) for r in rows), key=repr)


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def core_sql() -> list[str]:
    from quillgraph import queries

    return sorted(queries.SQL)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", core_sql())
def test_query_equals_its_sql(spark, name):
    import duckdb

    from quillgraph import queries

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    cur = con.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert normal(got) == normal(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["p4_found", "p4_columns", "p4_nodes", "title_alignment", "sequence_alignment", "formula_compare", "anchor_agreement", "pair_verdict", "fingerprint", "binding_states"])
def test_query_without_sql_runs(spark, name):
    from quillgraph import queries

    df = queries.QUERIES[name](spark, str(DATA))
    assert len(df.columns) > 0
    df.collect()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["content_similarity", "assign_rungs", "positional_support", "rung_histogram", "match_confidence"])
def test_scores_broadcast_pairs_of_books_alone(spark, name):
    from quillgraph import queries

    plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == plan.count("Window [lead(")
