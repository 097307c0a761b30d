from __future__ import annotations

from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["p2_found", "p2_clean", "p7_decoded", "p8_found"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from quillgraph.llm import queries

    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want


@pytest.mark.parametrize("name, columns", [("p3_found", ["doc_id", "line_no", "fault"]), ("p5_found", ["doc_id"]), ("p6_found", ["field", "doc_id_a", "doc_id_b"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "line_no", "kind"]), ("p3_paragraphs", None), ("p5_restored", None), ("p6_canonical", None), ("p9_redacted", None)])
def test_query_runs(spark, name, columns):
    from quillgraph.llm import queries

    df = queries.QUERIES[name](spark, str(DATA))
    assert columns is None or df.columns == columns
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows})
