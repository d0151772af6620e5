import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from parity import plain
from quirestack.plans import registry

DATA = Path("/root/testdata/sf0.001")
SAMPLE = ["paper_counts", "ancestors_of_block", "nearest_float", "first_claim_union", "heading_parents", "knn_in_partition", "violations_by_rule", "p2_found", "nest_round_trip", "stream_window_counts", "cap_gate"]


def test_names():
    assert set(registry.sql()) <= set(registry.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = registry.queries()[name](spark, str(DATA))
    cur = con.execute(registry.sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(([tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall()]), key=repr)
    got = sorted([tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()], key=repr)
    assert sorted(df.columns) == sorted(names) and got == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_core_does_not_import_the_text_operators():
    root = Path(__file__).resolve().parents[1] / "quirestack"
    for p in root.rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p
