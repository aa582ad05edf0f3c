"""Each registered query of the engine against its SQL, row for row, and the entry point without the llm folders."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from winnower.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def _text(rows) -> list[str]:
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = catalog.ORACLE_SQL[name]
    assert sorted(x[0] for x in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description) == columns
    wanted = con.execute("SELECT " + ", ".join(f'CAST("{c}" AS VARCHAR)' for c in columns) + f" FROM ({sql})").fetchall()
    assert _text(df.select(*(df[c].cast("string") for c in columns)).collect()) == _text(wanted)


def test_default_parameters_reach_the_known_counts(spark, sf):
    dups = [r.doc_id for r in catalog.QUERIES["dedup_default"](spark, sf).filter("flag = 'D'").collect()]
    assert (len(dups), sum(dups)) == (24, 3180)
    assert sorted(dups)[:8] == [53, 55, 56, 61, 67, 78, 92, 110]


def test_entry_point_imports_without_the_llm_folders():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['winnower.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and 'dedup_default' in e.queries()\n"
        "assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
