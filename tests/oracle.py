"""Compare queries with their SQL: ``python tests/oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df, relation) -> str:
    """'' if equal, else what differs."""
    names = sorted(df.columns)
    expected_names = sorted(relation.columns)
    if names != expected_names:
        return f"columns {names} against {expected_names}"
    types = {d[0]: str(d[1]) for d in relation.description}
    got = _sorted(tuple(_cell(v) for v in r) for r in df.select(*names).collect())
    want = _sorted(tuple(_cell(v) for v in r)
                   for r in relation.select(*[f'"{n}"' for n in names]).fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; {got[:2]} / {want[:2]}"
    if got != want:
        at = next(i for i, (a, b) in enumerate(zip(got, want)) if a != b)
        n = sum(a != b for a, b in zip(got, want))
        return f"{n} rows differ, first {got[at]} against {want[at]}"
    spark_types = dict(df.dtypes)
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}
    odd = {n: (spark_types[n], types.get(n)) for n in names
           if types.get(n) and pairs.get(spark_types[n]) != types[n].upper()}
    return f"types {odd}" if odd else ""


def main() -> int:
    import __spark_entry__ as entry
    from flowlake.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    conf = {}
    if os.environ.get("KEEP_SLICES"):
        conf["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    spark, con = local_session(**conf), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in chosen or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                verdict = compare(df, con.sql(oracles[name]))
            else:
                verdict = "" if df.count() else "no rows"
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(verdict)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if verdict else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {verdict}",
              flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
