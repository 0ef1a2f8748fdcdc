"""Run the registered queries beside their SQL and report differences.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame


def _canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, cells as text, rows sorted."""
    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "∅"
        if isinstance(value, pd.Timestamp):
            return value.isoformat()
        if isinstance(value, float):
            return repr(value)
        return str(value)

    columns = sorted(frame.columns)
    texts = pd.DataFrame({c: [cell(v) for v in frame[c].astype(object)] for c in columns})
    return texts.sort_values(columns, ignore_index=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else what is wrong."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows != {len(sql_frame)}"
    ours, theirs = _canonical(spark_frame), _canonical(sql_frame)
    unequal = (ours != theirs).any(axis=1)
    if unequal.any():
        row = unequal.idxmax()
        pairs = [
            f"{c}: {str(ours.at[row, c])[:200]!r} != {str(theirs.at[row, c])[:200]!r}"
            for c in ours.columns
            if ours.at[row, c] != theirs.at[row, c]
        ]
        return f"{int(unequal.sum())} rows differ, first: " + "; ".join(pairs)
    return None


_SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def check(query: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Row count of the query and what differs from the SQL: types or values."""
    ours, relation = query.toPandas(), connection.sql(sql)
    types = {f.name: _SQL_TYPES[f.dataType.simpleString()] for f in query.schema}
    expected = dict(zip(relation.columns, map(str, relation.types)))
    if types != expected:
        return len(ours), f"types {sorted(types.items() ^ expected.items())}"
    return len(ours), difference(ours, relation.df())


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def main(sf_dir: str, chosen: list[str]) -> int:
    from checks.oracle import all_oracles
    from checks.queries import all_queries
    from stormlake.session import build_session

    spark = build_session("compare", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = connect(sf_dir), all_oracles(), 0
    for name, run in all_queries().items():
        if chosen and name not in chosen:
            continue
        begun = time.time()
        try:
            rows, wrong = check(run(spark, sf_dir), connection, oracles[name])
            spent = time.time() - begun
            print(f"{'FAIL' if wrong else 'ok  '} {name} rows={rows} {spent:.1f}s {wrong or ''}", flush=True)
        except Exception as error:
            wrong = error
            print(f"FAIL {name} {str(error)[:600]}", flush=True)
        failed += bool(wrong)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
