"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import tagmask.plans.planted  # noqa: F401
from tagmask.plans import queries as dossiers

DIR = entry.SMOKE_DIR


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, name, run, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = run(spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall()
    assert sorted(con.sql(sql).columns) == columns
    assert ordered(df.select(*columns).collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(dossiers.ORACLE_SQL))
def test_against_sql(spark, name):
    compare(spark, name, dossiers.QUERIES[name], dossiers.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(dossiers.QUERIES) - set(dossiers.ORACLE_SQL)))
def test_runs(spark, name):
    assert dossiers.QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_vaults_per_dossier(spark, tmp_path):
    """Every dossier is sealed and opened on its own, with the rounds of production, in the query and in its SQL."""
    for path in glob.glob(f"{DIR}/*.parquet"):
        os.symlink(path, tmp_path / os.path.basename(path))
    os.remove(tmp_path / "customer.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select * from '{DIR}/customer.parquet' where c_custkey in (select o_custkey from '{DIR}/orders.parquet') order by c_custkey limit 5) to '{tmp_path}/customer.parquet' (format parquet)")
    for path in tmp_path.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    dossier_ids = {f"D{k}" for (k,) in con.sql("select c_custkey from customer").fetchall()}
    rounds, write = [], dossiers.vault.write_vault
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dossiers.vault, "write_vault", lambda jsons, password, rounds=0, seen=rounds: (seen.append(rounds), write(jsons, password, rounds))[1])
        got = dossiers.QUERIES["vault_round_trip_whole"](spark, str(tmp_path)).select("dossier_id", "error", "texts", "tags").collect()
    want = con.sql(dossiers.ORACLE_SQL["vault_round_trip_whole"]).fetchall()
    assert rounds == [600_000] and len(dossier_ids) == 5
    assert {r.dossier_id for r in got} == {r[0] for r in want} == dossier_ids
    assert ordered(got) == ordered(want)
