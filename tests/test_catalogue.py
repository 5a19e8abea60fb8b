"""Every registered query with SQL gives the rows of its SQL."""

import decimal

import duckdb
import pytest

from siltline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal | float) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(name, spark, duck, sf_dir):
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    expected = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=str)
    found = catalogue.queries()[name](spark, sf_dir).toArrow()
    assert sorted(found.column_names) == sorted(names)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in found.to_pylist()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_cluster_components_are_those_of_a_union_find(spark, sf_dir):
    rows = duckdb.sql(f"SELECT l_orderkey, l_partkey, l_linenumber FROM '{sf_dir}/lineitem.parquet'").fetchall()
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    first = {}
    for order, part, line in rows:
        a, b = find(order), find(first.setdefault((part, line), order))
        group[max(a, b)] = min(a, b)
    members = {}
    for order in list(group):
        members.setdefault(find(order), []).append(order)
    expected = sorted((k, len(v), max(v)) for k, v in members.items())
    assert sorted(tuple(r) for r in catalogue.queries()["cluster_components"](spark, sf_dir).select("component", "roots", "last").collect()) == expected


def test_folds_are_those_of_a_loop(spark, sf_dir):
    ranges = duckdb.sql(f"""SELECT o_custkey % 200 AS dev, (o_orderkey * 131) % 100000 AS a, (o_orderkey * 131) % 100000 + CAST(floor(o_totalprice) AS BIGINT) % 1500 + 1 AS b FROM '{sf_dir}/orders.parquet'
        ORDER BY dev, a, b""").fetchall()
    windows, now, seen, reach = [], None, None, 0
    for dev, a, b in ranges:
        if now and seen == dev and a - reach <= 16 and max(now[2], b) - now[1] <= 4000:
            now[2], now[3] = max(now[2], b), now[3] + 1
        else:
            now = [dev, a, b, 1]
            windows.append(now)
        reach, seen = (max(reach, b), dev) if seen == dev else (b, dev)
    found = catalogue.queries()["capped_windows_fold"](spark, sf_dir).select("dev", "start", "end", "n").collect()
    assert sorted(tuple(r) for r in found) == sorted(map(tuple, windows))
    files = duckdb.sql(f"SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) FROM '{sf_dir}/orders.parquet' ORDER BY 1, 2").fetchall()
    expected, last, batch, total = [], None, 0, 0
    for key, file, size in files:
        if key != last:
            last, batch, total = key, 0, 0
        expected.append((key, file, batch))
        total += size
        if total >= 300000:
            batch, total = batch + 1, 0
    found = catalogue.queries()["batches_on_disk_order"](spark, sf_dir).select("o_custkey", "file", "batch").collect()
    assert sorted(tuple(r) for r in found) == sorted(expected)
