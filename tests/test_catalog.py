import pytest

from geneloom.plans import catalog
from tests.oracle import DATA, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, DATA), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    frame = catalog.QUERIES[name](spark, DATA)
    assert frame.count() > 0 and frame.columns


def rows_of(con, sql):
    return con.execute(sql).fetchall()


def test_containment_of_all_lineitems(spark, con):
    parts: dict = {}
    for key, size in rows_of(con, "SELECT p_partkey, p_size FROM part ORDER BY p_partkey"):
        parts.setdefault(key % 50, []).append((key, size / 10, size + 10))
    rows = set(rows_of(con, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem"))
    expected = sorted((*map(float, r), next((key for key, low, high in parts.get(r[2] % 50, ()) if r[3] >= low and r[4] <= high), -1)) for r in rows)
    found = catalog.QUERIES["interval_containment_first"](spark, DATA).collect()
    assert sorted((*map(float, r[:6]), -1 if r[6] is None else r[6]) for r in found) == expected
    assert len({r[0] % 10 for r in found}) == 10


def test_containment_of_odd_rows(spark, tmp_path):
    """Sizes below zero, so that intervals end before rows start or before they start themselves, nulls, repeated rows, very large sizes."""
    con = connect()
    con.execute(f"""COPY (SELECT CAST(i // 9 AS BIGINT) AS p_partkey, CAST(CASE WHEN i % 11 = 0 THEN NULL WHEN i % 7 = 0 THEN 100000000 + i ELSE i * 37 % 61 - 50 END AS INTEGER) AS p_size FROM range(1800) r(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT CAST(i // 2 AS BIGINT) AS l_orderkey, CAST(i % 5 AS BIGINT) AS l_partkey, CAST(CASE WHEN i % 31 = 0 THEN NULL ELSE i % 300 - 100 END AS BIGINT) AS l_suppkey, CAST(CASE WHEN i % 29 = 0 THEN NULL ELSE i % 9 END AS INTEGER) AS l_linenumber,
        CASE WHEN i % 23 = 0 THEN NULL WHEN i % 19 = 0 THEN 5e7 ELSE i * 17 % 120 - 60 END + 0.5 AS l_quantity, 1.5 AS l_extendedprice FROM (SELECT i % 1500 AS i FROM range(2000) r(i))) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    for name in ("part", "lineitem"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    same(catalog.QUERIES["interval_containment_first"](spark, str(tmp_path)), con, catalog.ORACLE_SQL["interval_containment_first"])


def test_pairs_of_all_nations(spark, con, tmp_path):
    """Three suppliers a nation, so that every pair of nations has links."""
    con.execute(f"COPY nation TO '{tmp_path}/nation.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS s_suppkey, CAST((i * 7) % 25 AS INTEGER) AS s_nationkey FROM range(75) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    members = {n: [i for i in range(75) if i * 7 % 25 == n] for n in range(25)}
    expected = {(x, y, 3 * i + j) for a in range(25) for b in range(a + 1, 25) for i, x in enumerate(members[a]) for j, y in enumerate(members[b])}
    found = catalog.QUERIES["gene_cross_pairs"](spark, str(tmp_path)).collect()
    assert len(found) == len(expected) == 2700 and {tuple(r) for r in found} == expected


def lowest(pairs) -> dict:
    """The least node that each node of an edge reaches."""
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


ALL_EDGES = "SELECT DISTINCT l_suppkey, l_partkey + 1000000 FROM lineitem"


def test_components_of_all_lineitems(spark, con):
    found = {r["node"]: r["component"] for r in catalog.QUERIES["components_all"](spark, DATA).collect()}
    assert found == lowest(rows_of(con, ALL_EDGES))


def test_function_groups_of_all_lineitems(spark, con):
    pairs = rows_of(con, ALL_EDGES)
    root = lowest(pairs + [(-1 - a % 5, a) for a, _ in pairs])
    label: dict = {}
    for x in root:
        if x < 0:
            label[root[x]] = min(label.get(root[x], 9), -1 - x)
    found = sorted(tuple(r) for r in catalog.QUERIES["function_groups_all"](spark, DATA).select("gene_id", "label").collect())
    assert found == sorted((str(x), f"F{label[root[x]]}") for x in root if x >= 0)


def test_greedy_groups_take_all_lineitems(spark, con):
    """A plain list of groups for each flag."""
    held: dict = {}
    for flag, supplier, part, tax in rows_of(con, "SELECT l_returnflag, l_suppkey, l_partkey, l_tax FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"):
        if tax * 10 >= 0.3:
            own, last = held.setdefault(flag, ([], {}))
            ends = {f"s{supplier}", f"p{part}"}
            at = next((i for i, g in enumerate(own) if g & ends), len(own))
            own[at:] = [(own[at] if at < len(own) else set()) | ends, *own[at + 1 :]]
            last.update(dict.fromkeys(ends, at))
    expected = {(flag, gene): n for flag, (_, last) in held.items() for gene, n in last.items()}
    assert {(r["alignment_id"], r["gene_id"]): r["group_no"] for r in catalog.QUERIES["greedy_groups"](spark, DATA).collect()} == expected


def test_entry_modules_import(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
