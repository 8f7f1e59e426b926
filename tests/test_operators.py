import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneloom.operators import groups, intervals, lookups, ordering, similarity_join, synteny
from geneloom.operators.components import connected_components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7), (None, 3), (9, None)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_first_containing(spark):
    inner = spark.createDataFrame([(1, 0, 5, 9), (1, 1, 5, 20), (2, 0, 5, 9)], "rec int, n int, start int, end int")
    outer = spark.createDataFrame([(1, 3, 0, 30), (1, 2, 5, 9), (1, 1, 6, 9)], "rec int, n int, start int, end int")
    found = intervals.first_containing(inner, outer, ["rec"], ["rec", "n"], "n", ["start", "end"]).collect()
    assert {(r["rec"], r["n"]): (r["parent_start"], r["parent_end"]) for r in found} == {(1, 0): (5, 9), (1, 1): (0, 30), (2, 0): (None, None)}


def test_first_containing_with_null_keys_and_bins(spark):
    """A null among the columns that tell rows apart loses no match, and bins of any width give the same rows."""
    import random

    inner = spark.createDataFrame([(1, None, 5, 6), (None, 1, 5, 6), (1, 2, None, 6), (1, 3, 6, 5)], "rec int, n int, start int, end int")
    outer = spark.createDataFrame([(1, 9, 0, 9), (None, 8, 0, 9), (1, 7, 9, 0), (1, 6, None, 9)], "rec int, n int, start int, end int")
    found = intervals.first_containing(inner, outer, ["rec"], ["rec", "n"], "n", ["start", "end"], bin_width=3).collect()
    assert {(r["rec"], r["n"]): r["parent_start"] for r in found} == {(1, None): 0, (None, 1): None, (1, 2): None, (1, 3): 0}
    rng = random.Random(5)
    a = [(1, i, x, x + rng.randrange(1, 9)) for i in range(60) for x in [rng.randrange(-30, 300)]]
    b = [(1, i, x, x + rng.randrange(1, 120)) for i in range(40) for x in [rng.randrange(-40, 300)]]
    expected = {i: min((j for _, j, y, w in b if y <= x and z <= w), default=None) for _, i, x, z in a}
    schema = "rec int, n int, start int, end int"
    for width in (1, 7, 10_000):
        found = intervals.first_containing(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["rec"], ["rec", "n"], "n", ["n"], bin_width=width)
        assert {r["n"]: r["parent_n"] for r in found.collect()} == expected


def rows_of_joins(spark, since: int) -> int:
    """The most rows that a join of the runs from number `since` on put out."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run < since:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_first_containing_lists_no_pairs(spark, monkeypatch):
    """Every interval holds every place, 4,000,000 pairs in one bin: no join makes more rows than there are places."""
    n = 2000
    inner = spark.range(n).select(F.lit(1).alias("rec"), F.col("id").alias("n"), (5000 + F.col("id")).alias("start"), (7000 + F.col("id")).alias("end"))
    outer = spark.range(n).select(F.lit(1).alias("rec"), (F.lit(n) - F.col("id")).alias("n"), F.col("id").alias("start"), (9999 - F.col("id") / 10_000).alias("end"))
    for limit in (intervals.BROADCAST_PLACES, 0):
        monkeypatch.setattr(intervals, "BROADCAST_PLACES", limit)
        runs = spark._jsparkSession.sharedState().statusStore().executionsCount()
        found = intervals.first_containing(inner, outer, ["rec"], ["n"], "n", ["n"]).collect()
        assert [r["parent_n"] for r in sorted(found)] == [1] * n
        assert 0 < rows_of_joins(spark, runs) <= n


def test_first_containing_of_any_intervals(spark, monkeypatch):
    """Ends before starts, ties, very long and very short intervals, repeated rows, NaN, numbers of several kinds, no rows."""
    rng = random.Random(3)
    point = lambda wide: float(rng.choice([rng.randrange(-9, 9), rng.randrange(-wide, wide)]))
    last = lambda x: float("inf") if x != x else x
    for kind, wide in (("double", 40), ("int", 10**9), ("decimal(20,2)", 10**5)):
        a, b = ([(rng.randrange(3), i // 2, point(wide), point(wide)) for i in range(160)] for _ in range(2))
        if kind == "double":
            a[:2], b[:2] = [(1, 200, 3.0, float("nan")), (1, 201, float("nan"), 3.0)], [(1, -1, -5.0, float("nan")), (1, -2, float("nan"), 50.0)]
        expected = sorted(((r, i, *map(last, (x, y))), min(((j, last(w)) for s, j, z, w in b if s == r and last(z) <= last(x) and last(w) >= last(y)), default=(-9, -9))) for r, i, x, y in a)
        schema = "rec int, n int, start double, end double"
        inner, outer = spark.createDataFrame(a + a[:5], schema), spark.createDataFrame(b + b[:5], schema)
        typed = outer if kind == "double" else outer.select("rec", "n", F.col("start").cast(kind), F.col("end").cast(kind))
        for limit, width in ((intervals.BROADCAST_PLACES, 2), (0, 10_000)):
            monkeypatch.setattr(intervals, "BROADCAST_PLACES", limit)
            found = intervals.first_containing(inner if kind == "double" else inner.select("rec", "n", F.col("start").cast("long"), F.col("end").cast("long")), typed, ["rec"], ["rec", "n"], "n", ["n", "end"], bin_width=width).collect()
            got = sorted(((r[0], r[1], *(last(float(x)) for x in r[2:4])), (-9, -9) if r[4] is None else (r[4], last(float(r[5])))) for r in found)
            assert got == sorted(expected + [e for r, i, x, y in a[:5] for e in expected if e[0] == (r, i, last(x), last(y))][:5])
    none = inner.limit(0)
    assert intervals.first_containing(none, outer, ["rec"], ["rec", "n"], "n", ["n"]).collect() == []
    assert {r["parent_n"] for r in intervals.first_containing(inner, none, ["rec"], ["rec", "n"], "n", ["n"]).collect()} == {None}


def test_islands_and_abutting_parts(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")] + [(2, 0, None), (2, 1, None), (2, 2, "x")], "p int, i int, k string")
    found = {(r["p"], r["i"]): r["island"] for r in intervals.islands(rows, ["p"], ["i"], "k").collect()}
    assert [found[1, i] for i in range(5)] == [1, 1, 2, 2, 3] and [found[2, i] for i in range(3)] == [1, 1, 2]
    exon = lambda a, b, s: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).cast("tinyint").alias("strand"))
    for parts, expected in (([(0, 5, 1), (5, 9, 1), (12, 15, 1)], [(0, 9), (12, 15)]), ([(9, 12, -1), (5, 9, -1)], [(5, 12)]), ([(0, 5, 1), (5, 9, -1)], [(0, 5), (5, 9)])):
        row = spark.range(1).select(intervals.join_abutting(F.array(*(exon(*p) for p in parts))).alias("x")).first()["x"]
        assert [(e["start"], e["end"]) for e in row] == expected


LINKS = "alignment_id string, link_ord int, query_gene_id string, target_gene_id string, identity double"


def test_greedy_groups_never_merge(spark):
    rows = [("x", 0, "a", "b", 0.9), ("x", 1, "c", "d", 0.9), ("x", 2, "b", "c", 0.9), ("x", 3, "d", "e", 0.9), ("x", 4, "z", "y", 0.2)]
    found = {r["gene_id"]: r["group_no"] for r in groups.greedy_groups(spark.createDataFrame(rows, LINKS)).collect()}
    # c was in the second group and is put into the first by the third link; d is found in the second
    assert found == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1}
    merged = {r["gene_id"]: r["group_no"] for r in groups.linked_groups(spark.createDataFrame(rows, LINKS)).collect()}
    assert merged == dict.fromkeys("abcde", 0)


def build(spark, links, functions=None, colours=None, rule="documented"):
    rows = [(q, t, i) for i, (q, t) in enumerate(links)]
    frame = spark.createDataFrame(rows, "query_gene_id string, target_gene_id string, n int").select("query_gene_id", "target_gene_id", F.struct("n").alias("place"))
    listed = spark.createDataFrame([(o, f, g) for o, (f, genes) in enumerate(functions) for g in (genes or [None])], "function_ord int, function string, gene_id string") if functions else None
    tints = spark.createDataFrame(list(colours.items()), "function string, colour string") if colours else None
    found, members = groups.build_groups(frame, listed, tints, rule)
    held: dict = {}
    for r in members.collect():
        held.setdefault(r["group_id"], set()).add(r["gene_id"])
    return [(r["label"], held.get(r["group_id"], set()), r["colour"]) for r in found.orderBy("group_ord").collect()]


def brute_groups(links, functions=(), rule="documented"):
    """The loop over components in order of their first link, on sets of genes."""
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[y] = x
    order: dict = {}
    for a, b in links:
        for g in (a, b):
            order.setdefault(find(g), set()).add(g)
    found = [[f, set(genes)] for f, genes in functions]
    asked = found[-1] if found else None
    for component in order.values():
        if rule == "documented":
            overlaps = [i for i, g in enumerate(found) if g[1] & component]
        else:
            overlaps = list(range(len(found))) if asked is not None and asked[1] & component else []
        if not overlaps:
            asked = [f"Group {len(found)}", set(component)]
            found.append(asked)
            continue
        found[overlaps[0]][1] |= component
        for i in reversed(overlaps[1:]):
            found[overlaps[0]][1] |= found[i][1]
            del found[i]
    return [(f, g) for f, g in found]


@pytest.mark.parametrize("rule", ["documented", "effective"])
@pytest.mark.parametrize("seed", range(4))
def test_groups_match_brute_force(spark, rule, seed):
    rng = random.Random(seed)
    genes = [f"g{i}" for i in range(30)]
    links = [tuple(rng.sample(genes, 2)) for _ in range(14)]
    functions = [(f"F{k}", rng.sample(genes, rng.randrange(0, 4))) for k in range(rng.randrange(0, 4))]
    assert [(a, b) for a, b, _ in build(spark, links, functions, rule=rule)] == brute_groups(links, functions, rule)


def test_groups_of_functions(spark):
    links = [("c", "d"), ("a", "b"), ("e", "f")]
    assert build(spark, links) == [("Group 0", {"c", "d"}, None), ("Group 1", {"a", "b"}, None), ("Group 2", {"e", "f"}, None)]
    named = build(spark, links, [("P450", ["b", "z"]), ("none", [])], {"P450": "#f00"})
    assert named == [("P450", {"a", "b", "z"}, "#f00"), ("none", set(), None), ("Group 2", {"c", "d"}, None), ("Group 3", {"e", "f"}, None)]
    assert build(spark, [], [("only", ["q"])]) == [("only", {"q"}, None)]
    with pytest.raises(ValueError):
        build(spark, links, rule="other")


def test_matrix_is_symmetric(spark):
    clusters = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "cluster_id string, cluster_ord int")
    scores = spark.createDataFrame([("a", "b", 2.0), ("c", "a", 4.0), ("b", "c", 0.0)], "query_cluster_id string, target_cluster_id string, score double")
    as_array = lambda **o: {(r["i"], r["j"]): r["value"] for r in synteny.score_matrix(clusters, scores, **o).collect()}
    assert as_array() == {(0, 0): 0, (0, 1): 2, (0, 2): 4, (1, 0): 2, (1, 1): 0, (1, 2): 0, (2, 0): 4, (2, 1): 0, (2, 2): 0}
    assert as_array(normalise=True, as_distance=True) == {(0, 0): 0, (0, 1): 0.5, (0, 2): 0, (1, 0): 0.5, (1, 1): 0, (1, 2): 1, (2, 0): 0, (2, 1): 1, (2, 2): 0}
    assert as_array(as_distance=True)[1, 2] == 4
    missing = synteny.score_matrix(clusters, scores.limit(1))
    assert missing.where("value IS NULL").count() == 4
    with pytest.raises(KeyError):
        ordering.cluster_order(missing, 3)


def test_contiguity(spark):
    grouped = spark.createDataFrame([("x", "l1", 0, 1), ("x", "l1", 1, 2), ("x", "l1", 2, 3), ("x", "l2", 0, 1), ("x", "l2", 1, 2), ("x", "l3", 0, 9)], "a string, l string, n int, g int")
    pairs = synteny.contiguous_pairs(grouped, ["a", "l"], ["n"], "g")
    assert sorted((r["left"], r["right"]) for r in pairs.collect()) == [(1, 2), (1, 2), (2, 3)]
    other = spark.createDataFrame([("x", 1, 2), ("x", 2, 3), ("x", 2, 3), ("x", None, 3)], "a string, left int, right int")
    assert [(r["a"], r["contiguity"]) for r in synteny.shared_pairs(pairs, other, ["a"]).collect()] == [("x", 2)]


def test_documented_synteny_adds_shared_neighbours(spark):
    genes = spark.createDataFrame([("q", "ql", 0, "a"), ("q", "ql", 1, "b"), ("t", "tl", 0, "c"), ("t", "tl", 1, "d")], "cluster_id string, locus_id string, gene_ord int, gene_id string")
    links = spark.createDataFrame([("x", 0, "a", "c", 0.5), ("x", 1, "b", "d", 0.75)], LINKS)
    alignments = spark.createDataFrame([("x", "q", "t"), ("y", "t", "u")], "alignment_id string, query_cluster_id string, target_cluster_id string")
    score = lambda mode: {r["alignment_id"]: r["score"] for r in synteny.synteny(links, alignments, genes, 0.5, mode).collect()}
    assert score("effective") == {"x": 1.25, "y": 0.0}
    assert score("documented") == {"x": 1.75, "y": 0.0}
    with pytest.raises(ValueError):
        score("other")


def test_linkage_orders_clusters():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 2], [9, 9, 2, 0.0]])
    for method in ordering.METHODS:
        merges = ordering.linkage(d, method)
        assert [m[:2] for m in merges] == [(0, 1), (2, 3), (4, 5)] and [m[3] for m in merges] == [2, 2, 4]
        assert ordering.leaves(merges, 4) == [0, 1, 2, 3]
    assert ordering.linkage(d, "single")[-1][2] == ordering.linkage(d, "complete")[-1][2] == ordering.linkage(d, "average")[-1][2] == 9
    assert ordering.linkage(d)[-1][2] == pytest.approx(np.sqrt((4 * 81 * 4 - 2 * (2 * 1 + 2 * 4)) / 8), rel=0.1)
    with pytest.raises(ValueError):
        ordering.linkage(d, "median")


@pytest.mark.parametrize("method", ordering.METHODS)
def test_order_is_a_permutation(method):
    rng = np.random.default_rng(5)
    for n in (2, 3, 7, 12):
        x = rng.random((n, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        merges = ordering.linkage(d, method)
        assert sorted(ordering.leaves(merges, n)) == list(range(n))
        assert all(a[2] <= b[2] + 1e-9 for a, b in zip(merges, merges[1:]))


def test_best_links_and_lookups(spark):
    links = spark.createDataFrame([("l1", "x", 0, "a", "c", 0.5), ("l2", "x", 1, "a", "d", 0.7), ("l3", "x", 2, "a", "e", 0.7), ("l4", "y", 0, "a", "f", 0.1)], "link_id string, alignment_id string, link_ord int, query_gene_id string, target_gene_id string, identity double")
    genes = spark.createDataFrame([("c", "t"), ("d", "t"), ("e", "t"), ("f", "u")], "gene_id string, cluster_id string")
    assert sorted(r["link_id"] for r in similarity_join.best_links(links, genes).collect()) == ["l2", "l4"]
    assert lookups.contains(links, "d") and not lookups.contains(links, "z")
    alignments = spark.createDataFrame([("x", "q", "t")], "alignment_id string, query_cluster_id string, target_cluster_id string")
    assert lookups.alignment_between(alignments, "t", "q").count() == 1 and lookups.alignment_between(alignments, "q", "q").count() == 0
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (None, "C")], "k int, v string")
    assert sorted(((r["k"], r["v"]) for r in similarity_join.upsert(old, new, ["k"]).collect()), key=str) == [(1, "a"), (2, "B"), (None, "C")]
