"""Operators against plain Python on small and odd inputs."""

import random

from pyspark.sql import functions as F

from siltline import functions as S
from siltline.operators import checksum, fold, graph, intervals, parity, rank, tree
from siltline.operators.graph import connected_components
from siltline.sources.rescue import bad_ranges, map_lines


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def coverage(spark):
    bs = [(0, 10, "ok"), (10, 5, "cksum_mismatch"), (15, 80, "hole"), (95, 5, "no_metadata")]
    return spark.createDataFrame([(1, a, n, s) for a, n, s in bs], "v long, first long, count long, status string")


def test_status_at_points(spark):
    points = spark.createDataFrame([(1, 11), (1, 99), (1, 100), (2, 0)], "v long, blkid long")
    found = intervals.status_at(points, coverage(spark), "v", "blkid")
    assert rows(found, "v", "blkid", "status") == [(1, 11, "cksum_mismatch"), (1, 99, "no_metadata"), (1, 100, "no_metadata"), (2, 0, "no_metadata")]


def test_overlap_join_clips_and_keeps_each_pair_once(spark):
    rng = random.Random(1)
    a = [(i, s, s + rng.randrange(0, 200)) for i, s in enumerate(rng.choices(range(1000), k=60))]
    b = [(i, s, s + rng.randrange(0, 200)) for i, s in enumerate(rng.choices(range(1000), k=60))]
    left = spark.createDataFrame(a, "l long, l_start long, l_end long")
    right = spark.createDataFrame(b, "r long, r_start long, r_end long")
    expected = sorted((i, j, max(s, t), min(e, f)) for i, s, e in a for j, t, f in b if s < f and t < e and s < e and t < f)
    assert rows(intervals.overlap_join(left, right, 64), "l", "r", "start", "end") == expected


def test_coalesce_and_complement(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 3, 4), ("a", 9, 12)], "g string, start long, end long")
    limits = spark.createDataFrame([("a", 20), ("b", 3)], "g string, size long")
    assert rows(intervals.coalesce_intervals(df, "g"), "g", "start", "end") == [("a", 0, 7), ("a", 9, 12)]
    assert rows(intervals.complement(df, "g", limits), "g", "start", "end") == [("a", 7, 9), ("a", 12, 20), ("b", 0, 3)]


def test_run_lengths_break_at_gaps(spark):
    df = spark.createDataFrame([(1, 0, "ok"), (1, 1, "ok"), (1, 3, "ok"), (1, 4, None), (1, 5, None)], "v long, p long, s string")
    assert rows(intervals.run_lengths(df, "v", "p", "s"), "first", "count") == [(0, 2), (3, 1), (4, 2)]


def test_components_of_roots_that_share_keys(spark):
    edges = [(3, 1), (3, 5), (6, 5), (101, 100), (9, 9), (5, 3), (None, 4)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert rows(found, "node", "component") == [(1, 1), (3, 1), (5, 1), (6, 1), (9, 9), (100, 100), (101, 100)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).count() == 0


def test_fletcher_sums_match_running_sums(spark):
    rng = random.Random(2)
    words = [rng.randrange(1 << 32) for _ in range(500)]
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "k long, i long, w long")
    a = b = c = d = 0
    for w in words:
        a += w
        b += a
        c += b
        d += c
    found = checksum.fletcher4(df, "k", ["i"], "w").first()
    assert [int(found[x]) for x in "abcd"] == [x % (1 << 64) for x in (a, b, c, d)]
    sums = [[0, 0], [0, 0]]
    for i, w in enumerate(words):
        sums[i % 2][0] += w
        sums[i % 2][1] += sums[i % 2][0]
    found = checksum.fletcher2(df, "k", ["i"], "w").first()
    assert [int(found[x]) for x in ("a0", "b0", "a1", "b1")] == [x % (1 << 64) for lane in sums for x in lane]


def test_field_products(spark):
    def times(a, b):
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = (a << 1) ^ (0x11D if a & 0x80 else 0), b >> 1
        return out

    powers, _ = parity.tables()
    df = spark.range(256).crossJoin(spark.createDataFrame([(k,) for k in (0, 1, 7, 100, 254)], "k int"))
    for r in df.select("id", "k", parity.gf_times_power(F.col("id"), F.col("k")).alias("p")).collect():
        assert r["p"] == times(r["id"], powers[r["k"]])
    back = df.select("id", parity.gf_over_power(parity.gf_times_power(F.col("id"), F.col("k")), F.col("k")).alias("x"))
    assert back.where("id != x").count() == 0


def test_windows_close_at_gap_and_cap(spark):
    df = spark.createDataFrame([(0, 0, 10), (0, 12, 20), (0, 21, 30), (0, 100, 101)], "d long, start long, end long")
    assert rows(fold.capped_windows(df, "d", 4, 20), "start", "end", "n") == [(0, 20, 2), (21, 30, 1), (100, 101, 1)]
    assert fold.capped_windows(df.limit(0), "d", 4, 20).count() == 0


def test_batches_close_after_the_limit(spark):
    df = spark.createDataFrame([([5, 5, 5, 1, 20, 1],)], "s array<long>")
    assert df.select(fold.closed_batches(F.col("s"), 10).alias("b")).first()["b"] == [0, 0, 1, 1, 1, 2]


def test_walk_ends_in_cycles(spark):
    roots = spark.createDataFrame([("a", "a")], "node string, path string")
    edges = spark.createDataFrame([("a", "b", "b"), ("b", "a", "a"), ("b", "c", "c"), ("x", "y", "y")], "parent string, child string, name string")
    assert rows(tree.level_walk(roots, edges), "node", "path", "depth") == [("a", "a", 0), ("b", "a/b", 1), ("c", "a/b/c", 2)]


def test_votes_upserts_and_fallbacks(spark):
    votes = spark.createDataFrame([(1, 5)] * 9 + [(1, 6)] + [(2, 8), (2, 7)], "k long, c long")
    assert rows(rank.majority(votes, "k", "c", 0.9), "k", "c", "votes", "placed") == [(1, 5, 9, True), (2, 7, 1, False)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows(rank.upsert(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(rank.insert_if_absent(old, new, ["k"], [F.asc("v")]), "k", "v") == [(1, "a"), (2, "b"), (3, "d")]
    tried = spark.createDataFrame([(1, 1, "x", False), (1, 2, "y", True), (2, 1, "z", False)], "k long, r long, v string, ok boolean")
    assert rows(rank.first_ok(tried, ["k"], F.col("r"), F.col("ok"), "v").fillna("-").fillna(0), "k", "chosen", "rank") == [(1, "y", 2), (2, "-", 0)]


def test_rescue_maps_round_trip(spark):
    text = ["# x", "0x0 0x100000 +", "0x100000 0x1000 -", "0x101000 0xF000 /", "0x110000 0x10000 *", "0x1 2"]
    found = bad_ranges(spark.createDataFrame([(t,) for t in text], "value string"))
    assert rows(found, "pos", "end") == [(0x100000, 0x101000), (0x101000, 0x110000), (0x110000, 0x120000)]
    lines = rows(map_lines(found.select(F.col("pos").alias("start"), "end"), 0x200000), "pos", "line")
    assert [x for _, x in lines] == ["0x0  0x100000  +", "0x100000  0x20000  -", "0x120000  0xE0000  +"]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(S.parse_size(F.lit(t))) for t in ("64M", "0x200", "1.5k", "12", "x", "7GiB")] == [64 << 20, 512, 1536, 12, None, 7 << 30]
    assert [value(S.human_size(F.lit(n))) for n in (5, 1536, 1 << 30)] == ["5 B", "1.5 KiB", "1.0 GiB"]
    assert value(S.safe_name(F.lit('a:b/c%.'))) == "a%3Ab%2Fc%25%2E"
    assert value(S.file_mode(F.lit(0o754), F.lit("dir"))) == "drwxr-xr--"
    assert (value(S.parent_of(F.lit("/a/b"))), value(S.base_name(F.lit("/a/b"))), value(S.depth(F.lit("/a/b")))) == ("/a", "b", 2)
    assert value(S.all_zero(F.lit(b"\0\0"))) and not value(S.all_zero(F.lit(b"\0\x01")))
    paths = spark.createDataFrame([("/a",), ("/a/x",), ("/ab",), ("/b/k.txt",)], "p string")
    assert rows(paths.where(S.glob(F.col("p"), "/a")), "p") == [("/a",), ("/a/x",)]
    assert rows(paths.where(S.glob(F.col("p"), "*.txt")), "p") == [("/b/k.txt",)]


def test_cluster_components_join_all_line_items(spark, tmp_path):
    from siltline.plans.relational import cluster_components

    rng = random.Random(6)
    lines = [(o, rng.randrange(40), rng.randrange(3), float(rng.randrange(1, 51))) for o in range(60) for _ in range(rng.randrange(1, 3))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent = {o: o for o, *_ in lines}

    def top(o):
        while parent[o] != o:
            o = parent[o]
        return o

    first = {}
    for o, part, line, _ in lines:
        a, b = top(o), top(first.setdefault((part, line), o))
        parent[max(a, b)] = min(a, b)
    members = {}
    for o in parent:
        members.setdefault(top(o), []).append(o)
    expected = sorted((c, len(m), max(m)) for c, m in members.items())
    assert len(expected) > 2 and rows(cluster_components(spark, str(tmp_path)), "component", "roots", "last") == expected


def test_zero_test_reads_whole_texts(spark, tmp_path):
    from siltline.plans.checks import zero_test_case

    docs = [(5, "\0" * 64 + "tail"), (10, "\0" * 200), (15, "text"), (11, "text"), (3, "\0")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(zero_test_case(spark, str(tmp_path)), "status", "n") == [("cksum_mismatch", 2), ("ok", 1), ("zeroed", 2)]


def test_components_of_a_hub_in_every_plan(spark, monkeypatch):
    """A third of the edges at one node; with and without the aggregates cut off."""
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1300)] + [(5000 + k, 9999) for k in range(300)] + [(7, 7), (8000, 8000), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    expected = {k: 0 for k in range(400)} | {k: 1000 for k in range(1000, 1301)} | {k: 5000 for k in [*range(5000, 5300), 9999]} | {8000: 8000}
    for few, hub in ((1 << 14, 1 << 18), (0, 1 << 18), (0, 0)):
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(graph, "HUB", hub)
        assert {r["node"]: r["component"] for r in graph.connected_components(df).collect()} == expected


def test_cuts_decide_nothing(spark):
    """Runs, unions, merges, sums and look-ups are alike for any width of a cut, and no window spans a group."""
    rng = random.Random(11)
    blocks = [(v, p, rng.choice("ab") if rng.random() < 0.2 else "a") for v in range(2) for p in range(300) if rng.random() < 0.97]
    spans = []
    for g in range(2):
        for _ in range(60):
            a = rng.randrange(500)
            spans.append((g, a, a + rng.randrange(0, 12)))
    b = spark.createDataFrame(blocks, "v int, p long, s string")
    i = spark.createDataFrame(spans, "g int, start long, end long")
    points = spark.createDataFrame([(v, p) for v in range(2) for p in range(-3, 310)], "v int, p long")
    got = []
    for cut in (1 << 20, 7, 16):
        runs = intervals.run_lengths(b, "v", "p", "s", cut)
        merged = intervals.merge_adjacent(runs.select("v", F.col("first").alias("start"), (F.col("first") + F.col("count")).alias("end"), F.lit("x").alias("k")), "v", ["k"], cut=cut)
        rows = [
            runs.select("v", "first", "count", "s"),
            intervals.coalesce_intervals(i, "g", cut=cut).select("g", "start", "end"),
            merged.select("v", "start", "end", "k"),
            intervals.running_sum(runs, "v", "first", F.col("count"), "total", cut).select("v", "first", "total"),
            intervals.status_at(points, runs, "v", "p", "s", cut=cut),
        ]
        got.append([sorted(map(tuple, r.collect())) for r in rows])
    assert got[0] == got[1] == got[2]
    expected, last = [], None
    for v, p, s in blocks:
        if last and last[0] == v and last[1] + last[2] == p and last[3] == s:
            last[2] += 1
        else:
            last = [v, p, 1, s]
            expected.append(last)
    assert got[0][0] == sorted(map(tuple, expected))
    where = {(v, p): s for v, p, s in blocks}
    assert got[0][4] == sorted((v, p, where.get((v, p), "no_metadata")) for v in range(2) for p in range(-3, 310))


def test_level_walk_says_when_it_ends_early(spark):
    import pytest

    edges = spark.createDataFrame([(k, k + 1, f"n{k}") for k in range(6)], "parent long, child long, name string")
    roots = spark.createDataFrame([(0, "")], "node long, path string")
    assert tree.level_walk(roots, edges, 6).count() == 7
    with pytest.raises(RuntimeError):
        tree.level_walk(roots, edges, 5)
