"""Coverage of volumes: run lengths, intervals, losses and estimates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltline.operators import intervals as I
from siltline.plans.registry import BLOCKS, RANGES, RUNS, blocks, query, ranges, runs
from siltline.session import table

LOST = "('cksum_mismatch', 'zeroed', 'no_metadata', 'unreadable', 'decompress_fail')"


@query(f"WITH {RUNS} SELECT volume, first, count, status FROM runs")
def coverage_rle(spark, sf_dir):
    return runs(spark, sf_dir).select("volume", "first", "count", "status")


@query(f"""WITH {RUNS} SELECT status, CAST(sum(count) AS BIGINT) AS blocks, count(*) AS runs,
    round(sum(count) * 1.0 / (SELECT sum(count) FROM runs), 9) AS share FROM runs GROUP BY status""")
def coverage_histogram_share(spark, sf_dir):
    by = runs(spark, sf_dir).groupBy("status").agg(F.sum("count").alias("blocks"), F.count("*").alias("runs"))
    # the statuses are few: the total is a window over their aggregate
    return by.withColumn("share", F.round(F.col("blocks") / F.sum("blocks").over(Window.partitionBy(F.lit(1))), 9))


@query(f"""WITH {RUNS}, cut AS (SELECT *, unnest(range(first // 64, (first + count - 1) // 64 + 1)) AS bucket FROM runs)
    SELECT volume, bucket, status, CAST(sum(least(first + count, (bucket + 1) * 64) - greatest(first, bucket * 64)) AS BIGINT) AS n
    FROM cut GROUP BY volume, bucket, status""")
def coverage_buckets(spark, sf_dir):
    return I.split_at_buckets(runs(spark, sf_dir), 64).groupBy("volume", "bucket", "status").agg(F.sum("n").alias("n"))


_PAIRS = """pairs AS (SELECT a.dev, a.id AS a, b.id AS b, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end"
    FROM ranges a JOIN ranges b ON a.dev = b.dev AND a.start < b."end" AND b.start < a."end" WHERE a.status = 'F' AND b.status = 'O')"""


def _pairs(spark, sf_dir):
    r = ranges(spark, sf_dir)
    a = r.where("status = 'F'").select("dev", F.col("id").alias("a"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    b = r.where("status = 'O'").select("dev", F.col("id").alias("b"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return I.overlap_join(a, b, 2048, ["dev"]).select("dev", "a", "b", "start", "end")


@query(f"""WITH {RANGES}, {_PAIRS} SELECT a, count(*) AS pieces, CAST(sum("end" - start) AS BIGINT) AS bytes FROM pairs GROUP BY a""")
def interval_overlap_bytes(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("a").agg(F.count("*").alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query(f"""WITH {RANGES}, {_PAIRS}, marked AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY a ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS new FROM pairs),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY a ORDER BY start, "end") AS island FROM marked)
    SELECT a, min(start) AS start, max("end") AS "end" FROM islands GROUP BY a, island""")
def interval_clipped_ranges(spark, sf_dir):
    return I.coalesce_intervals(_pairs(spark, sf_dir), "a").select("a", "start", "end")


_MERGED = """marked AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY dev ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS new FROM ranges),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY dev ORDER BY start, "end", id) AS island FROM marked),
    merged AS (SELECT dev, min(start) AS start, max("end") AS "end" FROM islands GROUP BY dev, island)"""


@query(f'WITH {RANGES}, {_MERGED} SELECT dev, start, "end" FROM merged')
def interval_coalesce(spark, sf_dir):
    return I.coalesce_intervals(ranges(spark, sf_dir), "dev").select("dev", "start", "end")


@query(f"""WITH {RANGES}, {_MERGED}, gaps AS (
    SELECT dev, coalesce(lag("end") OVER (PARTITION BY dev ORDER BY start), 0) AS a, start AS b FROM merged
    UNION ALL SELECT dev, max("end"), 110000 FROM merged GROUP BY dev)
    SELECT dev, a AS start, b AS "end" FROM gaps WHERE a < b""")
def interval_complement(spark, sf_dir):
    r = ranges(spark, sf_dir)
    limits = r.select("dev").distinct().withColumn("size", F.lit(110000).cast("long"))
    return I.complement(r, "dev", limits)


@query(f"""WITH {RUNS}, e AS (SELECT volume, first AS start, first + count AS "end", CASE WHEN status IN {LOST} THEN 'lost' ELSE 'fine' END AS reason FROM runs),
    joined AS (SELECT *, CASE WHEN lag("end") OVER w = start AND lag(reason) OVER w = reason THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY volume ORDER BY start)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY volume ORDER BY start) AS island FROM joined)
    SELECT volume, reason, min(start) AS start, max("end") AS "end" FROM islands GROUP BY volume, reason, island""")
def adjacent_merge_same_reason(spark, sf_dir):
    lost = F.when(F.col("status").isin("cksum_mismatch", "zeroed", "no_metadata", "unreadable", "decompress_fail"), "lost").otherwise("fine")
    spans = runs(spark, sf_dir).select("volume", F.col("first").alias("start"), (F.col("first") + F.col("count")).alias("end"), lost.alias("reason"))
    return I.merge_adjacent(spans, "volume", ["reason"]).select("volume", "reason", "start", "end")


@query(f"""WITH {RUNS} SELECT volume, first, CAST(sum(CASE WHEN status IN {LOST} THEN count ELSE 0 END) OVER (PARTITION BY volume ORDER BY first) AS BIGINT) AS lost_so_far FROM runs""")
def prefix_sum_lost(spark, sf_dir):
    lost = F.when(F.col("status") == "cksum_mismatch", F.col("count")).otherwise(0)
    return I.running_sum(runs(spark, sf_dir).select("volume", "first", "status", "count"), "volume", "first", lost, "lost_so_far").select("volume", "first", "lost_so_far")


_POINTS = "points AS (SELECT o_custkey % 100 + 1 AS volume, o_orderkey % 1000 AS blkid FROM orders)"


@query(f"""WITH {RUNS}, {_POINTS} SELECT p.volume, p.blkid, coalesce(r.status, 'no_metadata') AS status
    FROM points p LEFT JOIN runs r ON r.volume = p.volume AND r.first <= p.blkid AND p.blkid < r.first + r.count""")
def status_at_asof(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100 + 1).alias("volume"), (F.col("o_orderkey") % 1000).alias("blkid"))
    return I.status_at(points, runs(spark, sf_dir), "volume", "blkid")


_ASKED = 'asked AS (SELECT o_orderkey AS id, o_custkey % 100 + 1 AS volume, o_orderkey % 500 AS lo, o_orderkey % 500 + 40 AS hi FROM orders)'


@query(f"""WITH {RUNS}, {_ASKED}, hit AS (SELECT id, status, least(hi, first + count) - greatest(lo, first) AS n FROM asked a JOIN runs r ON r.volume = a.volume AND first < hi AND first + count > lo)
    SELECT a.id, CAST(coalesce(sum(n) FILTER (status = 'ok'), 0) AS BIGINT) AS read_blocks, CAST(coalesce(sum(n) FILTER (status = 'hole'), 0) AS BIGINT) AS sparse_blocks,
           CAST(coalesce(sum(n) FILTER (status = 'cksum_mismatch'), 0) AS BIGINT) AS lost_blocks, CAST(40 - coalesce(sum(n), 0) AS BIGINT) AS uncovered
    FROM asked a LEFT JOIN hit h ON h.id = a.id GROUP BY a.id""")
def range_request_estimate(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100 + 1).alias("volume"), (F.col("o_orderkey") % 500).alias("l_start"), (F.col("o_orderkey") % 500 + 40).alias("l_end"))
    covered = runs(spark, sf_dir).select("volume", F.col("first").alias("r_start"), (F.col("first") + F.col("count")).alias("r_end"), "status")
    hit = I.overlap_join(asked, covered, 64, ["volume"]).select("id", "status", (F.col("end") - F.col("start")).alias("n"))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0))
    return asked.select("id").join(hit, "id", "left").groupBy("id").agg(
        part("ok").alias("read_blocks"), part("hole").alias("sparse_blocks"), part("cksum_mismatch").alias("lost_blocks"), (40 - F.coalesce(F.sum("n"), F.lit(0))).alias("uncovered")
    )


@query("""SELECT o_orderpriority AS kind, o_orderstatus AS status, count(*) AS files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes,
    CAST(sum(greatest(0, CAST(floor(o_totalprice) AS BIGINT) - CASE WHEN o_orderstatus = 'O' THEN 100000 ELSE 0 END)) AS BIGINT) AS recoverable FROM orders GROUP BY ALL""")
def estimate_by_status(spark, sf_dir):
    size = F.floor("o_totalprice").cast("long")
    left = F.greatest(F.lit(0).cast("long"), size - F.when(F.col("o_orderstatus") == "O", 100000).otherwise(0))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))
    return rows.agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.sum(left).alias("recoverable"))


@query(f"""WITH {BLOCKS} SELECT o_orderkey AS entry, coalesce(min(blkid), 0) AS first_block FROM orders LEFT JOIN blocks ON entry = o_orderkey AND status != 'hole' GROUP BY o_orderkey""")
def first_extent_per_file(spark, sf_dir):
    first = blocks(spark, sf_dir).where("status != 'hole'").groupBy("entry").agg(F.min("blkid").alias("first_block"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry")).distinct()
    return entries.join(first, "entry", "left").select("entry", F.coalesce("first_block", F.lit(0)).alias("first_block"))


@query(f"""WITH {BLOCKS}, f AS (SELECT entry, count(*) AS total, count_if(status = 'cksum_mismatch') AS lost FROM blocks GROUP BY entry)
    SELECT CASE WHEN lost = 0 THEN 'full' WHEN lost >= total THEN 'none' ELSE 'partial' END AS verdict, count(*) AS files, CAST(sum(total - lost) AS BIGINT) AS recoverable FROM f GROUP BY 1""")
def verdict_case(spark, sf_dir):
    f = blocks(spark, sf_dir).groupBy("entry").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "cksum_mismatch").alias("lost"))
    verdict = F.when(F.col("lost") == 0, "full").when(F.col("lost") >= F.col("total"), "none").otherwise("partial")
    return f.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("files"), F.sum(F.col("total") - F.col("lost")).alias("recoverable"))


@query(f"""WITH {RUNS} SELECT volume, first, count FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY count DESC, first) AS k FROM runs WHERE status NOT IN ('ok', 'hole')) WHERE k <= 3""")
def not_in_topk_gaps(spark, sf_dir):
    from siltline.operators.rank import best_per

    gaps = runs(spark, sf_dir).where(~F.col("status").isin("ok", "hole"))
    return best_per(gaps, ["volume"], [F.desc("count"), F.asc("first")], 3).select("volume", "first", "count")


@query(f"""WITH {BLOCKS} SELECT volume, count_if(status = 'cksum_mismatch')::BIGINT AS before, count_if(status = 'cksum_mismatch' AND kind = 'O')::BIGINT AS after, count_if(status = 'cksum_mismatch' AND kind != 'O')::BIGINT AS recovered FROM blocks GROUP BY volume""")
def before_after_counts(spark, sf_dir):
    bad = F.col("status") == "cksum_mismatch"
    return blocks(spark, sf_dir).groupBy("volume").agg(F.count_if(bad).alias("before"), F.count_if(bad & (F.col("kind") == "O")).alias("after"), F.count_if(bad & (F.col("kind") != "O")).alias("recovered"))


@query(f"""WITH {BLOCKS}, g AS (SELECT volume, blkid, part, blkid - row_number() OVER (PARTITION BY volume, status ORDER BY blkid) AS d, status FROM blocks)
    SELECT volume, status, min(blkid) AS lblk, count(*) AS n, CAST(bit_xor(part) AS BIGINT) AS mark FROM g GROUP BY volume, status, d""")
def consecutive_run_merge(spark, sf_dir):
    order = Window.partitionBy("volume", "status").orderBy("blkid")
    g = blocks(spark, sf_dir).withColumn("d", F.col("blkid") - F.row_number().over(order))
    return g.groupBy("volume", "status", "d").agg(F.min("blkid").alias("lblk"), F.count("*").alias("n"), F.bit_xor("part").alias("mark")).drop("d")
