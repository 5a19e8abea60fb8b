"""Listings, names and merges of map tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import siltline.functions as S
from siltline.operators import rank
from siltline.plans.registry import BLOCKS, RUNS, blocks, query, runs
from siltline.session import table


@query("""WITH s AS (SELECT o_custkey AS fs, o_orderkey AS entry, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice) DESC, o_orderkey) AS k FROM orders)
    SELECT fs, CASE WHEN k <= 3 THEN entry END AS entry, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY ALL""")
def topk_with_remainder(spark, sf_dir):
    """The three largest entries of each file system, and a row for all others."""
    size = F.floor("o_totalprice").cast("long")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(size.desc(), "o_orderkey"))
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fs"), F.col("o_orderkey").alias("entry"), size.alias("size"), k.alias("k"))
    return s.groupBy("fs", F.when(F.col("k") <= 3, F.col("entry")).alias("entry")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("""WITH s AS (SELECT l_orderkey AS block, list(l_partkey ORDER BY l_partkey, l_linenumber) AS parts FROM lineitem GROUP BY l_orderkey)
    SELECT block, array_to_string(parts[1:4], ',') AS first_slots, CAST(len(parts) AS BIGINT) AS slots FROM s""")
def bounded_slots(spark, sf_dir):
    """At most four slots of each block, and how many there are."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block")).agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("p"))
    return s.select("block", F.array_join(F.slice(F.col("p.l_partkey"), 1, 4).cast("array<string>"), ",").alias("first_slots"), F.size("p").cast("long").alias("slots"))


@query(r"""SELECT page_id, replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F') AS name FROM pages""")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.safe_name(F.col("url")).alias("name"))


@query("""WITH m AS (SELECT p_partkey AS inode, p_size * 10 AS mode, p_partkey % 3 AS k FROM part)
    SELECT inode, CASE k WHEN 0 THEN 'd' WHEN 1 THEN 'l' ELSE '-' END || CASE WHEN mode & 256 != 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 128 != 0 THEN 'w' ELSE '-' END || CASE WHEN mode & 64 != 0 THEN 'x' ELSE '-' END
        || CASE WHEN mode & 32 != 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 16 != 0 THEN 'w' ELSE '-' END || CASE WHEN mode & 8 != 0 THEN 'x' ELSE '-' END
        || CASE WHEN mode & 4 != 0 THEN 'r' ELSE '-' END || CASE WHEN mode & 2 != 0 THEN 'w' ELSE '-' END || CASE WHEN mode & 1 != 0 THEN 'x' ELSE '-' END AS text FROM m""")
def unix_modes(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "dir").when(F.col("p_partkey") % 3 == 1, "symlink").otherwise("file")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("inode"), S.file_mode(F.col("p_size") * 10, kind).alias("text"))


@query("""SELECT n_regionkey AS parent, n_name AS name, n_nationkey AS node, count(c_custkey) AS children FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY ALL ORDER BY name""")
def child_listing(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("node"), F.coalesce("n", F.lit(0)).alias("children")).orderBy("name")


@query(f"""WITH {RUNS} SELECT volume, CAST(sum(count) AS BIGINT) AS n_blocks, CAST(coalesce(sum(count) FILTER (status = 'ok'), 0) AS BIGINT) AS n_ok, CAST(coalesce(sum(count) FILTER (status = 'hole'), 0) AS BIGINT) AS n_holes,
    CAST(coalesce(sum(count) FILTER (status = 'cksum_mismatch'), 0) AS BIGINT) AS n_damaged, CAST(max(count) AS BIGINT) AS longest_run FROM runs GROUP BY volume""")
def volume_summary(spark, sf_dir):
    of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("count"))), F.lit(0))
    return runs(spark, sf_dir).groupBy("volume").agg(F.sum("count").alias("n_blocks"), of("ok").alias("n_ok"), of("hole").alias("n_holes"), of("cksum_mismatch").alias("n_damaged"), F.max("count").alias("longest_run"))


@query("""WITH found AS (SELECT o_custkey AS dsobj, min(o_orderkey) AS txg, max(o_orderpriority) AS prop FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
    history AS (SELECT user_id AS dsobj, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id * 2 END AS txg, max(event_type) AS prop FROM events GROUP BY user_id)
    SELECT coalesce(f.dsobj, h.dsobj) AS dsobj, coalesce(f.txg, h.txg) AS txg, coalesce(f.prop, h.prop) AS prop, CASE WHEN f.dsobj IS NULL THEN 'history' WHEN h.dsobj IS NULL THEN 'found' ELSE 'both' END AS origin
    FROM found f FULL JOIN history h ON f.dsobj = h.dsobj AND (h.txg IS NULL OR h.txg <= f.txg)""")
def dataset_history_merge(spark, sf_dir):
    """Data sets found on disk merged with those of the log: same object, and a creation that isn't later (unknown fits any); found values win."""
    f = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("dsobj")).agg(F.min("o_orderkey").alias("txg"), F.max("o_orderpriority").alias("prop")).alias("f")
    created = F.when(F.col("user_id") % 3 != 0, F.col("user_id") * 2)
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_type").alias("prop")).select(F.col("user_id").alias("dsobj"), created.alias("txg"), "prop").alias("h")
    both = f.join(h, (F.col("f.dsobj") == F.col("h.dsobj")) & (F.col("h.txg").isNull() | (F.col("h.txg") <= F.col("f.txg"))), "full")
    origin = F.when(F.col("f.dsobj").isNull(), "history").when(F.col("h.dsobj").isNull(), "found").otherwise("both")
    return both.select(*(F.coalesce(F.col(f"f.{c}"), F.col(f"h.{c}")).alias(c) for c in ("dsobj", "txg", "prop")), origin.alias("origin"))


@query("""WITH g AS (SELECT p_brand AS geometry, p_size AS size, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT DISTINCT p_brand AS geometry, p_size AS size FROM part WHERE p_partkey % 40 = 0)
    SELECT geometry, size, n, row_number() OVER (PARTITION BY geometry ORDER BY n DESC, size) AS number FROM g ANTI JOIN k USING (geometry, size)""")
def carved_geometries(spark, sf_dir):
    """Geometries of carved roots that no known volume has, numbered by how often they occur."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("geometry"), F.col("p_size").alias("size"), "p_partkey")
    g = part.groupBy("geometry", "size").agg(F.count("*").alias("n")).join(part.where("p_partkey % 40 = 0"), ["geometry", "size"], "left_anti")
    order = Window.partitionBy("geometry").orderBy(F.desc("n"), "size")
    return g.select("geometry", "size", "n", F.row_number().over(order).cast("long").alias("number"))


@query(f"""WITH {BLOCKS}, r AS (SELECT entry, count(*) AS total, count_if(status = 'cksum_mismatch') AS lost FROM blocks GROUP BY entry)
    SELECT CASE WHEN lost = 0 THEN 'full' WHEN lost = total THEN 'none' ELSE 'partial' END AS status, o_orderpriority AS type, count(*) AS n FROM r JOIN orders ON o_orderkey = entry GROUP BY ALL""")
def status_by_type(spark, sf_dir):
    r = blocks(spark, sf_dir).groupBy("entry").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "cksum_mismatch").alias("lost"))
    status = F.when(F.col("lost") == 0, "full").when(F.col("lost") == F.col("total"), "none").otherwise("partial")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_orderpriority").alias("type"))
    return r.join(o, "entry").groupBy(status.alias("status"), "type").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey AS vdev, l_orderkey // 100 AS extent, count(*) AS reads, CAST(sum(l_quantity) AS BIGINT) AS bytes, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY ALL""")
def read_extents(spark, sf_dir):
    """Reads per device and extent, for bulk windows in physical order."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_suppkey").alias("vdev"), F.floor(F.col("l_orderkey") / 100).alias("extent")).agg(
        F.count("*").alias("reads"), F.sum("l_quantity").cast("long").alias("bytes"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last")
    )


@query("""SELECT event_id, concat(event_type, '=', CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR)) AS text, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events""")
def log_lines(spark, sf_dir):
    """Log records as text, times in UTC."""
    k = F.get_json_object("props", "$.k")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_type"), F.lit("="), k).alias("text"), at.alias("at"))


@query("""WITH b AS (SELECT user_id, us, event_type, event_id FROM (SELECT *, epoch_us(ts) AS us FROM events)) SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS done,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM b""")
def running_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    return e.select("user_id", "event_id", F.sum((F.col("event_type") == "purchase").cast("long")).over(order).alias("done"), F.lag("event_id").over(order).alias("before"))


@query("""SELECT user_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1 GROUP BY user_id""")
def distinct_first_wins(spark, sf_dir):
    return rank.best_per(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("event_id")]).groupBy("user_id").agg(F.count("*").alias("n"))
