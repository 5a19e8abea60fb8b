"""Joins, choices, aggregates and sets over map-like tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltline.operators import fold, rank, tree
from siltline.operators.graph import connected_components
from siltline.plans.registry import BLOCKS, blocks, query
from siltline.session import cut, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


EVENTS = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us, ts FROM events)"


@query("""SELECT o_orderkey AS id, c_name AS dataset, c_mktsegment AS kind FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7""")
def dataset_join_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey = 7")
    return table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("dataset"), F.col("c_mktsegment").alias("kind"))


@query("""SELECT l_orderkey AS entry, l_linenumber AS slot, l_partkey AS part FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5))""")
def semi_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey < 5")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return rows.select(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("part"))


@query("SELECT c_custkey AS node, c_name AS name FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') o ON o_custkey = c_custkey")
def anti_orphans(spark, sf_dir):
    """Customers that no urgent order reaches."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"))
    return tree.orphans(c, table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("node")))


@query(f"""WITH {EVENTS}, t AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'purchase'), r AS (SELECT user_id, max(us) AS seq FROM ev WHERE event_type = 'error' GROUP BY user_id)
    SELECT event_id, user_id FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = t.user_id AND r.seq >= t.us)""")
def conditional_anti_revoke(spark, sf_dir):
    e = _events(spark, sf_dir)
    t = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    # a revoke of the same or a later transaction drops the block: the latest one decides, so one row per key is enough
    r = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("us").alias("seq"))
    return t.join(r, (t["user_id"] == r["user_id"]) & (r["seq"] >= t["us"]), "left_anti").select("event_id", "user_id")


@query(f"""WITH {EVENTS} SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS k FROM ev) WHERE k = 1""")
def last_writer_wins(spark, sf_dir):
    return rank.best_per(_events(spark, sf_dir), ["user_id"], [F.desc("us"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(f"""WITH {EVENTS}, old AS (SELECT user_id, min(event_id) AS event_id FROM ev WHERE event_type = 'signup' GROUP BY user_id),
    new AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM ev WHERE event_type = 'view') WHERE k = 1)
    SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM old)""")
def insert_if_absent(spark, sf_dir):
    e = _events(spark, sf_dir)
    old = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return rank.insert_if_absent(old, e.where("event_type = 'view'"), ["user_id"], [F.asc("us"), F.asc("event_id")])


@query("""WITH old AS (SELECT o_custkey AS k, max(o_orderkey) AS v, 'old' AS origin FROM orders GROUP BY o_custkey), new AS (SELECT user_id AS k, max(event_id) AS v, 'new' AS origin FROM events GROUP BY user_id)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)""")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")).withColumn("origin", F.lit("old"))
    new = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("v")).withColumn("origin", F.lit("new"))
    return rank.upsert(old, new, ["k"])


@query(f"""WITH {EVENTS} SELECT user_id, event_type, min(us) AS first_seen, max(us) AS last_seen, count(DISTINCT event_id) AS versions, arg_max(event_id, us) AS newest,
    max(us) = (SELECT max(us) FROM ev) AS present FROM ev GROUP BY user_id, event_type""")
def first_last_seen_versions(spark, sf_dir):
    e = _events(spark, sf_dir)
    newest = e.agg(F.max("us").alias("top"))
    by = e.groupBy("user_id", "event_type").agg(F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.count_distinct("event_id").alias("versions"), F.max_by("event_id", "us").alias("newest"))
    # one row: the newest transaction of all
    return by.join(F.broadcast(newest), F.lit(True)).withColumn("present", F.col("last_seen") == F.col("top")).drop("top")


@query(f"""WITH {EVENTS}, s AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM ev)
    SELECT user_id, CAST(session AS BIGINT) AS session, arg_min(event_type, us) AS opened_by, count(*) AS records, CAST(arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), us) AS BIGINT) AS last_k FROM s GROUP BY user_id, session""")
def history_state_machine(spark, sf_dir):
    e = _events(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    s = e.withColumn("session", F.sum(F.col("event_type").isin("signup", "error").cast("long")).over(order))
    k = F.get_json_object("props", "$.k").cast("long")
    return s.groupBy("user_id", "session").agg(F.min_by("event_type", "us").alias("opened_by"), F.count("*").alias("records"), F.max_by(k, "us").alias("last_k"))


@query(f"""WITH {EVENTS}, made AS (SELECT user_id, us, event_id FROM ev WHERE event_type = 'signup'), gone AS (SELECT user_id, us, event_id FROM ev WHERE event_type = 'error')
    SELECT g.event_id AS destroyed, max(m.event_id) FILTER (m.us = l.us) AS created, count(m.event_id) AS candidates FROM gone g LEFT JOIN made m ON m.user_id = g.user_id AND m.us < g.us
    LEFT JOIN (SELECT g.event_id, max(m.us) AS us FROM gone g JOIN made m ON m.user_id = g.user_id AND m.us < g.us GROUP BY g.event_id) l ON l.event_id = g.event_id GROUP BY g.event_id""")
def match_history_window(spark, sf_dir):
    # creates before each destroy are those seen so far in the key's order: one window, no join
    e = _events(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    before = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    made = F.when(F.col("event_type") == "signup", F.col("event_id"))
    seen = e.select("event_type", F.col("event_id").alias("destroyed"), F.last(made, True).over(before).alias("created"), F.count(made).over(before).alias("candidates"))
    return seen.where("event_type = 'error'").select("destroyed", "created", "candidates")


@query(f"""WITH {EVENTS} SELECT txg, event_id, user_id FROM (SELECT us // 60000000 AS txg, *, row_number() OVER (PARTITION BY us // 60000000 ORDER BY event_type = 'error', value DESC, event_id) AS k FROM ev) WHERE k = 1""")
def keep_best_per_txg(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("txg", F.floor(F.col("us") / 60000000))
    return rank.best_per(e, ["txg"], [F.asc(F.col("event_type") == "error"), F.desc("value"), F.asc("event_id")]).select("txg", "event_id", "user_id")


@query(f"""WITH {BLOCKS} SELECT entry, slot, volume, blkid FROM (SELECT *, row_number() OVER (PARTITION BY entry, slot ORDER BY part DESC, volume, blkid) AS k FROM blocks) WHERE k = 1""")
def newest_candidate_argmax(spark, sf_dir):
    best = rank.best_per(blocks(spark, sf_dir), ["entry", "slot"], [F.desc("part"), F.asc("volume"), F.asc("blkid")])
    return best.select("entry", "slot", "volume", "blkid")


@query(f"""WITH {BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY part DESC, volume, blkid) AS k FROM blocks)
    SELECT entry, arg_min(volume, k) FILTER (status = 'ok') AS chosen, min(k) FILTER (status = 'ok') AS rank, count(*) AS candidates FROM r GROUP BY entry""")
def ranked_fallback_first_ok(spark, sf_dir):
    order = Window.partitionBy("entry").orderBy(F.desc("part"), "volume", "blkid")
    r = blocks(spark, sf_dir).withColumn("k", F.row_number().over(order).cast("long"))
    return rank.first_ok(r, ["entry"], F.col("k"), F.col("status") == "ok", "volume")


@query(f"""WITH {BLOCKS}, c AS (SELECT part, volume, count(*) AS votes FROM blocks GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY votes DESC, volume) AS k, CAST(sum(votes) OVER (PARTITION BY part) AS BIGINT) AS total FROM c)
    SELECT part, volume, votes, total, votes >= 0.9 * total AS placed FROM k WHERE k = 1""")
def majority_vote_placement(spark, sf_dir):
    return rank.majority(blocks(spark, sf_dir).select("part", "volume"), "part", "volume", 0.9).select("part", "volume", "votes", "total", "placed")


@query()
def cluster_components(spark, sf_dir):
    """Roots (orders) that share a key (a part bought at the same line) belong together. Hot keys are stars towards their least member, not pairs."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("root"), F.concat_ws(":", "l_partkey", "l_linenumber").alias("key"))
    least = cut(rows.groupBy("key").agg(F.min("root").alias("least")))
    found = connected_components(rows.join(least.hint("merge"), "key").select("root", "least"), "root", "least")
    return found.groupBy("component").agg(F.count("*").alias("roots"), F.max("node").alias("last"))


@query("""SELECT 'customer' || c_custkey AS node, r_name || '/' || n_name || '/' || c_name AS path, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'nation' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'region' || r_regionkey, r_name, 0 FROM region""")
def tree_paths(spark, sf_dir):
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    roots = table(spark, sf_dir, "region").select(key("region", "r_regionkey").alias("node"), F.col("r_name").alias("path"))
    n = table(spark, sf_dir, "nation").select(key("region", "n_regionkey").alias("parent"), key("nation", "n_nationkey").alias("child"), F.col("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(key("nation", "c_nationkey").alias("parent"), key("customer", "c_custkey").alias("child"), F.col("c_name").alias("name"))
    return tree.level_walk(roots, n.unionByName(c))


@query("""SELECT r_name AS root, n_name AS child, count(c_custkey) AS leaves FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def level_walk_expand(spark, sf_dir):
    n = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = table(spark, sf_dir, "customer").groupBy("c_nationkey").count()
    return n.join(leaves, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("r_name").alias("root"), F.col("n_name").alias("child"), F.coalesce("count", F.lit(0)).alias("leaves"))


@query("""WITH m AS (SELECT s_nationkey, count(*) AS n, max(s_suppkey) AS newest FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey)
    SELECT n_name AS member, coalesce(n, 0) AS images, newest, CASE WHEN n IS NULL THEN 'missing' WHEN n > 4 THEN 'duplicate' WHEN newest < 60 THEN 'stale' ELSE 'present' END AS state FROM nation LEFT JOIN m ON s_nationkey = n_nationkey""")
def member_left_outer_state(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("newest"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 4, "duplicate").when(F.col("newest") < 60, "stale").otherwise("present")
    rows = table(spark, sf_dir, "nation").join(m, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("n_name").alias("member"), F.coalesce("n", F.lit(0)).alias("images"), "newest", state.alias("state"))


_BAD = "bad AS (SELECT DISTINCT l_suppkey % 5 AS member, l_orderkey // 64 AS region FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 35), members AS (SELECT range AS member FROM range(5)), health AS (SELECT member, count(region) AS bad FROM members LEFT JOIN bad USING (member) GROUP BY member), regions AS (SELECT DISTINCT o_orderkey // 64 AS region FROM orders)"


@query(f"""WITH {_BAD}, fine AS (SELECT region, member, bad FROM regions, health WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.region = regions.region AND b.member = health.member))
    SELECT r.region, arg_min(f.member, f.bad * 10 + f.member) AS member, count(f.member) AS choices FROM regions r LEFT JOIN fine f ON f.region = r.region GROUP BY r.region""")
def healthiest_region_choice(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 35")
    bad = lines.select((F.col("l_suppkey") % 5).alias("member"), F.floor(F.col("l_orderkey") / 64).alias("region")).distinct()
    # five members at most: their health is a row of the plan's own making
    health = F.broadcast(spark.range(5).withColumnRenamed("id", "member").join(bad, "member", "left").groupBy("member").agg(F.count("region").alias("bad")))
    regions = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 64).alias("region")).distinct()
    spread = regions.withColumn("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).join(health, "member")
    fine = spread.join(bad, ["region", "member"], "left_anti")
    chosen = fine.groupBy("region").agg(F.min_by("member", F.struct("bad", "member")).alias("member"), F.count("*").alias("choices"))
    return regions.join(chosen, "region", "left").select("region", "member", F.coalesce("choices", F.lit(0)).alias("choices"))


@query(f"""WITH {BLOCKS} SELECT entry, bool_or(s_acctbal IS NULL OR s_acctbal < 0) AS could_help, count_if(s_acctbal IS NULL)::BIGINT AS unknown FROM blocks LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 != 3) ON s_suppkey = volume WHERE status = 'cksum_mismatch' GROUP BY entry""")
def member_help_bool_or(spark, sf_dir):
    lost = blocks(spark, sf_dir).where("status = 'cksum_mismatch'")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 10 != 3")
    joined = lost.join(s, F.col("s_suppkey") == F.col("volume"), "left")
    return joined.groupBy("entry").agg(F.bool_or(F.col("s_acctbal").isNull() | (F.col("s_acctbal") < 0)).alias("could_help"), F.count_if(F.col("s_acctbal").isNull()).alias("unknown"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, arg_max(event_id, us) AS copy FROM ev GROUP BY user_id) SELECT o_orderkey AS home, coalesce(copy, o_orderkey) AS block, copy IS NOT NULL AS overlaid FROM orders LEFT JOIN o ON user_id = o_orderkey""")
def overlay_coalesce(spark, sf_dir):
    overlay = _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", "us").alias("copy"))
    rows = table(spark, sf_dir, "orders").join(overlay, F.col("user_id") == F.col("o_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("home"), F.coalesce("copy", "o_orderkey").alias("block"), F.col("copy").isNotNull().alias("overlaid"))


@query("""WITH a AS (SELECT doc_id AS k, sha256(text) AS h FROM documents WHERE doc_id % 3 != 0), b AS (SELECT doc_id AS k, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 4 != 0)
    SELECT CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN a.h = b.h THEN 'same' ELSE 'different' END AS verdict, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def hash_compare_full_outer(spark, sf_dir):
    """Two copies of a tree compared by digest: the first lacks every third file, the second every fourth and has some changed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "text")
    a = d.where("k % 3 != 0").select("k", F.sha2("text", 256).alias("ha"))
    b = d.where("k % 4 != 0").select("k", F.sha2(F.when(F.col("k") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("hb"))
    both = a.join(b, "k", "full")
    verdict = F.when(F.col("ha").isNull(), "extra").when(F.col("hb").isNull(), "missing").when(F.col("ha") == F.col("hb"), "same").otherwise("different")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, sha256(text) AS digest, CASE WHEN lang = 'en' THEN 3 WHEN lang = 'fr' THEN 2 ELSE 1 END AS strength FROM documents)
    SELECT digest, doc_id, echoes FROM (SELECT *, count(*) OVER (PARTITION BY digest) - 1 AS echoes, row_number() OVER (PARTITION BY digest ORDER BY strength DESC, doc_id) AS k FROM d) WHERE k = 1""")
def echo_dedupe_by_digest(spark, sf_dir):
    strength = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "fr", 2).otherwise(1)
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), strength.alias("strength"))
    # min_by and count merge before the shuffle, so a digest that fills a third of the rows is no hot key
    return d.groupBy("digest").agg(F.min_by("doc_id", F.struct(-F.col("strength"), F.col("doc_id"))).alias("doc_id"), (F.count("*") - 1).alias("echoes"))


@query("""WITH s AS (SELECT doc_id, unnest(range(0, 8)) AS i, text, length(text) AS n FROM documents), o AS (SELECT doc_id, substr(text, CAST(i * n // 8 AS BIGINT) + 1, 16) AS a, substr(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END, CAST(i * n // 8 AS BIGINT) + 1, 16) AS b FROM s)
    SELECT doc_id, bool_and(a = b) AS alike FROM o GROUP BY doc_id""")
def sampled_compare(spark, sf_dir):
    """Two copies compared at eight places each."""
    n = F.length("text")
    other = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    at = lambda t, i: F.substring(t, (F.floor(i * n / 8) + 1).cast("int"), F.lit(16))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.forall(F.sequence(F.lit(0), F.lit(7)), lambda i: at(F.col("text"), i) == at(other, i)).alias("alike"))


@query("SELECT event_type, bool_or(value > 99) AS any_high, bool_and(value >= 0) AS all_positive, count_if(value < 10)::BIGINT AS low FROM events GROUP BY event_type")
def bool_expr_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.bool_or(F.col("value") > 99).alias("any_high"), F.bool_and(F.col("value") >= 0).alias("all_positive"), F.count_if(F.col("value") < 10).alias("low"))


@query(f"WITH {EVENTS} SELECT count(*) AS n, min(us) AS first, max(us) AS last, count(DISTINCT user_id) AS users, max(value) AS largest, arg_max(event_id, us) AS newest FROM ev")
def scalar_multi_agg(spark, sf_dir):
    return _events(spark, sf_dir).agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"), F.count_distinct("user_id").alias("users"), F.max("value").alias("largest"), F.max_by("event_id", "us").alias("newest"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, event_type FROM ev ORDER BY us DESC, event_id DESC LIMIT 1")
def latest_row(spark, sf_dir):
    return _events(spark, sf_dir).orderBy(F.desc("us"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_type != 'PROMO', p_name, p_partkey LIMIT 50")
def sort_by_expression(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.col("p_type") != "PROMO", "p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query(f"""WITH {EVENTS}, s AS (SELECT us // 1000000 AS sec, user_id, CAST(round(value * 100) AS BIGINT) AS cents, event_id FROM ev)
    SELECT event_id, round(sum(cents) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) / 86400.0, 9) AS rate FROM s""")
def sliding_rate_60s(spark, sf_dir):
    """Rate over a sliding span per key. The span is a day here: a minute would hold one of these events."""
    s = _events(spark, sf_dir).select("event_id", "user_id", F.floor(F.col("us") / 1000000).alias("sec"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return fold.rate(s, "user_id", "sec", "cents", 86400).select("event_id", F.round("rate", 9).alias("rate"))


@query(f"""WITH {EVENTS}, m AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 86400000000 THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS session FROM m)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS start, max(us) AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def gap_session_windows(spark, sf_dir):
    s = fold.gap_sessions(_events(spark, sf_dir), "user_id", "us", F.col("us"), F.col("us"), 86400000000)
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.min("us").alias("start"), F.max("us").alias("end"), F.count("*").alias("n"))


@query()
def capped_windows_fold(spark, sf_dir):
    """Read windows per device: joined over gaps of 16, 4000 long at most."""
    from siltline.plans.registry import ranges

    return fold.capped_windows(ranges(spark, sf_dir), "dev", 16, 4000)


@query()
def batches_on_disk_order(spark, sf_dir):
    """Files of each customer in order, in batches that close once they reach 300000."""
    files = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("file"), F.floor("o_totalprice").cast("long").alias("size"))
    return fold.batched(files, "o_custkey", "file", "size", 300000).select("o_custkey", "file", "batch")


@query("SELECT l_orderkey AS entry, CAST(bit_or(1 << (l_linenumber - 1)) AS BIGINT) AS present, bit_count(CAST(bit_or(1 << (l_linenumber - 1)) AS BIGINT))::INT AS members FROM lineitem GROUP BY l_orderkey")
def member_bitmask(spark, sf_dir):
    mask = F.bit_or(F.expr("shiftleft(1L, l_linenumber - 1)"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entry")).agg(mask.alias("present"), F.bit_count(mask).alias("members"))


@query("""WITH a AS (SELECT o_orderkey AS k, 0 AS src FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT l_orderkey AS k, 1 AS src FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT k, min(src) AS first_src, count(DISTINCT src) = 2 AS in_both FROM c GROUP BY k""")
def ordered_distinct_union(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("src"))
    b = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("src"))
    return a.unionAll(b).groupBy("k").agg(F.min("src").alias("first_src"), (F.count_distinct("src") == 2).alias("in_both"))


@query("""SELECT o_orderkey AS unit FROM orders WHERE o_orderstatus != 'P' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F'""")
def remaining_units(spark, sf_dir):
    units = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("unit"))
    return units.subtract(table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey"))


@query("""SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45""")
def recorded_and_selected(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey"))
