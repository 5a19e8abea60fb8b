"""Reads with gaps, jobs and their progress, resumption, evidence and restore scripts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import siltline.functions as S
from siltline.operators import extract
from siltline.plans.registry import BLOCKS, blocks, query
from siltline.session import table

#: Requests of 16-byte blocks, from orders; the data of a block are its part number as 16 hexadecimal digits.
_ASKED = "asked AS (SELECT o_orderkey AS id, o_custkey % 100 + 1 AS volume, (o_orderkey * 7) % 9000 AS off, o_custkey % 90 + 1 AS len FROM orders)"


def _read(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100 + 1).alias("volume"), ((F.col("o_orderkey") * 7) % 9000).alias("offset"), (F.col("o_custkey") % 90 + 1).alias("length"))
    data = F.lpad(F.lower(F.hex("part")), 16, "0").cast("binary")
    return extract.read_volume(asked, blocks(spark, sf_dir).select("volume", "blkid", "status", data.alias("data")), 16)


_PIECES = f"""{BLOCKS}, {_ASKED},
    cut AS (SELECT id, volume, off, len, unnest(range(off // 16, (off + len - 1) // 16 + 1)) AS blkid FROM asked),
    piece AS (SELECT id, off, c.blkid, greatest(c.blkid * 16, off) AS lo, least(c.blkid * 16 + 16, off + len) AS hi, CASE WHEN status IS NULL THEN 'no_metadata' WHEN status IN ('ok', 'hole') THEN NULL ELSE status END AS reason,
              CASE WHEN status = 'ok' THEN lpad(lower(hex(part)), 16, '0') ELSE repeat('_', 16) END AS data FROM cut c LEFT JOIN blocks b ON b.volume = c.volume AND b.blkid = c.blkid)"""


@query(f"""WITH {_PIECES} SELECT id, string_agg(substr(data, CAST(lo - blkid * 16 + 1 AS INTEGER), CAST(hi - lo AS INTEGER)), '' ORDER BY blkid) AS data FROM piece GROUP BY id""")
def volume_reads(spark, sf_dir):
    """Bytes of each request, gaps and holes as zeros (shown as _)."""
    return _read(spark, sf_dir).select("id", F.translate(F.decode("data", "ISO-8859-1"), "\0", "_").alias("data"))


@query(f"""WITH {_PIECES}, marked AS (SELECT *, CASE WHEN lag(hi) OVER w = lo AND lag(reason) OVER w = reason THEN 0 ELSE 1 END AS new FROM piece WHERE reason IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY lo)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY lo) AS island FROM marked)
    SELECT id, min(lo - off) AS start, max(hi - off) AS "end", reason FROM islands GROUP BY id, island, reason""")
def volume_read_gaps(spark, sf_dir):
    return _read(spark, sf_dir).select("id", F.explode("gaps").alias("g")).select("id", "g.start", "g.end", "g.reason")


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS text
    FROM (SELECT event_id, (event_id * 37) % 9000 AS s FROM events)""")
def human_durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.human_seconds((F.col("event_id") * 37) % 9000).alias("text"))


_DEST = "dest AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '/mnt/' || c_name WHEN 1 THEN 'ops@' || lower(c_mktsegment) || ':/srv/' || c_custkey WHEN 2 THEN 'host' || c_nationkey || ':' WHEN 3 THEN './' || c_name || ':x' ELSE c_name END AS text FROM customer)"


@query(rf"""WITH {_DEST} SELECT k, CASE WHEN remote THEN regexp_extract(text, '^([^:/\\\s]+):(.*)$', 1) END AS host,
    CASE WHEN NOT remote THEN text WHEN regexp_extract(text, '^([^:/\\\s]+):(.*)$', 2) = '' THEN '.' ELSE regexp_extract(text, '^([^:/\\\s]+):(.*)$', 2) END AS path
    FROM (SELECT k, text, regexp_matches(text, '^[^:/\\\s]+:') AND NOT regexp_matches(text, '^([A-Za-z]:[\\/]|[/.~\\])') AS remote FROM dest)""")
def destinations(spark, sf_dir):
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat(F.lit("/mnt/"), "c_name")).when(k == 1, F.concat(F.lit("ops@"), F.lower("c_mktsegment"), F.lit(":/srv/"), F.col("c_custkey").cast("string")))
    text = text.when(k == 2, F.concat(F.lit("host"), F.col("c_nationkey").cast("string"), F.lit(":"))).when(k == 3, F.concat(F.lit("./"), "c_name", F.lit(":x"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), S.destination(text).alias("d")).select("k", "d.host", "d.path")


@query("""WITH t AS (SELECT l_orderkey, l_partkey % 256 AS code FROM lineitem)
    SELECT code, CASE WHEN code & 128 != 0 THEN 'newtype(' || (code & 31) || CASE WHEN code & 64 != 0 THEN ',meta' ELSE '' END || CASE WHEN code & 32 != 0 THEN ',enc' ELSE '' END || ')'
        WHEN code = 10 THEN 'DNODE' WHEN code = 19 THEN 'PLAIN_FILE_CONTENTS' WHEN code = 23 THEN 'ZVOL' WHEN code >= 54 THEN 'type' || code ELSE 'known' END AS name,
        code < 54 OR (code & 128 != 0 AND (code & 31) <= 9) AS valid, count(*) AS n FROM t GROUP BY code""")
def block_types(spark, sf_dir):
    """Names of block types; those of the table other than three are shown as known."""
    code = F.col("l_partkey") % 256
    name = S.block_type(code)
    shown = F.when((code < 54) & ~name.isin("DNODE", "PLAIN_FILE_CONTENTS", "ZVOL") & name.isin(*S.BLOCK_TYPES), "known").otherwise(name)
    rows = table(spark, sf_dir, "lineitem").select(code.alias("code"), shown.alias("name"), S.block_type_valid(code).alias("valid"))
    return rows.groupBy("code", "name", "valid").agg(F.count("*").alias("n"))


_JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS pid, epoch(o_orderdate)::BIGINT AS started, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 END AS exit_code, o_orderkey % 5 = 1 AS asked FROM orders),
    alive AS (SELECT c_custkey AS pid FROM customer WHERE c_acctbal > 0)"""


def _jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("pid"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("started"), F.when(k % 3 == 0, k % 2).alias("exit_code"), (k % 5 == 1).alias("asked"))
    alive = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("pid"), F.lit(True).alias("lives"))
    rows = jobs.join(alive, "pid", "left")
    state = F.when(F.col("exit_code") == 0, "done").when(F.col("exit_code").isNotNull(), "failed").when(F.col("lives"), "running").otherwise("failed")
    return rows.withColumn("state", state)


@query(f"""WITH {_JOBS} SELECT id, state, asked AND state = 'running' AS cancelling FROM (
    SELECT id, asked, CASE WHEN exit_code = 0 THEN 'done' WHEN exit_code IS NOT NULL THEN 'failed' WHEN a.pid IS NOT NULL THEN 'running' ELSE 'failed' END AS state FROM jobs LEFT JOIN alive a USING (pid))""")
def job_states(spark, sf_dir):
    """Jobs by their exit record, else by whether their process lives; a cancel flag counts while they run."""
    return _jobs(spark, sf_dir).select("id", "state", (F.col("asked") & (F.col("state") == "running")).alias("cancelling"))


@query("""WITH s AS (SELECT event_id, user_id AS job, CAST(floor(epoch(ts)) AS BIGINT) AS updated, event_type = 'view' AS runs FROM events), t AS (SELECT max(updated) AS now FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY updated DESC, event_id DESC) AS k FROM s)
    SELECT job, updated, runs, runs AND now - updated > 120 AS stale FROM p, t WHERE k = 1 AND (now - updated < 3600 OR (runs AND now - updated < 86400))""")
def progress_snapshots(spark, sf_dir):
    """The last snapshot of each run: finished ones for an hour, running ones for a day, stale after two minutes."""
    from siltline.operators.rank import best_per

    s = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("updated"), (F.col("event_type") == "view").alias("runs"))
    now = s.agg(F.max("updated").alias("now"))
    age = F.col("now") - F.col("updated")
    last = best_per(s, ["job"], [F.desc("updated"), F.desc("event_id")]).crossJoin(F.broadcast(now))  # one row
    return last.where((age < 3600) | (F.col("runs") & (age < 86400))).select("job", "updated", "runs", (F.col("runs") & (age > 120)).alias("stale"))


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey AS pool, o_orderdate AS opened_at, o_orderpriority AS path FROM orders), l AS (SELECT pool, max(opened_at) AS opened_at FROM e GROUP BY pool)
    SELECT DISTINCT pool, path FROM e JOIN l USING (pool, opened_at)""")
def latest_run_paths(spark, sf_dir):
    """The evidence of each pool's latest run, every path once."""
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pool"), F.col("o_orderdate").alias("opened_at"), F.col("o_orderpriority").alias("path"))
    return e.join(e.groupBy("pool").agg(F.max("opened_at").alias("opened_at")), ["pool", "opened_at"]).select("pool", "path").distinct()


@query(f"""WITH {BLOCKS}, r AS (SELECT part, volume, count(*) FILTER (status = 'cksum_mismatch') AS errors FROM blocks GROUP BY ALL), a AS (SELECT volume, sum(errors) AS all_errors FROM r GROUP BY volume)
    SELECT part, volume, CAST(row_number() OVER (PARTITION BY part ORDER BY all_errors, volume) AS BIGINT) AS turn FROM r JOIN a USING (volume)""")
def members_by_errors(spark, sf_dir):
    """In which order the members that hold a block are read: those with fewer failed checksums over all first."""
    r = blocks(spark, sf_dir).groupBy("part", "volume").agg(F.count_if(F.col("status") == "cksum_mismatch").alias("errors"))
    errors = r.groupBy("volume").agg(F.sum("errors").alias("all_errors"))
    turn = F.row_number().over(Window.partitionBy("part").orderBy("all_errors", "volume"))
    return r.join(errors, "volume").select("part", "volume", turn.cast("long").alias("turn"))


@query(f"""WITH {BLOCKS} SELECT volume, blkid // 64 AS chunk, count(*) AS candidates, count_if(status = 'ok')::BIGINT AS hits, count_if(status != 'ok' AND word % 2 = 0)::BIGINT AS ambiguous, CAST(sum(word) AS BIGINT) AS bytes FROM blocks GROUP BY ALL""")
def chunk_counters(spark, sf_dir):
    """Counters of each chunk of a scan."""
    ok = F.col("status") == "ok"
    return blocks(spark, sf_dir).groupBy("volume", F.floor(F.col("blkid") / 64).alias("chunk")).agg(
        F.count("*").alias("candidates"), F.count_if(ok).alias("hits"), F.count_if(~ok & (F.col("word") % 2 == 0)).alias("ambiguous"), F.sum("word").alias("bytes")
    )


@query(f"""WITH {BLOCKS}, mask AS (SELECT entry % 50 AS top, CAST(bit_or(1 << CAST(volume % 8 AS INTEGER)) AS BIGINT) AS mask FROM blocks GROUP BY 1),
    unit AS (SELECT DISTINCT entry % 50 AS top, blkid // 32 AS chunk FROM blocks), done AS (SELECT DISTINCT entry % 50 AS top, blkid // 32 AS chunk, 255 AS mask FROM blocks WHERE kind = 'F')
    SELECT top, chunk, mask FROM unit JOIN mask USING (top) ANTI JOIN done USING (top, chunk, mask)""")
def pending_row_chunks(spark, sf_dir):
    """Chunks not yet scanned with the members there are now: another member makes all of them pending again."""
    b = blocks(spark, sf_dir).withColumns({"top": F.col("entry") % 50, "chunk": F.floor(F.col("blkid") / 32)})
    mask = b.groupBy("top").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("volume") % 8).cast("int"))).alias("mask"))
    done = b.where("kind = 'F'").select("top", "chunk", F.lit(255).cast("long").alias("mask")).distinct()
    return b.select("top", "chunk").distinct().join(mask, "top").join(done, ["top", "chunk", "mask"], "left_anti").select("top", "chunk", "mask")


@query("""WITH wanted AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders), there AS (SELECT l_orderkey AS id, max(CAST(floor(l_extendedprice) AS BIGINT)) AS size FROM lineitem GROUP BY 1)
    SELECT w.id, CASE WHEN t.id IS NULL THEN 'missing' WHEN t.size = w.size THEN 'there' ELSE 'size differs' END AS state FROM wanted w LEFT JOIN there t USING (id)""")
def already_there(spark, sf_dir):
    """Which outputs a run that resumes need not write: those that exist with their size."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("size"))
    there = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.floor("l_extendedprice")).alias("found"))
    return wanted.join(there, "id", "left").select("id", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("size"), "there").otherwise("size differs").alias("state"))


@query(f"""WITH {BLOCKS}, known AS (SELECT DISTINCT volume, part FROM blocks WHERE kind = 'F')
    SELECT b.volume, b.part, min(b.blkid) AS first, count(*) AS n, sha256(CAST(b.part AS VARCHAR)) AS cksum FROM blocks b ANTI JOIN known k USING (volume, part) WHERE slot = 2 GROUP BY ALL""")
def carved_orphans_of_a_level(spark, sf_dir):
    """Carved blocks of one level whose place no pointer knows, with the checksum of what was found."""
    b = blocks(spark, sf_dir)
    known = b.where("kind = 'F'").select("volume", "part").distinct()
    rows = b.where("slot = 2").join(known, ["volume", "part"], "left_anti").groupBy("volume", "part").agg(F.min("blkid").alias("first"), F.count("*").alias("n"))
    return rows.withColumn("cksum", F.sha2(F.col("part").cast("string"), 256))


@query(f"""WITH {BLOCKS}, spans AS (SELECT volume, blkid // 16 AS span, list(part ORDER BY blkid) AS words, list(status ORDER BY blkid) AS states FROM blocks GROUP BY ALL)
    SELECT volume, span * 16 + i AS blkid, words[CAST(i + 1 AS INTEGER)] AS part, states[CAST(i + 1 AS INTEGER)] AS status FROM (SELECT *, unnest(range(0, len(words))) AS i FROM spans)""")
def span_rows(spark, sf_dir):
    """Spans of sixteen packed slots as rows."""
    x = F.sort_array(F.collect_list(F.struct("blkid", "part", "status")))
    spans = blocks(spark, sf_dir).groupBy("volume", F.floor(F.col("blkid") / 16).alias("span")).agg(x.alias("x"))
    return spans.select("volume", "span", F.posexplode("x").alias("i", "s")).select("volume", (F.col("span") * 16 + F.col("i")).alias("blkid"), "s.part", "s.status")


_TREE = """tree AS (SELECT '/' || r_name AS path, '/' || r_name AS local, 'dir' AS type, r_regionkey AS k FROM region
    UNION ALL SELECT '/' || r_name || '/' || n_name, '/' || r_name || '/' || n_name, 'dir', 10 + n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT '/' || r_name || '/' || n_name || '/it''s ' || s_name, '/' || r_name || '/' || n_name || '/it%27s ' || s_name, 'file', 100 + s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


@query(rf"""WITH {_TREE}, r AS (SELECT ltrim(path, '/') AS p, ltrim(local, '/') AS l, type, k, len(string_split(ltrim(path, '/'), '/')) AS depth FROM tree),
    q AS (SELECT *, '''' || replace(p, '''', '''\''''') || '''' AS qp, '''' || replace(l, '''', '''\''''') || '''' AS ql FROM r),
    meta AS (SELECT *, 'chown -h ' || k || ':100 -- ' || qp || '; chmod 0755 -- ' || qp || '; touch -d @' || (k * 1000) || ' -- ' || qp AS line FROM q),
    s AS (SELECT 1 AS step, -depth AS d, p, 'mv -n -- ' || ql || ' ' || qp AS line FROM q WHERE p != l
          UNION ALL SELECT 3, 0, p, line FROM meta WHERE type = 'file' UNION ALL SELECT 4, -depth, p, line FROM meta WHERE type = 'dir')
    SELECT CAST(row_number() OVER (ORDER BY step, d, p COLLATE C) AS BIGINT) AS n, line FROM s""".replace(" COLLATE C", ""))
def restore_script_lines(spark, sf_dir):
    """The restore script of a tree of regions, nations and suppliers; one script is for one file system, so its lines are numbered."""
    t = lambda n: table(spark, sf_dir, n)
    region = F.concat(F.lit("/"), "r_name")
    nation = F.concat(region, F.lit("/"), "n_name")
    n = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    row = lambda path, local, kind, k: [path.alias("path"), local.alias("local"), F.lit(kind).alias("type"), k.cast("long").alias("uid")]
    tree = t("region").select(*row(region, region, "dir", F.col("r_regionkey")))
    tree = tree.unionByName(n.select(*row(nation, nation, "dir", F.col("n_nationkey") + 10)))
    tree = tree.unionByName(s.select(*row(F.concat(nation, F.lit("/it's "), "s_name"), F.concat(nation, F.lit("/it%27s "), "s_name"), "file", F.col("s_suppkey") + 100)))
    lines = extract.restore_script(tree.withColumns({"gid": F.lit(100), "mode": F.lit(0o755), "mtime": F.col("uid") * 1000, "link_target": F.lit(None).cast("string")}))
    return lines.select(F.row_number().over(Window.orderBy("k")).cast("long").alias("n"), "line")
