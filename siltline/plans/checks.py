"""Checksums, parity, layouts, text and semi-structured predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

import siltline.functions as S
from siltline.operators import checksum, parity, rank
from siltline.plans.registry import query
from siltline.session import table

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
_W = "w AS (SELECT l_orderkey AS k, CAST(l_partkey * 7919 + l_suppkey AS HUGEINT) AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
_MOD = "CAST({} % 18446744073709551616 AS DECIMAL(20,0))"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") * 7919 + F.col("l_suppkey")).alias("w"), *_ORDER)


@query(f"""WITH {_W}, r AS (SELECT *, CAST(n - i + 1 AS HUGEINT) AS r FROM w) SELECT k, {_MOD.format('sum(w)')} AS a, {_MOD.format('sum(r * w)')} AS b, {_MOD.format('sum(r * (r + 1) // 2 * w)')} AS c, {_MOD.format('sum(r * (r + 1) * (r + 2) // 6 * w)')} AS d FROM r GROUP BY k""")
def fletcher4_per_order(spark, sf_dir):
    return checksum.fletcher4(_words(spark, sf_dir), "k", _ORDER, "w")


@query(f"""WITH {_W}, l AS (SELECT *, (i + 1) % 2 AS lane FROM w), r AS (SELECT *, CAST((n + 1 - lane) // 2 - (i - 1) // 2 AS HUGEINT) AS r FROM l)
    SELECT k, {_MOD.format('sum(CASE WHEN lane = 0 THEN w ELSE 0 END)')} AS a0, {_MOD.format('sum(CASE WHEN lane = 0 THEN r * w ELSE 0 END)')} AS b0, {_MOD.format('sum(CASE WHEN lane = 1 THEN w ELSE 0 END)')} AS a1, {_MOD.format('sum(CASE WHEN lane = 1 THEN r * w ELSE 0 END)')} AS b1 FROM r GROUP BY k""")
def fletcher2_per_order(spark, sf_dir):
    return checksum.fletcher2(_words(spark, sf_dir), "k", _ORDER, "w")


@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN lang = 'de' THEN 'unverified' WHEN doc_id % 9 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents")
def sha256_documents(spark, sf_dir):
    digest = F.sha2("text", 256)
    stored = F.when(F.col("doc_id") % 9 == 0, F.lit("0")).otherwise(digest)
    return table(spark, sf_dir, "documents").select("doc_id", digest.alias("sha256"), checksum.verdict(stored, digest, F.col("lang") != "de").alias("status"))


@query("SELECT l_orderkey AS k, CAST(bit_xor(l_partkey % 256) AS BIGINT) AS p FROM lineitem GROUP BY l_orderkey")
def parity_p_xor(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(parity.p_parity(F.col("l_partkey") % 256).alias("p"))


@query("""SELECT l_orderkey AS k, CAST(list_reduce(list(l_partkey % 256 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity),
    lambda q, a: xor(xor((q << 1) & 255, CASE WHEN (q & 128) != 0 THEN 29 ELSE 0 END), a)) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey""")
def parity_q_gf256(spark, sf_dir):
    """Q parity of the data columns of each stripe; the last one has exponent 0."""
    group = Window.partitionBy("l_orderkey")
    i = F.row_number().over(group.orderBy(*_ORDER))
    d = table(spark, sf_dir, "lineitem").withColumn("e", (F.count("*").over(group) - i).cast("int"))
    return d.groupBy(F.col("l_orderkey").alias("k")).agg(parity.q_parity(F.col("l_partkey") % 256, F.col("e")).alias("q"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_partkey % 256 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem)
    SELECT k, max(b) FILTER (i = 1) AS rebuilt, count(*) AS width FROM s GROUP BY k""")
def parity_rebuild_missing(spark, sf_dir):
    """The first column of each stripe, from its parity and the columns that are left."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 256).alias("b"), i.alias("i"))
    stripes = s.groupBy("k").agg(parity.p_parity(F.col("b")).alias("p"), F.bit_xor(F.when(F.col("i") > 1, F.col("b"))).alias("left"), F.count("*").alias("width"))
    return stripes.select("k", F.col("p").bitwiseXOR(F.coalesce("left", F.lit(0).cast("long"))).alias("rebuilt"), "width")


@query("""SELECT l_suppkey AS child, l_orderkey AS row, l_linenumber AS slot, l_partkey AS part, CAST(bit_xor(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS folded FROM lineitem""")
def prefix_xor_window(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").rowsBetween(-3, 0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("child"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("part"), F.bit_xor("l_partkey").over(w).alias("folded"))


@query("""WITH s AS (SELECT o_orderkey AS k, 1 + CAST(floor(o_totalprice) AS BIGINT) % 64 AS n, 3 + o_custkey % 6 AS width FROM orders), q AS (SELECT *, n // (width - 2) AS full_rows, n % (width - 2) AS rest FROM s), t AS (SELECT *, n + 2 * (full_rows + CASE WHEN rest > 0 THEN 1 ELSE 0 END) AS total FROM q)
    SELECT k, full_rows, CASE WHEN rest > 0 THEN rest + 2 ELSE 0 END AS big_columns, (total + 2) // 3 * 3 AS allocated, (total + 2) // 3 * 3 - total AS skip_sectors FROM t""")
def raidz_map_columns(spark, sf_dir):
    """Striped layouts of double parity over 3 to 8 members."""
    n = 1 + F.floor("o_totalprice").cast("long") % 64
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *(c.cast("long").alias(a) for a, c in parity.stripe_columns(n, 3 + F.col("o_custkey") % 6, 2).items()))


@query("""WITH p AS (SELECT o_orderkey AS k, o_orderkey * 2654435761 + o_custkey AS w FROM orders) SELECT k, w & 65535 AS lsize, (w >> 16) & 255 AS psize, (w >> 24) & 127 AS comp, (w >> 32) & 31 AS level, (w >> 40) & 1 = 1 AS embedded FROM p""")
def bitfield_decode(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 2654435761 + F.col("o_custkey")).alias("w"))
    w = F.col("w")
    return p.select("k", S.bit_field(w, 0, 16).alias("lsize"), S.bit_field(w, 16, 8).alias("psize"), S.bit_field(w, 24, 7).alias("comp"), S.bit_field(w, 32, 5).alias("level"), (S.bit_field(w, 40, 1) == 1).alias("embedded"))


@query("""SELECT CASE WHEN substr(html, 1, 15) = '<!DOCTYPE html>' THEN 'html5' WHEN substr(html, 1, 5) = '<html' THEN 'html' WHEN substr(html, 1, 5) = '<?xml' THEN 'xml' ELSE 'unknown' END AS fstype, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1""")
def signature_identify(spark, sf_dir):
    """The first signature (offset, bytes) that matches names the kind."""
    signatures = [(0, "<!DOCTYPE html>", "html5"), (0, "<html", "html"), (0, "<?xml", "xml")]
    kind = F.lit("unknown")
    for offset, magic, name in reversed(signatures):
        kind = F.when(F.substring("html", offset + 1, len(magic)) == magic, name).otherwise(kind)
    return table(spark, sf_dir, "pages").groupBy(kind.alias("fstype")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query("""SELECT doc_id, TRY_CAST(('0x' || substr(hex(encode(text)), 1, 8)) AS BIGINT) AS be32 FROM documents WHERE strlen(text) >= 5 AND substr(hex(encode(text)), 9, 1) != '0' AND TRY_CAST(('0x' || substr(hex(encode(text)), 1, 8)) AS BIGINT) % 16 < 8""")
def header_prefilter(spark, sf_dir):
    """Blocks whose first four bytes, big-endian, and next token pass the header test."""
    h = F.hex(F.substring(F.col("text").cast("binary"), 1, 5))
    be32 = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    d = table(spark, sf_dir, "documents").where(F.octet_length("text") >= 5).select("doc_id", be32.alias("be32"), F.conv(F.substring(h, 9, 1), 16, 10).alias("nibble"))
    return d.where("nibble != '0' AND be32 % 16 < 8").select("doc_id", "be32")


@query("""SELECT l_orderkey AS block, count(*) AS slots, CAST(max(l_linenumber) AS BIGINT) AS levels FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity >= 5) AND count(DISTINCT l_linestatus) = 1 AND count_if(l_discount > 0) >= 1""")
def all_rows_valid_group(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block")).agg(
        F.count("*").alias("slots"), F.max("l_linenumber").cast("long").alias("levels"), F.bool_and(F.col("l_quantity") >= 5).alias("valid"), F.count_distinct("l_linestatus").alias("kinds"), F.count_if(F.col("l_discount") > 0).alias("set")
    )
    return g.where("valid AND kinds = 1 AND set >= 1").select("block", "slots", "levels")


@query("""SELECT page_id, url FROM pages WHERE url = 'http://ththre.example.com' OR starts_with(url, 'http://ththre.example.com/') OR url GLOB '*/en/*[0-9]#top'""")
def glob_prefix_select(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").where(S.glob(url, "http://ththre.example.com") | S.glob(url, "*/en/*[0-9]#top")).select("page_id", "url")


@query("SELECT page_id, url FROM pages WHERE contains(lower(html), 'the_') OR contains(lower(html), 'thth') ORDER BY page_id LIMIT 100")
def search_ilike_limit(spark, sf_dir):
    found = S.contains_text(F.col("html"), "The_") | S.contains_text(F.col("html"), "ThTh")
    return table(spark, sf_dir, "pages").where(found).orderBy("page_id").limit(100).select("page_id", "url")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 9 AND event_type != 'view'")
def json_predicate(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").where((k == 9) & (F.col("event_type") != "view")).select("event_id", "user_id")


@query("""SELECT CASE WHEN doc_id % 11 = 0 THEN 'zeroed' WHEN doc_id % 5 = 0 THEN 'cksum_mismatch' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1""")
def zero_test_case(spark, sf_dir):
    """A failed block of zero bytes only is zeroed, any other a mismatch."""
    data = F.when(F.col("doc_id") % 11 == 0, F.unhex(F.repeat(F.lit("00"), 64))).otherwise(F.col("text").cast("binary"))
    failed = (F.col("doc_id") % 11 == 0) | (F.col("doc_id") % 5 == 0)
    status = F.when(~failed, "ok").when(S.all_zero(data), "zeroed").otherwise("cksum_mismatch")
    return table(spark, sf_dir, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN n_chars * 997 >= 1048576 THEN CAST(CAST(round(n_chars * 997 / 1048576.0, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' MiB' WHEN n_chars * 997 >= 1024 THEN CAST(CAST(round(n_chars * 997 / 1024.0, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KiB' ELSE n_chars * 997 || ' B' END AS size, (n_chars + 511) // 512 * 512 AS rounded FROM documents""")
def human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.human_size(F.col("n_chars") * 997).alias("size"), S.round_up(F.col("n_chars"), 512).alias("rounded"))


@query(r"""SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent, regexp_extract(url, '[^/]*$') AS name, CAST(length(url) - length(replace(url, '/', '')) AS INTEGER) AS depth FROM pages""")
def path_parts_depth_sort(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.parent_of(url).alias("parent"), S.base_name(url).alias("name"), S.depth(url).alias("depth")).orderBy(F.desc("depth"), "page_id")


@query("""SELECT p_partkey, CASE WHEN k > 1 THEN p_name || '%~' || k ELSE p_name END AS target FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS k FROM part)""")
def collision_numbering(spark, sf_dir):
    return rank.number_collisions(table(spark, sf_dir, "part"), "p_brand", "p_name", [F.asc("p_partkey")]).select("p_partkey", "target")


@query("SELECT 4096 AS pos, 8192 AS \"end\", '-' AS status UNION ALL SELECT 16384, 20480, '*'")
def mapfile_text_parse(spark, sf_dir):
    """Ranges of a rescue map that were not read: comments, the status line, short and non-numeric lines are passed over."""
    from siltline.sources.rescue import bad_ranges

    lines = ["# Mapfile", "0x00000000     +", "0x0 0x1000 +", "0x1000 0x1000 -", "0x2000 0x2000 +", "0x4000 0x1000 *", "0x5000 x -", "# end"]
    text = spark.createDataFrame([(x,) for x in lines], "value string")
    return bad_ranges(text).select(F.col("pos").cast("int").alias("pos"), F.col("end").cast("int").alias("end"), "status")
