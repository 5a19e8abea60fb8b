"""SimHash near-duplicate groups with pigeonring filtering.

Links join fingerprints that differ in 3 bits or fewer. The 64 bits form a ring of 8 segments of 8.
If two fingerprints differ in at most 3 bits, some start on the ring has every chain of l consecutive
segments within its proportional budget, floor(3 l / 8): 0, 0, 1, 1, 1, 2, 2, 3 differing bits. So two
segments are equal and the three after them (24 bits) hold at most one difference: one of their
halves of 12 bits is equal too. Those 28 bits are the bucket key; each start gives two keys.
Pairs in a bucket must pass the whole chain before the full Hamming check.

Similarity of 0.8 or more (keep_one) is another matter: there 64 bits differ in 10 on average and in up to 24, and no key of
a chain within such a radius selects anything. So texts that share one of their least shingle hashes are the candidates, a
256-bit fingerprint takes the pigeonring filter (a ring of 4 segments of 64 bits) and the Hamming check, and the
exact similarity of the shingle sets decides.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.text import LANES, Rolling, raw_bytes, slices, split_words, wide_simhash, word_hashes
from siltline.operators.graph import connected_components
from siltline.session import cut, ship, written

RADIUS, SEGMENTS = 3, 8
WIDTH = 64 // SEGMENTS
#: Differing bits that a chain of 1, 2, ... segments may hold.
CHAIN = [RADIUS * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
#: Similarity of sets: least hashes that make candidates, set size below which ties matter.
SKETCH, SMALL = 12, 16
#: A key in more nodes than HOT is left out for nodes that have SPARE others.
HOT, SPARE = 1024, 9
#: Bytes of shingle sets compared in one block; rows that are broadcast at most (of one long each).
SET_BYTES, BROADCAST_ROWS = 8 << 20, 1 << 20
#: Links that a task holds before it contracts them.
LINKS = 1 << 18
#: Buckets above this many fingerprints are compared block by block; those of sets have smaller blocks.
BLOCK, SET_BLOCK = 4096, 512

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of one text; without words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[-n:] - 1).tolist(), strict=True)), np.uint64, n)
    counts = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp): one per row of docs; fp holds the 64 bits as a signed long. Other columns are not read."""

    def run(batches):
        for b in slices(batches, "t"):
            fps = np.array([fingerprint(x, shingle) for x in raw_bytes(b.column("t"))], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps)], ["id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def _rotated(fp: F.Column, by: int) -> F.Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _bucketed(fps: DataFrame) -> DataFrame:
    """Rows (key, fp): the two keys of each start on the ring; the key carries its kind in the low bits."""
    keys = []
    for i in range(SEGMENTS):
        turned = _rotated(F.col("fp"), i * WIDTH)
        top = F.shiftrightunsigned(turned, 36)  # 16 + 12 bits
        skip = F.shiftrightunsigned(turned, 48) * F.lit(4096) + F.shiftrightunsigned(turned, 24).bitwiseAND(F.lit(4095))
        keys += [top * 16 + F.lit(2 * i), skip * 16 + F.lit(2 * i + 1)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def _within(one: np.uint64, many: np.ndarray, start: int) -> np.ndarray:
    """Which of many pass the chain from that start, then the Hamming check."""
    by = np.uint64(start * WIDTH)
    differ = one ^ many
    ring = (differ << by) | (differ >> np.uint64(64 - int(by))) if start else differ
    ok = np.ones(len(many), bool)
    for n, most in enumerate(CHAIN, 1):
        ok &= np.bitwise_count(ring >> np.uint64(64 - n * WIDTH)) <= most
    return ok


def bucket_links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside one bucket of different fingerprints.

    Breadth-first from each fingerprint against those not yet reached: a dense group empties the rest
    at once, so the work stays near its size and no quadratic list of pairs is made.
    """
    rest, links = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = _within(one, rest, start)
            if near.any():
                found = rest[near]
                links += [(int(one), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return links


def links(fps: DataFrame) -> DataFrame:
    """Rows (src, dst) that connect different fingerprints within RADIUS; fps: distinct, column fp."""
    rows = _bucketed(fps)
    sizes = cut(rows.groupBy("key").count().where("count > 1"))
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, mine) * F.lit(1 << 15) + F.greatest(j, mine))
    dealt = (
        rows.join(sizes.select("key", blocks.alias("blocks")).hint("merge"), "key")
        .select("key", "fp", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(pairs)).alias("part"))
    )

    def flush(key: int, held: list[np.ndarray], out: list) -> None:
        fp = held[0] if len(held) == 1 else np.concatenate(held)
        if len(fp) > 1:
            out.extend(bucket_links(np.unique(fp).view(np.uint64), (key & 15) >> 1))

    def run(batches):
        last, held = None, []
        for b in batches:
            key, part, fp = (b.column(c).to_numpy() for c in ("key", "part", "fp"))
            if not len(fp):
                continue
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
            out: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                at = (int(key[lo]), int(part[lo]))
                if at != last:
                    if held:
                        flush(last[0], held, out)
                    last, held = at, []
                held.append(fp[lo:hi].copy())
            yield _pairs(out)
        if held:
            out = []
            flush(last[0], held, out)
            yield _pairs(out)

    ship(fps.sparkSession)
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "src long, dst long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["src", "dst"])


def components(prints: DataFrame) -> DataFrame:
    """Rows (fp, component_id) for the distinct fingerprints of prints (id, fp): the least id reachable."""
    least = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    nodes = connected_components(links(least.select("fp")))
    held = cut(least.join(nodes.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    # aggregates are cut off, so that the joins have plain exchanges on both sides and hot components can be split
    lowest = cut(held.groupBy("component").agg(F.min("least").alias("low"), F.count("*").alias("n")).where("n > 1").select("component", "low"))
    return held.join(lowest.hint("merge"), "component", "left").select("fp", F.coalesce("low", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): one per row of docs.

    Null and blank texts have fingerprint zero and are linked like any other. Ids decide nothing but
    the name of a component; null ids are passed over in it (null if it has no other). Repeated rows stay.
    Columns other than the two named are not read. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    named = components(prints)
    return prints.join(named.hint("merge"), "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# similarity of shingle sets


def radius_of(similarity: float, size: int = 1 << 20) -> int:
    """Bits of 256 within which sets of that Jaccard similarity lie, five deviations beyond the mean.

    The angle between two sets is widest when they are equal in size. In sets below SMALL ties of the signs add to it:
    the worst case, 4 shingles of 5, flips three bits in sixteen.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    p = max(p, 3 / 16) if size < SMALL else p
    return math.ceil(64 * LANES * p + 5 * math.sqrt(64 * LANES * p * (1 - p)))


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted different hashes of each text's word shingles; a text of fewer words is one shingle, one without words has none."""
    at, words = split_words(texts, lower=True)
    rolling = Rolling(word_hashes(words))
    out = []
    for lo, hi in pairwise(at.tolist()):
        n = min(shingle, hi - lo)
        out.append(np.unique(rolling.of(np.arange(lo, hi - n + 1), n)) if n else np.zeros(0, np.uint64))
    return out


def near(one: np.ndarray, size: int, prints: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which of `prints` (n x LANES) pass the ring of lanes, the Hamming check included, and the bound on sizes.

    The ring has a segment per lane. Of two fingerprints within the radius some start has every chain of l lanes within
    l / LANES of it; the chain of all lanes is the full check.
    """
    fewest = np.minimum(sizes, size)
    some = np.flatnonzero(fewest >= similarity * np.maximum(sizes, size) - 1e-9)
    lanes = np.bitwise_count(prints[some] ^ one)
    radius = np.where(fewest[some] < SMALL, radius_of(similarity, 0), radius_of(similarity))
    # the first segment of a start is within its share: that prunes nearly all
    first = lanes.min(1, initial=64) * LANES <= radius
    some, lanes, radius = some[first], lanes[first].astype(np.int64), radius[first]
    passed = np.zeros(len(some), bool)
    for start in range(LANES):
        held, chain = np.ones(len(some), bool), np.zeros(len(some), np.int64)
        for n in range(1, LANES + 1):
            chain += lanes[:, (start + n - 1) % LANES]
            held &= chain * LANES <= radius * n
        passed |= held
    out = np.zeros(len(prints), bool)
    out[some[passed]] = True
    return out


def forest(prints: np.ndarray, sizes: np.ndarray, similarity: float, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as places, of the pairs that pass near() and, with sets, have that similarity; breadth-first, so a dense group empties the rest at once."""
    rest, links = np.arange(len(prints)), []
    left, size = prints, sizes
    while len(rest):
        queue = [(int(rest[0]), left[0], int(size[0]))]
        rest, left, size = rest[1:], left[1:], size[1:]
        while queue and len(rest):
            one, fingerprint, n = queue.pop()
            found = np.flatnonzero(near(fingerprint, n, left, size, similarity))
            if sets is not None and len(found):
                found = found[jaccard(sets[one], [sets[i] for i in rest[found]]) >= similarity - 1e-12]
            if len(found):
                links += [(one, int(x)) for x in rest[found]]
                queue += [(int(rest[i]), left[i], int(size[i])) for i in found]
                stay = np.ones(len(rest), bool)
                stay[found] = False
                rest, left, size = rest[stay], left[stay], size[stay]
    return links


def jaccard(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Similarity of a sorted set to each of others."""
    length = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), max(len(one) - 1, 0))
    hit = (one[at] == flat) if len(one) else np.zeros(len(flat), bool)
    owner = np.repeat(np.arange(len(others)), length)
    shared = np.bincount(owner[hit], minlength=len(others))
    return shared / np.maximum(1, len(one) + length - shared)


SKETCH_COLUMNS = "row__ long, whole__ long, size__ int, print__ binary, keys__ array<long>"


def sketched(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """docs with SKETCH_COLUMNS, written: a key of the row, a hash of the whole shingle set, its size, its 256-bit SimHash and its SKETCH least hashes. No column of docs may have such a name."""
    names = [c.split()[0] for c in SKETCH_COLUMNS.split(", ")]
    kinds = [*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns), SKETCH_COLUMNS]

    def run(batches):
        row = TaskContext.get().partitionId() << 36
        for b in slices(batches, text_col):
            sets = shingle_sets(b.column(text_col), shingle)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array(row + np.arange(n)),
                    pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([wide_simhash(x).tobytes() for x in sets], pa.binary()),
                    pa.array([x[:SKETCH].view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                [*b.schema.names, *names],
            )
            row += n

    ship(docs.sparkSession)
    return written(docs.mapInArrow(run, ", ".join(kinds)), "sketched")


def _grouped(df: DataFrame, columns: list[str], handle, schema: str) -> DataFrame:
    """handle(rows of one (key, part): a list of columns' values) per group of a partition, as rows (src, dst): the links of a task, contracted."""

    def run(batches):
        last, held, links = None, [], []
        for b in batches:
            at = list(zip(b.column("key").to_pylist(), b.column("part").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
            for lo, hi in pairwise(cuts):
                if lo == hi:
                    continue
                if at[lo] != last:
                    if held:
                        links += handle(pa.Table.from_batches(held))
                    last, held = at[lo], []
                    if len(links) > LINKS:
                        yield _signed(stars(links))
                        links = []
                held.append(b.slice(lo, hi - lo))
        if held:
            links += handle(pa.Table.from_batches(held))
        yield _signed(stars(links))

    return df.select("key", "part", *columns).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, schema)


def stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The components of links as stars: each node with the least of its component."""
    group: dict[int, int] = {}

    def find(x: int) -> int:
        while group.setdefault(x, x) != x:
            group[x] = x = group[group[x]]
        return x

    for a, b in links:
        a, b = find(int(a)), find(int(b))
        group[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(group) if group[x] != x]


def _signed(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["src", "dst"])


def _dealt(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """rows with a part: groups of several blocks are dealt as pairs of blocks, each small."""
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(j, mine) * F.lit(1 << 15) + F.greatest(j, mine))
    return rows.withColumn("part", F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(pairs)))


def _prints(held: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(held.column("print").to_pylist()), np.uint64).reshape(-1, LANES)


def similar_rows(marked: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Rows (row, component) for the rows of sketched() texts whose shingle set is similar to another's or equal to it.

    Equal sets are one node. Nodes that share one of their SKETCH least hashes are candidates: two sets of similarity s
    share none with probability (1 - s) ** SKETCH at most (4e-9 at 0.8; sets of up to SKETCH / (1 - s) shingles always share one).
    A key in more than HOT nodes is left to the nodes that have fewer than SPARE other keys. Candidates pass the pigeonring
    filter and the Hamming check of their fingerprints; components of what is left are loose classes. Inside a class the shingle sets
    themselves are compared, and the components of those pairs are the result. Large groups are dealt as pairs of blocks.
    """
    nodes = marked.groupBy("whole__", "size__", "print__").agg(F.min("row__").alias("row"), F.count("*").alias("n"))
    nodes = cut(nodes.join(marked.select(F.col("row__").alias("row"), F.col("keys__").alias("keys")), "row").select("row", F.col("whole__").alias("whole"), F.col("size__").alias("size"), F.col("print__").alias("print"), "keys", "n"))
    rows = nodes.select("row", "size", "print", F.explode("keys").alias("key"))
    counts = cut(rows.groupBy("key").count().where("count > 1"))
    shared = rows.join(counts.hint("merge"), "key")
    hot = counts.where(F.col("count") > HOT)
    if not hot.isEmpty():
        spared = cut(shared.where(F.col("count") > HOT).groupBy("row").agg(F.count("*").alias("hot")).join(nodes.select("row", F.size("keys").alias("all")), "row").where(F.col("all") - F.col("hot") >= SPARE).select("row"))
        shared = shared.where(F.col("count") <= HOT).unionByName(shared.where(F.col("count") > HOT).join(spared, "row", "left_anti"))

    def loose(held: pa.Table) -> list[tuple[int, int]]:
        row = held.column("row").to_numpy()
        order = np.argsort(row)
        found = forest(_prints(held)[order], held.column("size").to_numpy()[order], similarity)
        return [(row[order[a]], row[order[b]]) for a, b in found]

    ship(marked.sparkSession)
    dealt = _dealt(shared, F.ceil(F.col("count") / SET_BLOCK).cast("int"))
    classes = cut(connected_components(_grouped(dealt, ["row", "size", "print"], loose, "src long, dst long")))
    members = nodes.select("row", "size", "print").join(classes.select(F.col("node").alias("row"), F.col("component").alias("key")), "row")
    weights = cut(members.groupBy("key").agg(F.count("*").alias("count"), F.sum(F.col("size").cast("long") * 8).alias("bytes")))

    def with_sets(batches):
        for b in slices(batches, "t"):
            sets = [x.tobytes() for x in shingle_sets(b.column("t"), shingle)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sets, pa.binary())], ["row", "set"])

    wanted = marked.select(F.col("row__").alias("row"), F.col(text_col).alias("t")).join(small(classes.select(F.col("node").alias("row"))), "row", "left_semi")
    sets = wanted.mapInArrow(with_sets, "row long, set binary")

    def exact(held: pa.Table) -> list[tuple[int, int]]:
        row = held.column("row").to_numpy()
        order = np.argsort(row)
        sets = [np.frombuffer(x, np.uint64) for x in held.column("set").to_pylist()]
        found = forest(_prints(held)[order], held.column("size").to_numpy()[order], similarity, [sets[i] for i in order])
        return [(row[order[a]], row[order[b]]) for a, b in found]

    dealt = _dealt(members.join(weights.hint("merge"), "key").join(sets, "row"), F.greatest(F.ceil(F.col("count") / SET_BLOCK), F.ceil(F.col("bytes") / SET_BYTES)).cast("int"))
    linked = cut(connected_components(_grouped(dealt, ["row", "size", "print", "set"], exact, "src long, dst long")))
    # back from nodes to rows: equal sets, and nodes that are linked
    named = nodes.select("whole", "size", "print", "n", "row").join(linked.withColumnRenamed("node", "row"), "row", "left").where("n > 1 OR component IS NOT NULL")
    named = cut(named.select("whole", "size", "print", F.coalesce("component", "row").alias("component")))
    same = (F.col("whole__") == F.col("whole")) & (F.col("size__") == F.col("size")) & (F.col("print__") == F.col("print"))
    return marked.select("row__", "whole__", "size__", "print__").join(named.hint("merge"), same).select(F.col("row__").alias("row"), "component")


def small(rows: DataFrame) -> DataFrame:
    """rows of one long column, broadcast if they are few (BROADCAST_ROWS), else as they are."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the least id, its id null only if all are.

    Texts are near duplicates at a Jaccard similarity of their different word shingles (A-Z lowered) of `similarity` or more, and
    groups are what such pairs connect. A text of fewer words than a shingle is one shingle; null and blank texts are
    equal to each other. Of rows that repeat the least id one stays. All columns stay as they are, whatever their names.
    """
    names = [c.split()[0] for c in SKETCH_COLUMNS.split(", ")]
    columns = docs.columns
    inner = [f"c{i}" for i in range(len(columns))]
    marked = sketched(docs.toDF(*inner), inner[columns.index(text_col)], shingle)
    groups = cut(similar_rows(marked, inner[columns.index(text_col)], shingle, similarity))
    ids = marked.select(F.col("row__").alias("row"), F.col(inner[columns.index(id_col)]).cast("long").alias("id"))
    key = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    ranked = groups.join(ids, "row").select("component", "row", key.alias("key"))
    least = cut(ranked.groupBy("component").agg(F.min("key").alias("least")))
    gone = ranked.join(least.hint("merge"), "component").where(F.col("row") != F.col("least.row")).select(F.col("row").alias("row__"))
    return marked.join(small(gone), "row__", "left_anti").drop(*names).toDF(*columns)
