"""N-gram Jaccard join: all pairs of documents whose sets of word shingles are similar enough, as components.

Words are runs of other characters than ASCII white space, A-Z lower-cased; a set holds the
distinct shingles of ``width`` words (hashed to 64 bits), or the whole sequence if it is shorter.
Two sets link when ``den * intersection >= num * union``, in integers.

How links are found without comparing all pairs, and without losing any:

1. Equal texts are one class: a node with a number of its own, the digest of its text and its least doc_id.
2. Sets are dealt to size bands (each ``RATIO`` times the one below; a set that may link into the next
   band goes there too).  In a band linked sets differ in at most k shingles, so of k + 1 + e parts
   (shingles dealt by hash) at least 1 + e are identical.  Each set gives the hash of every non-empty part
   as a key.  A set with more than e empty parts gives keys for the empty ones as well, so two sets that
   agree only in empty parts still meet.
3. Sets that share a key of a band are a group; of groups with the same members one is kept.
4. A group is cut into tiles of ``TILE`` sets of its size band, and the sets of two tiles are compared by hashed
   parity bitmaps.  A bit is the parity of the number of shingles that hash to it, so with d the
   number of bits in which two bitmaps differ, the sets differ in at least d shingles and the
   overlap is at most (|A| + |B| - d) / 2.  Only pairs of different components that pass this bound go on.
5. Pairs that pass are checked exactly by intersection of the sorted arrays of shingles.

Steps 4 and 5 go in rounds.  The first takes, in groups of up to ``SMALL`` sets, the likeliest partner
of each set, and of larger groups the pairs with one member, a star: in number as the
members, which is what large groups of near copies need.  Groups that then lie in one component are done.  The
second takes the likeliest partners in all groups that still span components, the third all their open pairs.

Components come from alternating large-star and small-star rounds, each cut off by a checkpoint.

Defined results: documents without words, and null texts, have 0 shingles and link with nothing;
rows that share a doc_id are a document each, with its own text and its own links; a null doc_id
has a null component and links with nothing; a table without rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support

U = np.uint64
RATIO, TILE, SMALL, LARGEST_BITMAP = 1.5, 1024, 64, 1 << 16
FEW = 200_000  # rows of two or three longs that may be broadcast
BUCKET = 4096  # rows of tiles that are compared in one call
CELLS = 1 << 18  # words of bitmaps that are compared at once
HEAP = 64  # rows of one key from which on a task sends them as one
KEYS = "key long, node long, n int, heap int"
TEXTS = "doc_id long, digest binary, n int, bitmap binary, text string"


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, and the least similarity num / den."""

    width: int = 3
    num: int = 90
    den: int = 100

    def most_apart(self, both: int) -> int:
        """The largest symmetric difference of linked sets of ``both`` elements in all."""
        return both * (self.den - self.num) // (self.den + self.num)

    def least_overlap(self, both):
        """The least intersection of linked sets of ``both`` elements in all: i * (den + num) >= num * both."""
        return -(-self.num * both // (self.den + self.num))


# -- shingles -------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = U(0x9E3779B97F4A7C15)
LEFT = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)  # the first n bytes of eight
SIDE_BY_SIDE = 64  # bytes of a word that are hashed in steps over all words; longer words go one by one


def word_hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits of each word, eight bytes a step, each step mixed through; long words by xxhash."""
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).data, strides=(1,))
    out = mix((length.astype(np.uint64) * STEP ^ (eights[start] & LEFT[np.minimum(length, 8)])) * STEP)
    going, at = np.flatnonzero(length > 8), 8
    while len(going) and at < SIDE_BY_SIDE:
        left = length[going] - at
        out[going] = mix((out[going] ^ (eights[start[going] + at] & LEFT[np.minimum(left, 8)])) * STEP + U(at))
        going, at = going[left > 8], at + 8
    for i in going:
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + length[i]].tobytes())
    return out


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    raw = np.frombuffer(text.encode(), np.uint8)
    space = SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.r_[0, edge]
    if len(raw) and not space[-1]:
        edge = np.append(edge, len(raw))
    if not len(edge):
        return np.empty(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    words = word_hashes(LOWER[raw], start, end - start)
    if len(words) < width:
        width = len(words)
    out = words[: len(words) - width + 1]
    for j in range(1, width):
        out = mix(out * STEP + words[j : len(words) - width + 1 + j])
    return np.unique(mix(out + U(width)))


# -- candidates -----------------------------------------------------------------------------


def band_of(n: int) -> int:
    return int(math.log(n) / math.log(RATIO) + 1e-9)


def band_top(band: int) -> int:
    """The largest size that ``band_of`` puts into the band or below."""
    top = int(RATIO ** (band + 1)) + 2
    while band_of(top) > band:
        top -= 1
    return top


def bands(n: int, rule: Rule) -> list[int]:
    """The bands in which a set of n meets others: its own, and above it those that a linked set may be in."""
    first, last = band_of(n), band_of(n * rule.den // rule.num)
    return list(range(first, last + 1))


def part_keys(found: np.ndarray, rule: Rule) -> np.ndarray:
    """The keys of a set in all its bands."""
    keys = []
    for band in bands(len(found), rule):
        k = rule.most_apart(2 * band_top(band))
        spare = (k + 1) // 12 + 1 if k else 0
        m = k + 1 + spare
        part = (found >> U(11)) % U(m)
        sums = np.zeros(m, np.uint64)
        order = np.argsort(part, kind="stable")
        sorted_part = part[order].astype(np.int64)
        begin = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]])
        full = sorted_part[begin]
        sums[full] = np.add.reduceat(mix(found[order] + U(band)), begin)
        salt = mix(np.arange(m, dtype=np.uint64) + U((band + 1) << 32))
        every = mix(sums + salt)
        keys.append(every if m - len(full) > spare else every[full])
    return np.concatenate(keys).view(np.int64)


def bitmap(found: np.ndarray) -> np.ndarray:
    """Packed parity bitmap: about as many bits as shingles, a power of two, so any two can be folded to one width."""
    bits = min(LARGEST_BITMAP, max(128, 1 << max(0, len(found) - 1).bit_length()))
    parity = np.bincount((found >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little")


def measured(rule: Rule):
    """A mapInArrow function: doc_id, digest, text -> the same with the number of shingles and their bitmap."""

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t.as_py(), rule.width) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int32()), pa.array([bitmap(x).tobytes() for x in sets], pa.binary()), part.column(2)], ["doc_id", "digest", "n", "bitmap", "text"])

    return task


def keyed(rule: Rule, heap: int):
    """A mapInArrow function: node, text -> a row for each key: key, node, n, heap (1).

    Where a task holds more than ``heap`` rows of one key, the first stands for them with their number in its ``heap``,
    and the others are followers, with 0.
    """

    def task(batches):
        for batch in batches:
            rows, held = [], 0
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py(), rule.width)
                keys = part_keys(found, rule)
                rows.append((keys, node, len(found)))
                held += len(keys)
                if held > 500_000:
                    yield key_batch(rows)
                    rows, held = [], 0
            if rows:
                yield key_batch(rows)

    def key_batch(rows):
        many = [len(r[0]) for r in rows]
        keys, node, n = np.concatenate([r[0] for r in rows]), np.repeat(np.array([r[1] for r in rows], np.int64), many), np.repeat(np.array([r[2] for r in rows], np.int32), many)
        _, first, which, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        stands = np.where((count > heap)[which], 0, 1).astype(np.int32)
        stands[first[count > heap]] = count[count > heap]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(n), pa.array(stands)], ["key", "node", "n", "heap"])

    return task


# -- checks ---------------------------------------------------------------------------------


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer bytes: positions are taken modulo the smaller power of two, parities add up."""
    while len(bits) > width:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def overlap_bound(a: np.ndarray, b: np.ndarray, both: int) -> int:
    """The most elements that two sets of ``both`` elements in all can share, by their bitmaps."""
    width = min(len(a), len(b))
    apart = int(np.bitwise_count((folded(a, width) ^ folded(b, width)).view(np.uint64)).sum())
    return (both - apart) // 2


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Intersection size of sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def pair_batch(left: list, right: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def left_open(rule: Rule):
    """A mapInArrow function over pairs with both bitmaps: the pairs that may link."""

    def task(batches):
        for batch in batches:
            a, b, n_a, n_b, bits_a, bits_b = (batch.column(i).to_pylist() for i in range(6))
            keep = [i for i in range(batch.num_rows) if overlap_bound(np.frombuffer(bits_a[i], np.uint8), np.frombuffer(bits_b[i], np.uint8), n_a[i] + n_b[i]) >= rule.least_overlap(n_a[i] + n_b[i])]
            yield pair_batch([a[i] for i in keep], [b[i] for i in keep])

    return task


def checked(rule: Rule):
    """A mapInArrow function over pairs with both texts, those of one a together: the pairs that link."""

    def task(batches):
        last, one = None, None
        for batch in batches:
            left, right = [], []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, one = a, shingles(text_a.as_py(), rule.width)
                other = shingles(text_b.as_py(), rule.width)
                if overlap(one, other) >= rule.least_overlap(len(one) + len(other)):
                    left.append(a)
                    right.append(b)
            yield pair_batch(left, right)

    return task


def few(frame: DataFrame) -> DataFrame:
    """The frame, to be broadcast if a count shows that it has at most ``FEW`` rows."""
    return F.broadcast(frame) if frame.count() <= FEW else frame


def as_side(frame: DataFrame, side: str, *more: str) -> DataFrame:
    return frame.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in more])


def open_by_bitmap(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Of distinct pairs a, b those that the bitmaps leave open."""
    pairs = few(support.cut(pairs))
    left, right = (pairs.join(as_side(texts, side, "n", "bitmap"), side) for side in "ab")
    return left.join(right, ["a", "b"]).select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(left_open(rule), "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Of distinct pairs a, b those that link.  Each pair takes one text along to the other one's."""
    pairs = support.cut(pairs)
    firsts = few(support.cut(pairs.select(F.col("a").alias("node")).distinct()))
    carried = few(pairs).join(as_side(texts, "b", "text"), "b")
    both = carried.join(as_side(texts.join(firsts, "node", "left_semi"), "a", "text"), "a")
    return support.cut(both.select("a", "b", "text_a", "text_b").mapInArrow(checked(rule), "a long, b long"))


def tile_pairs(rule: Rule, best: bool, node, n, comp, side, maps) -> np.ndarray:
    """Pairs of different components of one pair of tiles that the bitmaps leave open; or the likeliest one of each set."""
    width = min(len(x) for x in maps)
    bits = np.stack([folded(x, width) for x in maps]).view(np.uint64)
    same = bool((side == 2).all())
    lefts, rights = (np.arange(len(n)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    step = max(1, CELLS // max(1, len(rights) * bits.shape[1]))
    found = [np.empty((0, 2), np.int64)]
    for at in range(0, len(lefts), step):
        some = lefts[at : at + step]
        both = n[some][:, None] + n[rights]
        apart = np.bitwise_count(bits[some][:, None] ^ bits[rights]).sum(axis=2, dtype=np.int64)
        apart = np.maximum(apart, np.abs(n[some][:, None] - n[rights]))
        open_ = ((both - apart) // 2 >= rule.least_overlap(both)) & (comp[some][:, None] != comp[rights])
        if best:  # the partner that differs least for its size
            far = np.where(open_, apart / both, np.inf)
            near = far.argmin(axis=1) if far.size else np.empty(0, np.int64)
            rows = np.flatnonzero(open_.any(axis=1))
            i, j = some[rows], rights[near[rows]]
        else:
            rows, columns = np.nonzero(open_ & (node[some][:, None] < node[rights]) if same else open_)
            i, j = some[rows], rights[columns]
        found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
    return np.concatenate(found)


def tiles_compared(rule: Rule, best: bool):
    """An applyInArrow function over some pairs of tiles: the pairs of sets that are left open."""

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending")])
        key, low, high, side, node, n, comp = (table[c].to_numpy() for c in ("key", "low", "high", "side", "node", "n", "comp"))
        maps = [np.frombuffer(x, np.uint8) for x in table["bitmap"].to_pylist()]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
        parts = [tile_pairs(rule, best, node[i:j], n[i:j].astype(np.int64), comp[i:j], side[i:j], maps[i:j]) for i, j in zip([0, *cuts], [*cuts, len(key)]) if j - i > 1]
        pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *parts]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return task


# -- components -----------------------------------------------------------------------------


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, comp (the least node reachable) of all nodes of the links, by large-star and small-star rounds.

    Each round only takes the least neighbour of every node, which combines before it is shuffled.
    """
    edges = support.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        # The least neighbours are cut off, so a node with very many neighbours is split in the joins with them.
        ways = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = support.cut(ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = support.cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def distinct_texts(docs: DataFrame, rule: Rule) -> DataFrame:
    """A table of the distinct texts: node (a number), doc_id (the least, null where all are), digest, n, bitmap, text.

    The numbers stand in the written table, so they are the same for all that read it.
    """
    texts = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", digest_of("text").alias("digest"), "text")
    return support.table(texts.mapInArrow(measured(rule), TEXTS).withColumn("node", F.monotonically_increasing_id()), "texts")


def digest_of(column: str):
    return F.unhex(F.md5(column))


def linked(texts: DataFrame, rule: Rule) -> DataFrame:
    """node, comp (the least node reachable) of every one of ``distinct_texts`` that links with another."""
    used = texts.where("doc_id is not null and n > 0")
    # Followers of a heap are dealt by key and node, all others by key: a key that a large share of all documents
    # have comes to its task as a few rows of each other task.  One exchange serves both the groups and their
    # members (both read all its columns and filter nothing before it, so it is reused).
    spread = F.col("key").bitwiseXOR(F.xxhash64("node"))
    keys = used.select("node", "text").mapInArrow(keyed(rule, HEAP), KEYS).select(F.when(F.col("heap") == 0, spread).otherwise(F.col("key")).alias("deal"), "node", "n", "heap").repartition("deal")
    identity = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"x{i}") for i in range(2)]
    groups = keys.groupBy("deal").agg(F.sum("heap").alias("many"), F.max("heap").alias("heap"), F.min("node").alias("least"), F.max("node").alias("most"), F.max("n").alias("top"), *identity).where("(least <> most or heap > 1) and top > 0")
    # Of groups with the same members one is enough; a group with a heap is not known by its members here and stays.
    groups = groups.groupBy("many", F.when(F.col("heap") > 1, F.col("deal")).otherwise(F.col("x0")).alias("x0"), "x1").agg(F.min("deal").alias("deal")).select("deal", "many")
    held = keys.join(groups, "deal", "left").where("many is not null or heap = 0")
    unspread = F.col("deal").bitwiseXOR(F.xxhash64("node"))
    held = held.select(F.when(F.col("heap") == 0, unspread).otherwise(F.col("deal")).alias("key"), "node", "n", "heap", "many")
    members = written = support.table(support.fewer(held.repartition("node")), "members")
    heaps = support.cut(written.where("heap > 1").groupBy("key").agg(F.max("many").alias("many")))
    if heaps.limit(1).count():
        members = written.where("heap > 0").unionByName(written.where("heap = 0").drop("many").join(few(heaps), "key"))
    members = members.select("key", "node", "n", "many")
    if not members.limit(1).count():
        return texts.sparkSession.createDataFrame([], "node long, comp long")

    # Of a large group one member, the same one in all groups of a family, is the centre of a star.
    large = members.where(F.col("many") > SMALL)
    centres = support.cut(large.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node")).alias("c")))
    m, n = F.col("c.n").cast("long"), F.col("n").cast("long")
    fits = (F.greatest(n, m) * rule.num <= F.least(n, m) * rule.den) & (F.col("node") != F.col("c.node"))
    stars = large.join(centres, "key").where(fits).select(F.least("c.node", "node").alias("a"), F.greatest("c.node", "node").alias("b")).distinct()
    tiles = open_pairs(members.where(F.col("many") <= SMALL).withColumn("comp", F.col("node")), texts, rule, best=True)
    links = verify(open_by_bitmap(stars, texts, rule).unionAll(tiles).distinct(), texts, rule)
    found = support.cut(components(links))

    # Groups that still span components: first the likeliest pair of each member, which merges most of
    # what can be merged; then all pairs that the bitmaps leave open.
    for best in (True, False):
        now = members.where("many > 2").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        spanning = support.cut(now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key"))
        pairs = open_pairs(now.join(few(spanning), "key"), texts, rule, best)
        if not pairs.limit(1).count():
            break  # no pair is open, so none is for the next round
        more = verify(pairs, texts, rule)
        if more.limit(1).count():
            links = links.unionAll(more)
            found = support.cut(components(links))
    support.remove(written)
    return found


def open_pairs(members: DataFrame, texts: DataFrame, rule: Rule, best: bool) -> DataFrame:
    """Distinct pairs of different components that share a group and that the bitmaps leave open."""
    left = members.select("key", "node", "n", "comp", F.ceil(F.col("many") / TILE).cast("int").alias("tiles"))
    left = left.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # In a tile against itself a row is there once; against another tile it has its side.
    spots = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("low"), F.greatest("tile", t).alias("high"), F.when(F.col("tile") == t, 2).when(F.col("tile") < t, 0).otherwise(1).alias("side")))
    dealt = left.withColumn("spot", F.explode(spots)).select("key", "spot.low", "spot.high", "spot.side", "node", "n", "comp")
    dealt = support.table(support.fewer(dealt), "tiles")
    buckets = max(1, -(-dealt.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("key", "low", "high"), F.lit(buckets)).alias("bucket")
    pairs = support.cut(dealt.join(texts.select("node", "bitmap"), "node").groupBy(bucket).applyInArrow(tiles_compared(rule, best), "a long, b long").distinct())
    support.remove(dealt)
    return pairs


def standardised(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def classes(texts: DataFrame, found: DataFrame) -> DataFrame:
    """digest, n, doc_id and first (doc_id and digest of its component's least document) of each distinct text."""
    known = texts.select("node", "digest", "doc_id", "n")
    of_comp = found.join(known, "node").groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    placed = found.join(support.cut(of_comp), "comp").select("node", "first")
    return known.join(placed, "node", "left").select("digest", "n", "doc_id", F.coalesce("first", F.struct("doc_id", "digest")).alias("first"))


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    support.ready(docs.sparkSession)
    rows = standardised(docs)
    texts = distinct_texts(rows, rule)
    known = classes(texts, linked(texts, rule)).select("digest", F.col("n").cast("long").alias("n_shingles"), F.col("first.doc_id").alias("least"))
    placed = rows.select("doc_id", digest_of("text").alias("digest")).join(known, "digest", "left")
    # Texts without words are equal but link with nothing.
    own = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def later_members(rows: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, digest of the documents that are not the first of their component; rows has doc_id and text as ``standardised``."""
    texts = distinct_texts(rows.where("doc_id is not null"), rule)
    known = classes(texts, linked(texts, rule)).where("n > 0").select("digest", F.col("first.doc_id").alias("least"), F.col("first.digest").alias("least_digest"))
    placed = rows.where("doc_id is not null").select("doc_id", digest_of("text").alias("digest")).join(known, "digest")
    # Not made distinct here: that would keep a digest of very many rows from being split in the join above.
    gone = support.cut(placed.where("doc_id <> least or digest <> least_digest").select("doc_id", "digest"))
    support.remove(texts)
    return gone
