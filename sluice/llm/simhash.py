"""Operator 1: SimHash near-duplicates by a Gray-order hierarchical index.

1. Fingerprints: 64 bits, bit i set if more than half of the XXH64 values of the
   document's shingles (repeats included) have it set.
2. Distinct fingerprints are cut into radius + k bit blocks. Two that differ in at
   most `radius` bits agree wholly in at least k blocks, so each is entered under every
   choice of k blocks and every link meets in some bucket. k grows with the number of
   fingerprints, so that a bucket of evenly spread ones holds about BUCKET.
3. A bucket is searched by a Gray-order index: members are sorted by the rank of their bits
   in the Gray code order, neighbours of which share most bits. Runs of members become nodes
   of a tree: a node keeps a mask of the bits that all members below it share (without
   those its ancestors keep) and their values. A search walks down with the differences
   added up so far and leaves out a whole group once they exceed `radius`. A bucket's
   links leave it as a spanning forest.
   A bucket of more than CHUNK members is dealt into chunks, and every pair of chunks is a
   group of its own. The members of one of more than MOST_CHUNKS chunks are linked by the words
   within half the radius of them (in the bits that the bucket leaves open): two
   differ in at most `radius` bits just if some word is within half of it (rounded
   down) of one and half of it (rounded up) of the other. So the rows per member stay below a
   constant however large a bucket gets, and no link is lost.
4. Components over all forests by alternating star contraction, each round
   written to the shared folder.

`near_duplicates` links by one fingerprint of shingles. `similar` finds near copies that differ in more of its bits:
each document has TABLES fingerprints of its distinct words, which a changed word moves by a fraction of
what it moves one of shingles, and an index on each; what two texts in a bucket must also have in common is read from a
sketch, a SimHash of 64 * SKETCH bits over the distinct shingles, inside the bucket and before the link counts.
`keep_one` takes either. Its buckets are dealt out as pairs of chunks at every size.

Defined cases: no words (null, empty, blank): fingerprint 0, linked as any other. A
null doc_id keeps its fingerprint, takes no part in linking and has a null
component. Rows of the same doc_id are one node. Ties in the majority clear the bit.
Texts of any length are hashed whole, in steps. An empty table gives an empty result.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, map_columns

SEED = 42
#: Members of a bucket that evenly spread fingerprints give, at most.
BUCKET = 256
#: Members of a bucket that one task takes at most, twice that for a pair of chunks.
CHUNK = 1024
#: Chunks of a bucket at most; the members of larger ones are linked by words near them.
MOST_CHUNKS = 256
#: Children of an index node.
FANOUT = 4
#: Shingles hashed at a time.
STEP = 1 << 15
#: Fingerprints of a document's words, and longs of the sketch of its shingles, for `similar`.
TABLES, SKETCH = 4, 4
CODES = [f"f{i}" for i in range(TABLES)]
SKETCHES = [f"s{i}" for i in range(SKETCH)]
#: Pairs of searcher and node looked at in one step of a search.
FRONT = 1 << 20


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at the six ASCII blanks
    if not words:
        return 0
    if len(words) <= width:
        h = xxhash.xxh64_intdigest(b" ".join(words), seed)
        return h
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = (ends[:-width] + 1).tolist()
    starts.insert(0, 0)
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        hashed = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP])])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    # a digest is big-endian, so the first bit is the highest
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


#: The bits of each byte, the highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n rows of independent 64-bit hashes made of the hashes `h` (the finalizer of SplitMix64)."""
    x = h[None, :] + np.array([i * 0x9E3779B97F4A7C15 % (1 << 64) for i in range(1, n + 1)], np.uint64)[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majorities(h: np.ndarray, n: int) -> list[int]:
    """n fingerprints of a set of hashes, each by hashes of its own; zero for the empty set.

    The values of each byte are counted, and a bit's count is the sum over the values that have it.
    """
    counts = np.zeros(8 * n * 256, np.int64)
    places = (256 * np.arange(8 * n)).reshape(n, 1, 8)
    for at in range(0, len(h), STEP):
        values = _mixed(h[at : at + STEP], n).view(np.uint8).reshape(n, -1, 8)
        counts += np.bincount((values + places).ravel(), minlength=len(counts))
    ones = counts.reshape(8 * n, 256) @ _BITS
    return np.packbits((2 * ones > len(h)).reshape(n, 64), axis=1).view(np.int64).ravel().tolist()


def signature(text: str | None, width: int = 5) -> list[int]:
    """TABLES fingerprints of the distinct words of a whole text and SKETCH longs of the
    sketch of its distinct shingles (fewer words: the whole sequence), as signed longs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        several = np.frombuffer(digest(b" ".join(words)) if words else b"", np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts, stops = np.r_[0, ends[:-width] + 1], ends[width - 1 :]
        parts = []
        for at in range(0, len(starts), STEP):
            ab = zip(starts[at : at + STEP].tolist(), stops[at : at + STEP].tolist())
            parts.append(np.frombuffer(b"".join([digest(joined[a:b]) for a, b in ab]), np.uint64))
        several = np.unique(np.concatenate(parts))
    single = np.frombuffer(b"".join(map(digest, set(words))), np.uint64)
    return _majorities(single, TABLES) + _majorities(several, SKETCH)


def sketch_limit(similarity: float, bits: int = 64 * SKETCH) -> int:
    """The differing bits of two sketches up to which their shingle sets count as similar by
    `similarity` (Jaccard) or more: two standard deviations above what sets of that very similarity give."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _runs(group: np.ndarray) -> np.ndarray:
    """Position of each element inside its run of equal values."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))


class GrayIndex:
    """The hierarchical index over members sorted by (group, Gray rank).

    Levels go from the members upward; level k + 1 joins up to FANOUT consecutive
    nodes of the same group, until a group has one node, or until hardly any node
    shares more than `radius` bits, as such nodes cannot be left out.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray, radius: int = 0):
        #: members below the nodes that a search came to, and of those the ones it left out in a group
        self.met = self.pruned = 0
        self.order = np.lexsort((gray_rank(codes), group))
        codes, group = codes[self.order], group[self.order]
        ones = np.full(len(codes), ~np.uint64(0))
        # per level: shared mask, pattern, first child, one past the last child
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = [(ones, codes, np.arange(len(codes)), np.arange(1, len(codes) + 1))]
        while True:
            mask, pattern, *_ = self.levels[-1]
            place = _runs(group)
            if not place.any():
                break
            first = np.flatnonzero(place % FANOUT == 0)
            last = np.r_[first[1:], len(group)]
            all_and = np.bitwise_and.reduceat(pattern, first)
            all_or = np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(all_and ^ all_or)
            if len(self.levels) > 1 and 8 * (np.bitwise_count(shared) > radius).sum() < len(shared):
                break
            self.levels.append((shared, all_and & shared, first, last))
            group = group[first]
        self.top_group = group
        self.below = [np.ones(len(codes), np.int64)]
        for _, _, first, last in self.levels[1:]:
            total = np.r_[0, np.cumsum(self.below[-1])]
            self.below.append(total[last] - total[first])
        # what a parent already compares is taken out of its children
        for k in range(len(self.levels) - 1, 0, -1):
            shared, _, first, last = self.levels[k]
            mask, pattern, a, b = self.levels[k - 1]
            above = np.repeat(self._whole(k), last - first)
            self.levels[k - 1] = (mask & ~above, pattern, a, b)

    def _whole(self, k: int) -> np.ndarray:
        """The bits that level k's nodes share with all above them."""
        shared = self.levels[k][0]
        for up in range(k + 1, len(self.levels)):
            first, last = self.levels[up][2:]
            owner = np.repeat(np.arange(len(first)), last - first)
            for down in range(up - 1, k, -1):
                f, l = self.levels[down][2:]
                owner = np.repeat(owner, l - f)
            shared = shared | self.levels[up][0][owner]
        return shared

    def links(self, codes: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (searcher, member) positions with at most `radius` differing bits."""
        left, right = (np.searchsorted(self.top_group, group, side) for side in ("left", "right"))
        step = max(1, FRONT // int((right - left).max(initial=1)))
        for at in range(0, len(codes), step):  # a bounded number of starts at a time
            many = right[at : at + step] - left[at : at + step]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who = np.repeat(np.arange(at, at + len(many)), many)
            yield from self._walk(codes, who, left[who] + inside, radius)

    def _walk(self, codes: np.ndarray, who: np.ndarray, top: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        todo = [(len(self.levels) - 1, who, top, np.zeros(len(who), np.uint8))]
        while todo:
            k, who, node, diff = todo.pop()
            if len(who) > FRONT:
                half = len(who) // 2
                todo += [(k, who[:half], node[:half], diff[:half]), (k, who[half:], node[half:], diff[half:])]
                continue
            mask, pattern, first, last = self.levels[k]
            diff = diff + np.bitwise_count((codes[who] ^ pattern[node]) & mask[node])
            stay = diff <= radius
            if k == len(self.levels) - 1:
                self.met += int(self.below[k][node].sum())
            if k:
                self.pruned += int(self.below[k][node[~stay]].sum())
            who, node, diff = who[stay], node[stay], diff[stay]
            if not len(who):
                continue
            if k == 0:
                yield who, self.order[node]
                continue
            many = last[node] - first[node]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            todo.append((k - 1, np.repeat(who, many), np.repeat(first[node], many) + inside, np.repeat(diff, many)))


def join_roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]], also=None) -> np.ndarray:
    """The smallest position of each position's component under the links; under those that
    `also` confirms, where it is given (it is asked only about what is not connected yet)."""
    root = np.arange(n)
    for a, b in links:
        if also is not None:
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            true = also(a, b)
            a, b = a[true], b[true]
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def forest(frame: pd.DataFrame, radius: int, limit: int | None = None) -> pd.DataFrame:
    """A spanning forest of the links inside each group of (group, fp, node); with a `limit`, of
    those whose sketches (columns SKETCHES) differ in at most so many bits."""
    codes = frame["fp"].to_numpy(np.int64).view(np.uint64)
    group = np.unique(frame["group"].to_numpy(), return_inverse=True)[1]
    also = None
    if limit is not None:
        sketch = frame[SKETCHES].to_numpy(np.int64).view(np.uint64)

        def also(a, b):
            true = np.empty(len(a), bool)
            for at in range(0, len(a), STEP):
                part = slice(at, at + STEP)
                true[part] = np.bitwise_count(sketch[a[part]] ^ sketch[b[part]]).sum(axis=1, dtype=np.int64) <= limit
            return true

    root = join_roots(len(codes), GrayIndex(codes, group, radius).links(codes, group, radius), also)
    node = frame["node"].to_numpy(np.int64)
    a, b = node, node[root]
    apart = a != b
    return pd.DataFrame({"a": a[apart], "b": b[apart]}).drop_duplicates()


def _forests(radius: int, limit: int | None = None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; whole groups are searched together."""
        held: list[pd.DataFrame] = []
        rows = 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            rows += len(frame)
            if rows < 8 * CHUNK:
                continue
            both = pd.concat(held, ignore_index=True)
            open_group = both["group"].iloc[-1]
            done = (both["group"] != open_group).to_numpy()
            if done.any():
                yield forest(both[done], radius, limit)
                both = both[~done]
            held, rows = [both], len(both)
        if rows:
            yield forest(pd.concat(held, ignore_index=True), radius, limit)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(parts: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in parts:
            yield [ids, np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return map_columns(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, CODES, SKETCHES) of every row, all longs."""

    def run(parts: Iterator[list[list]]) -> Iterator[list]:
        for ids, texts in parts:
            found = np.array([signature(t, width) for t in texts], np.int64).reshape(-1, TABLES + SKETCH)
            yield [ids, *found.T]

    schema = ", ".join(f"{c} long" for c in ["doc_id", *CODES, *SKETCHES])
    return map_columns(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def choose_blocks(n: int, radius: int) -> int:
    """How many blocks two of n fingerprints must agree in to be compared: the fewest
    that leave at most BUCKET evenly spread ones in a bucket."""
    k = 1
    while n >> (64 * k // (radius + k)) > BUCKET and k < 64 - radius:
        k += 1
    return k


def block_masks(radius: int, k: int) -> list[int]:
    """The bits of each choice of k of radius + k blocks."""
    cuts = [64 * i // (radius + k) for i in range(radius + k + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(masks, k)]


def within(mask: int, radius: int) -> list[int]:
    """All changes of at most `radius` bits outside of `mask`."""
    bits = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(c) for n in range(radius + 1) for c in combinations(bits, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(nodes: DataFrame, radius: int, k: int | None = None, codes: tuple[str, ...] = ("fp",), limit: int | None = None) -> DataFrame:
    """(a, b): forests of the links between the fingerprints of `nodes` (fp, node). With several
    `codes` two are linked by any one of them. A `limit` asks the sketches as well (columns SKETCHES); buckets
    are then dealt out as pairs of chunks however large they are, as the smallest member near a word may fail."""
    masks = block_masks(radius, k or choose_blocks(nodes.count(), radius))
    carried = ["fp", "node", *(SKETCHES if limit is not None else [])]
    entry = [
        F.struct(F.lit(i * len(masks) + t).alias("t"), F.col(c).bitwiseAND(F.lit(_signed(m))).alias("k"), F.col(c).alias("fp"))
        for i, c in enumerate(codes) for t, m in enumerate(masks)
    ]
    entries = nodes.select(*carried[1:], F.explode(F.array(*entry)).alias("e")).select("e.fp", *carried[1:], "e.t", "e.k")
    hot = entries.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    hot = cut(hot, "hot")  # at most a row per CHUNK entries; read anew, so that the joins below may split a hot bucket
    if hot.isEmpty():
        return _searched(entries.select(F.xxhash64("t", "k").alias("group"), *carried), radius, limit)
    huge = F.col("n") > (CHUNK * MOST_CHUNKS if limit is None else F.lit(1 << 62))
    by_chunks, by_words = hot.where(~huge), hot.where(huge)
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("fp", "node"), chunks).cast("int")
    dealt = entries.join(by_words, ["t", "k"], "left_anti").join(by_chunks, ["t", "k"], "left")
    dealt = dealt.select(*carried, "t", "k", chunks.alias("g"), mine.alias("c"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.least(j, F.col("c")) * F.col("g") + F.greatest(j, F.col("c"))))
    dealt = dealt.select(*carried, "t", "k", pair.alias("p")).select(F.xxhash64("t", "k", "p").alias("group"), *carried)
    links = _searched(dealt, radius, limit)
    if by_words.isEmpty():
        return links
    return links.unionAll(word_links(entries.join(by_words, ["t", "k"], "left_semi"), masks, radius))


def _searched(members: DataFrame, radius: int, limit: int | None = None) -> DataFrame:
    # two buckets of one hash would only be searched together; a link is checked on all bits
    return members.repartition("group").sortWithinPartitions("group").mapInPandas(_forests(radius, limit), "a long, b long")


def word_links(entries: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(a, b) that connect the members of each bucket of `entries` (fp, node, t, k) wherever two
    differ in at most `radius` bits: each is tied to the smallest member near a word that it is near to.

    Near is `radius // 2` bits for one side and the rest for the other. Minima are
    combined before the shuffle, and rows per member don't depend on the bucket's size.
    """
    near, far = radius // 2, radius - radius // 2

    def around(table: DataFrame, r: int) -> DataFrame:
        out = None
        for t, m in enumerate(masks):
            changes = F.array(*[F.lit(_signed(c)) for c in within(m, r)])
            part = table.where(F.col("t") == t).select("node", "t", F.explode(F.transform(changes, lambda c: c.bitwiseXOR(F.col("fp")))).alias("w"))
            out = part if out is None else out.unionAll(part)
        return out

    least = around(entries, near).groupBy("t", "w").agg(F.min("node").alias("b"))
    # all that are near one word by half the radius are linked with each other if the radius is even
    tied = around(entries, far).join(cut(least, "words"), ["t", "w"]).where("node <> b").select(F.col("node").alias("a"), "b")
    if near == far:
        return tied.distinct()
    # an odd radius: each of the nearer ones, and not only the smallest, must be tied to the word's others
    most = around(entries, far).groupBy("t", "w").agg(F.min("node").alias("b"))
    return tied.unionAll(around(entries, near).join(cut(most, "words"), ["t", "w"]).where("node <> b").select(F.col("node").alias("a"), "b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest id reachable.

    Large-star, then small-star, each as a minimum per node (summed before the
    shuffle) joined back to the edges; a node with many edges is split by the
    engine's skew join. Ends when a round changes nothing.
    """
    def star(now: DataFrame, large: bool) -> DataFrame:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        least = cut(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")), "least")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            link = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
            out = joined.select(link.alias("e")).select("e.a", "e.b")
        out = cut(out.where("a <> b").distinct(), "star")
        drop_cut(least)
        return out

    def mark(now: DataFrame) -> tuple:
        return tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        middle = star(now, True)
        after_frame = star(middle, False)
        drop_cut(middle)
        drop_cut(now)
        now, after = after_frame, mark(after_frame)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp long, fingerprint hex, component_id) for every row of `docs`."""
    fps = cut(fingerprints(docs, id_col, text_col, width), "fps")
    return _grouped(fps, ["fp"], lambda nodes: bucket_links(nodes, radius)).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, component_id) for every row of `docs`: two texts are linked if one of their TABLES
    fingerprints differs in at most `radius` bits and their sketches say that their sets of shingles of `width` words are
    similar by `similarity` or more (`sketch_limit`). Both are estimates: see the README for what they find."""
    found = cut(signatures(docs, id_col, text_col, width), "fps")
    limit = sketch_limit(similarity)
    return _grouped(found, [*CODES, *SKETCHES], lambda nodes: bucket_links(nodes, radius, codes=tuple(CODES), limit=limit)).select("doc_id", "component_id")


def _grouped(fps: DataFrame, key: list[str], links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`fps` (doc_id, `key`) with the component_id of each row; rows of one key are one node of `links`."""
    known = fps.where("doc_id is not null")
    nodes = cut(known.groupBy(*key).agg(F.min("doc_id").alias("node")), "nodes")
    edges = links(nodes)
    # a doc_id with several texts ties its fingerprints together; so does each link
    several = known.groupBy("doc_id").agg(F.countDistinct(F.struct(*key)).alias("n")).where("n > 1").select("doc_id")
    several = cut(several, "several")
    if not several.isEmpty():
        same = known.join(several, "doc_id", "left_semi").join(nodes, key).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        edges = edges.unionAll(same.distinct())
    found = components(edges)
    named = nodes.join(found, "node", "left").select(*[F.col(c).alias(f"of_{c}") for c in key], F.coalesce("root", "node").alias("component_id"))
    named = cut(named, "named")
    out = fps.join(named, [F.col(c) == F.col(f"of_{c}") for c in key], "left")
    return out.select("doc_id", *key, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, similarity: float | None = None) -> DataFrame:
    """`docs` with one row of each group of near duplicates (with a `similarity`, of `similar` texts): that of the smallest
    id; of rows that share an id and are no others' copies, one stays. Rows without an id
    stay. All columns are kept.

    Only the ids that go are joined to the texts. They are a share of the documents, so their
    size has no bound and they are not broadcast: the texts are shuffled once at every size.
    """
    if similarity is None:
        ids = near_duplicates(docs, id_col, text_col, radius, width)
    else:
        ids = similar(docs, id_col, text_col, similarity, width, radius)
    ids = ids.where("doc_id is not null")
    found = cut(ids.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c")).where("c <> doc_id or n > 1"), "leaving")
    gone, again = found.where("c <> doc_id"), found.where("c = doc_id")
    out = docs.join(gone.select(F.col("doc_id").alias("gone_id")).hint("merge"), docs[id_col] == F.col("gone_id"), "left_anti")
    if again.isEmpty():
        return out
    many = again.select(F.col("doc_id").alias("gone_id"))
    once = out.join(many, out[id_col] == F.col("gone_id"), "left_anti")
    return once.unionAll(out.join(many, out[id_col] == F.col("gone_id"), "left_semi").dropDuplicates([id_col]))
