"""SimHash near-duplicates, found through tables of distances to reference fingerprints (pivots).

A fingerprint has 64 bits a word; bit b is set if it is set in over half of the shingles' hashes.  For a pivot p, two
fingerprints that differ in r bits have distances to p that differ by r at most: a pair whose table rows differ by more
in any coordinate is discarded, and the rest is verified on the fingerprints.

Which pairs meet at all.  Pivots come in families.  A family's pivots are the first pivot with some of the family's
bits flipped, so the family's coordinates less the first coordinate depend on those bits alone.  Two fingerprints that
agree on a family's bits have equal differences there.  With ``spare_families(r)`` (r = 2: five families, any three of
which make a key) two fingerprints within r bits of each other agree on a whole key: no pair is lost.

Plan.  Fingerprints once, over whole texts; rows with equal fingerprints become one numbered node, so exact copies never
meet as pairs.  Nodes are dealt by key, and a bucket's links go into a union-find of the task, which sends on a spanning
forest: a bucket of n nodes makes n - 1 links at most.  Inside a bucket, pairs are discarded and verified by table and
fingerprint; a bucket of over ``BUCKET_PAIRS`` nodes is cut again by tables of finer families (16, then one a bit), which
lose no pair either.  What agrees on all one-bit families but r lies within r bits, and is linked in a chain.

With ``similar``, links are the pairs of texts whose sets of shingles have that Jaccard similarity, all of them.  A node is
then a set of shingles, and its fingerprint is taken from distinct shingles.  Keys are the shingles of a set's prefix: with
n shingles in one order that holds for the whole table, the first n - ceil(similar * n) + 1; two sets that are similar
enough share a shingle of both prefixes, and the places of the first one they share bound how many they may share.  The
order is by counts over all texts, rare ones first; counts are kept in slots that several shingles share, so they only guide:
they decide how long groups are, and not what is found.

Groups (nodes that share a prefix shingle) of up to ``GROUP`` nodes send every pair of fitting sizes, with the number of such
shingles that it shares; summed over all tasks, and with the shingles of larger groups allowed for, this is what two prefixes
have in common, and pairs that have too little of it are dropped.  Larger groups send
each node's pair with the nearest of ``HUBS`` hubs (a hub is the node nearest to the majority fingerprint of those that no
hub before it is near), the hubs' pairs, and, in runs of ``GROUP`` nodes, a spanning forest of the pairs that the pivot table leaves
and the fingerprints verify, closest first; and their entries are kept.  So a group of n nodes sends some n pairs.  Pairs
on a forest are checked on the sets first (those only whose sets can be similar by 1024 bits of parity) and make components; then the others are, where their ends lie in different
components, and so are pairs of kept entries from different components of a group, which a join finds.  Near
copies of one text are one component by then, and cost nothing more.  What isn't alike but shares a rare shingle must be
compared in any exact way.  No pair counts unless its sets were checked, so no unconfirmed pair hides another, and the order
of pairs and the number of tasks don't change the groups.  A shingle whose slot is counted in over ``HOT`` texts is dealt to several tasks.

Cases.  Null or blank text: fingerprint zero, linked like any other.  Fewer words than a shingle: the whole sequence is
one shingle.  Null doc_id or repeated ones: each row goes by its own text; component_id is the smallest doc_id of the
group, null if none has one.  Ties in bit counts: bit not set.  Very long texts: whole.  Extra columns, whatever their names:
``groups`` leaves them out, ``keep_one`` passes them through.  Empty table: empty result.
"""

from __future__ import annotations

import math
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfield.llm import runtime
from gridfield.llm.components import stars
from gridfield.llm.runtime import LAST_ID, Scratch, fresh, partitions_for, release

runtime.ship(sys.modules[__name__])

#: Nodes of a bucket that are compared in pairs; families of the tables that cut larger ones.
BUCKET_PAIRS, FINER = 3000, (16, 64)
#: Shingles whose bits are counted at a time, and rows that are linked at a time.
BITS_AT_ONCE, LINK_ROWS = 100_000, 200_000
#: Pairs that a task holds before it sends them on.
HELD_PAIRS = 250_000
#: Entries that a bucket of prefixes is meant to hold; slots of the counts that order shingles, and blocks of them.
BUCKET_ENTRIES, SLOTS, BLOCKS = 500_000, 1 << 20, 32
#: Nodes of a group that are compared in pairs, and of a shingle that one task gets; hubs of a larger group.
GROUP, HOT, HUBS = 128, 500_000, 8
#: Nodes whose ids are broadcast, to fetch their texts; more are joined by a shuffle.
FETCHED = 500_000
#: Pivots of a family, besides the first pivot.
PATTERNS = 8
#: Rows of a batch that are taken at a time.
ROWS = 1000


def mix(x: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits from 64 (the finalizer of splitmix64, after ``turn`` steps)."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * turn % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(words: list[bytes], shingle: int, width: int) -> np.ndarray:
    from functools import partial

    import xxhash

    if len(words) == 0:
        return np.zeros(width, np.uint64)
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, grams)), np.uint64), width)


def majority(h: np.ndarray, width: int) -> np.ndarray:
    """The bits that over half of these hashes have."""
    out = np.zeros(width, np.uint64)
    for k in range(width):
        own, count = (mix(h, k) if k else h), np.zeros(64, np.int64)
        for at in range(0, len(own), BITS_AT_ONCE):
            part = own[at : at + BITS_AT_ONCE].astype("<u8", copy=False)
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0]
    return out


def _fingerprints(shingle: int, width: int):
    def task(batches):
        release()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            found = [fingerprint(t.lower().split(), shingle, width).astype("<u8").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "told", "fp"])

    return task


class Pivots:
    """The first pivot, the families' bit patterns and which families make each key; from a seed, the same everywhere."""

    def __init__(self, width: int, radius: int, families: list[list[int]], keys: list[tuple[int, ...]], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width, self.radius, self.keys = width, radius, keys
        self.first = rng.integers(0, 1 << 64, width, dtype=np.uint64)
        self.patterns = np.zeros((len(families), min(PATTERNS, max(map(len, families))), width), np.uint64)
        for f, bits in enumerate(families):
            for a in range(self.patterns.shape[1]):
                for b in rng.permutation(bits)[: max(1, len(bits) // 2)]:
                    self.patterns[f, a, b // 64] |= np.uint64(1 << int(b % 64))

    def table(self, fps: np.ndarray, families: range) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the first pivot, and to every pivot of these families."""
        base = np.bitwise_count(fps ^ self.first).sum(axis=1, dtype=np.int16)
        rest = np.stack([np.bitwise_count(fps ^ (self.first ^ p)).sum(axis=1, dtype=np.int16) for f in families for p in self.patterns[f]], axis=1)
        return base, rest

    def near(self, fps: np.ndarray, table: tuple[np.ndarray, np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of these pairs lie within the radius: any coordinate discards, fingerprints verify."""
        base, rest = table
        live = np.flatnonzero(np.abs(base[left] - base[right]) <= self.radius)
        live = live[np.abs(rest[left[live]] - rest[right[live]]).max(axis=1, initial=0) <= self.radius]
        return live[np.bitwise_count(fps[left[live]] ^ fps[right[live]]).sum(axis=1, dtype=np.int64) <= self.radius]

    def of_families(self, fps: np.ndarray) -> np.ndarray:
        """A hash of each family's differences."""
        out = np.zeros((len(fps), len(self.patterns)), np.uint64)
        for f in range(len(self.patterns)):
            base, rest = self.table(fps, range(f, f + 1))
            for told in (rest - base[:, None] + 512).astype(np.uint64).T:
                out[:, f] = mix(out[:, f] ^ told, 1)
        return out

    def key(self, by_family: np.ndarray, k: int) -> np.ndarray:
        at = np.full(len(by_family), k + 1, np.uint64)
        for f in self.keys[k]:
            at = mix(at ^ by_family[:, f], 2)
        return at

    def bucket_keys(self, fps: np.ndarray) -> np.ndarray:
        """One column a key."""
        by_family = self.of_families(fps)
        return np.stack([self.key(by_family, k) for k in range(len(self.keys))], axis=1)


def spare_families(radius: int, width: int = 1, count: int = 5, seed: int = 7) -> Pivots:
    """Keys of ``count - radius`` families each: no pair within the radius is lost."""
    bits = np.random.default_rng(seed).permutation(64 * width).tolist()
    return Pivots(width, radius, [bits[k::count] for k in range(count)], list(combinations(range(count), count - radius)))


def plain_table(radius: int, width: int, seed: int = 7) -> Pivots:
    """A table for pairs that meet in another way."""
    bits = np.random.default_rng(seed).permutation(64 * width).tolist()
    return Pivots(width, radius, [bits[0::2], bits[1::2]], [])


def _keys(pivots: Pivots):
    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                fps = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(part.num_rows, -1)
                keys = pivots.bucket_keys(fps)
                turn = np.repeat(np.arange(part.num_rows), keys.shape[1])
                rest = part.take(pa.array(turn))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), rest.column(0), rest.column(1)], ["key", "id", "fp"])

    return task


def close_pairs(pivots: Pivots, keys: np.ndarray, fps: np.ndarray, finer: tuple[int, ...] = FINER):
    """Index pairs inside runs of equal keys that join just what all pairs within the radius join."""
    table = pivots.table(fps, range(min(5, len(pivots.patterns))))
    size = np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])) if len(keys) else np.zeros(0, int)
    edge, length = np.cumsum(size) - size, np.repeat(size, size)
    live, lag = np.flatnonzero((length > 1) & (length <= BUCKET_PAIRS)), 1
    while len(live := live[live + lag < len(keys)]):
        live = live[keys[live + lag] == keys[live]]
        near = live[pivots.near(fps, table, live, live + lag)]
        if len(near):
            yield near, near + lag
        lag += 1
    for a, n in zip(edge[size > BUCKET_PAIRS], size[size > BUCKET_PAIRS], strict=True):
        own = fps[a : a + n]
        if not finer:  # the keys have all bits but as many as the radius
            near = np.arange(n - 1)[pivots.near(own, pivots.table(own, range(1)), np.arange(n - 1), np.arange(1, n))]
            yield a + near, a + near + 1
            continue
        cut = spare_families(pivots.radius, pivots.width, finer[0])
        by_family = cut.of_families(own)
        for k in range(len(cut.keys)):
            again = cut.key(by_family, k)
            order = np.argsort(again, kind="stable")
            for left, right in close_pairs(cut, again[order], own[order], finer[1:]):
                yield a + order[left], a + order[right]


class Forest:
    """Union-find over numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of these pairs, in turn, joined two trees."""
        out = np.zeros(len(left), bool)
        for k, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out[k] = True
        return out


def _links(pivots: Pivots):
    """Rows come sorted by key.  Pairs within the radius that unite something."""

    def task(batches):
        release()
        forest, pairs = Forest(), []

        def link(rows):
            keys, ids = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
            fps = np.concatenate([r[2] for r in rows])
            for left, right in close_pairs(pivots, keys, fps):
                new = forest.unite(ids[left], ids[right])
                pairs.extend(zip(ids[left[new]].tolist(), ids[right[new]].tolist(), strict=True))

        held, n = [], 0
        for batch in batches:
            rows = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(batch.num_rows, -1))
            if n >= LINK_ROWS:  # link all whole buckets; the last may go on in this batch
                cut = int(np.searchsorted(rows[0], held[-1][0][-1], side="right")) if len(rows[0]) else 0
                held.append(tuple(x[:cut] for x in rows))
                rows = tuple(x[cut:] for x in rows)
                if len(rows[0]):
                    link(held)
                    held, n = [], 0
            if len(rows[0]):
                held.append(rows)
                n += len(rows[0])
        if held:
            link(held)
        for at in range(0, len(pairs), 50_000):
            part = pairs[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], pa.int64()) for k in (0, 1)], ["a", "b"])

    return task


def gram_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    import xxhash

    grams = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def parity(grams: np.ndarray) -> np.ndarray:
    """1024 bits, each flipped by every shingle that has its number: two sets differ in as many shingles at least as their bits do."""
    return np.packbits(np.bincount((grams >> np.uint64(54)).astype(np.int64), minlength=1024) & 1)


def _gram_sets(shingle: int):
    def task(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            sets = [gram_set(t.lower().split(), shingle).astype("<u8") for t in batch.column(1).to_pylist()]
            columns = ([x.tobytes() for x in sets], [parity(x).tobytes() for x in sets], [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, (pa.binary(), pa.binary(), pa.int32()), strict=True))], ["id", "grams", "bits", "n"])

    return task


def _bounded(least: float):
    """Pairs whose bits differ no more than similar sets may."""

    def task(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            size = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(differ * (1 + least) <= (1 - least) * size + 1e-6))

    return task


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def _counts(shingle: int):
    """Rows of a block of slots and in how many texts of the task the slots' shingles stand."""

    def task(batches):
        release()
        import zlib

        total = np.zeros(SLOTS, np.int64)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            total += np.bincount(np.concatenate([_slot(gram_set(t.lower().split(), shingle)) for t in batch.column(0).to_pylist()]), minlength=SLOTS)
        packed = [zlib.compress(x.tobytes(), 1) for x in total.reshape(BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    return task


def _summed(batches):
    """A partition's block: a byte a slot."""
    import zlib

    total, block = np.zeros(SLOTS // BLOCKS, np.int64), None
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.column(0)[k].as_py()
            total += np.frombuffer(zlib.decompress(batch.column(1)[k].as_py()), np.int64)
    if block is not None:
        ranks = np.minimum(5 * np.log2(1 + total), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["block", "ranks"])


def shingle_ranks(texts: DataFrame, shingle: int) -> bytes:
    """A byte a slot, packed: about in how many texts its shingles stand.  A partial sum a task and block; blocks are summed apart."""
    import zlib

    counted = texts.select("text").mapInArrow(_counts(shingle), "block int, counts binary").repartitionById(BLOCKS, "block")
    found = {r["block"]: bytes(r["ranks"]) for r in counted.mapInArrow(_summed, "block int, ranks binary").collect()}  # BLOCKS rows, SLOTS bytes
    return zlib.compress(b"".join(found.get(k, bytes(SLOTS // BLOCKS)) for k in range(BLOCKS)), 1)


def prefix(grams: np.ndarray, ranks: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a sorted set, rare ones first, of which any set that is similar enough has one in its own prefix."""
    order = np.argsort(ranks[_slot(grams)], kind="stable")
    return grams[order[: len(grams) - math.ceil(least * len(grams) - 1e-9) + 1]] if len(grams) else grams


def brief(prefix: np.ndarray) -> bytes:
    """16 bits of each shingle, sorted."""
    return np.sort(prefix >> np.uint64(48)).astype("<u2").tobytes()


def _possible(least: float):
    """Pairs whose prefixes share enough for their sets to be similar: at most that and the longer rest are in common."""

    def task(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                # bits may agree by chance, which only lets more through
                both = min(np.count_nonzero(np.searchsorted(v, u, "right") > np.searchsorted(v, u)) for u, v in ((x, y), (y, x)))
                keep.append((both + max(n - len(x), m - len(y))) * (1 + least) >= least * (n + m) - 1e-6)
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    return task


def _prefixes(shingle: int, width: int, least: float, packed: bytes):
    def task(batches):
        release()
        import zlib

        import xxhash

        ranks = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            out = []
            for t in batch.column(2).to_pylist():
                grams = gram_set(t.lower().split(), shingle).astype("<u8")
                first = prefix(grams, ranks, least)
                out.append((xxhash.xxh3_128_digest(grams.tobytes()), majority(grams, width).astype("<u8").tobytes(), len(grams), first.tobytes(), brief(first)))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "told", "key", "fp", "n", "prefix", "brief"])

    return task


def salts(ranks: np.ndarray, nodes: int) -> np.ndarray:
    """By slot: to how many tasks a shingle's nodes are dealt, from the slot's count."""
    return np.maximum(1, np.ceil(np.minimum(2.0 ** (ranks / 5) - 1, nodes) / HOT)).astype(np.int64)


def _deal(buckets: int, packed: bytes, nodes_in_all: int):
    """Nodes to a row for each batch and bucket: the prefixes' shingles with their places, and the nodes that have them."""
    types = (pa.int64(), *[pa.binary()] * 7)

    def task(batches):
        import zlib

        many = salts(np.frombuffer(zlib.decompress(packed), np.uint8), nodes_in_all)
        for batch in batches:
            nodes, fps, sizes, prefixes = (batch.column(k) for k in range(4))
            tokens = [np.frombuffer(x, "<u8") for x in prefixes.to_pylist()]
            length = np.array([len(x) for x in tokens], np.int64)
            if not length.sum():
                continue
            token, doc = np.concatenate(tokens), np.repeat(np.arange(len(length)), length)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
            nodes, sizes = nodes.to_numpy(), sizes.to_numpy()
            fps = np.frombuffer(b"".join(fps.to_pylist()), "<u8").reshape(len(nodes), -1)
            split = many[_slot(token)]
            salt = ((mix(nodes[doc].astype(np.uint64), 5) >> np.uint64(33)).astype(np.int64) % split).astype(np.uint64)
            bucket = (mix(token + salt, 3) >> np.uint64(33)).astype(np.int64) % buckets
            turn = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(bucket[turn]) != 0, True])
            rows = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                own = turn[a:b]
                docs, who = np.unique(doc[own], return_inverse=True)
                arrays = (token[own], who.astype("<u4"), place[own].astype("<u4"), split[own] > 1, nodes[docs].astype("<i8"), sizes[docs].astype("<u4"), fps[docs])
                rows.append((int(bucket[own[0]]), *(x.tobytes() for x in arrays)))
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + 64]], t) for c, t in enumerate(types)], DEALT.replace(" long", "").replace(" binary", "").split(", "))

    return task


DEALT = "bucket long, tokens binary, who binary, places binary, parts binary, nodes binary, sizes binary, fps binary"


def possible(size, place, other_size, other_place, least: float):
    """Whether sets of these sizes may be similar, if these are the places of the first shingle that they share."""
    rest = np.minimum(size - place, other_size - other_place)
    return (np.minimum(size, other_size) >= least * np.maximum(size, other_size) - 1e-9) & (rest * (1 + least) >= least * (size + other_size) - 1e-6)


def run_pairs(run: np.ndarray, place: np.ndarray, size: np.ndarray, large: np.ndarray, least: float):
    """Index pairs of entries of one run whose sizes fit; of large groups, that may be the first which similar sets share."""
    live, lag = np.arange(len(run)), 1
    while len(live := live[live + lag < len(run)]):
        live = live[run[live + lag] == run[live]]
        live = live[size[live] >= least * size[live + lag] - 1e-9]  # later ones of a run are no smaller
        near = live[~large[live] | possible(size[live], place[live], size[live + lag], place[live + lag], least)]
        if len(near):
            yield near, near + lag
        lag += 1


def hubs(fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Index of each hub, and of the nodes that are near it and near none before."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1 and len(out) < HUBS:
        count = np.zeros(64 * fps.shape[1], np.int64)
        for at in range(0, len(left), BITS_AT_ONCE):
            part = np.ascontiguousarray(fps[left[at : at + BITS_AT_ONCE]])
            count += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * count > len(left), bitorder="little").view("<u8")
        hub = int(left[np.argmin(np.bitwise_count(fps[left] ^ middle).sum(axis=1, dtype=np.int64))])
        near = np.bitwise_count(fps[left] ^ fps[hub]).sum(axis=1, dtype=np.int64) <= radius
        out.append((hub, left[near & (left != hub)]))
        left = left[~near]
    return out


#: Pairs (a, b) with their sizes and how many shingles of small groups they share; told from kept entries (a shingle, a node,
#: and the set's size and place) by a null ``early``.
MET = "a long, b long, early boolean, size int, other int, shared int, place int, hub boolean"
#: Shared shingles of a pair that comes from a large group, where they aren't counted.
UNCOUNTED = 1 << 20


def _meet(least: float, pivots: Pivots):
    """Rows come sorted by bucket.  Pairs that may be similar enough; early: those of a forest from the closest on."""
    types = (pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 4, pa.bool_())
    names = [x.split()[0] for x in MET.split(", ")]

    def task(batches):
        release()
        forest = Forest()

        def rows(*columns):
            n = len(columns[0])
            for at in range(0, n, 50_000):
                cut = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.nulls(min(n - at, 50_000), t) if x is None else pa.array(x[cut], t) for x, t in zip(columns, types, strict=True)], names)

        def sent(found):
            x, y, apart, whole = (np.concatenate([f[k] for f in found]) for k in range(4))
            if not len(x):
                return
            order = np.lexsort((y[:, 0], x[:, 0]))
            x, y, apart, whole = x[order], y[order], apart[order], whole[order]
            edge = np.flatnonzero(np.r_[True, (np.diff(x[:, 0]) != 0) | (np.diff(y[:, 0]) != 0)])
            shared = np.minimum(np.add.reduceat(np.where(whole, 1, UNCOUNTED), edge), UNCOUNTED)
            x, y, apart, whole = x[edge], y[edge], np.minimum.reduceat(apart, edge), np.logical_or.reduceat(whole, edge)
            close = np.flatnonzero(apart <= pivots.radius)
            close = close[np.argsort(apart[close], kind="stable")]
            early = np.zeros(len(x), bool)
            early[close] = forest.unite(x[close, 0], y[close, 0])
            left = early | whole  # pairs of large groups that are no part of the forest are found again if need be
            yield from rows(x[left, 0], y[left, 0], early[left], x[left, 1], y[left, 1], shared[left], None, None)

        def bucket(held):
            token, place, part, node, size, fps = (np.concatenate([r[k] for r in held]) for k in range(6))
            at = np.repeat(np.cumsum([0, *(len(r[3]) for r in held[:-1])]), [len(r[0]) for r in held]) + np.concatenate([r[6] for r in held])
            size, table = size.astype(np.int64), pivots.table(fps, range(len(pivots.patterns)))
            turn = np.lexsort((size[at], token))
            token, place, part, at = token[turn], place[turn].astype(np.int64), part[turn], at[turn]
            fresh_token = np.r_[True, token[1:] != token[:-1]]
            first = np.maximum.accumulate(np.where(fresh_token, np.arange(len(token)), 0))
            length = np.diff(np.r_[np.flatnonzero(fresh_token), len(token)])
            large = np.repeat(length, length) > GROUP
            kept = large | part
            run = np.cumsum(fresh_token | large & ((np.arange(len(token)) - first) % GROUP == 0))
            pairs, is_hub = [], np.zeros(len(token), bool)
            for a, n in zip(np.flatnonzero(fresh_token)[length > 1], length[length > 1], strict=True):
                if n <= GROUP and not part[a]:
                    continue
                found = hubs(fps[at[a : a + n]], pivots.radius)
                is_hub[[a + h for h, _ in found]] = True
                pairs += [(np.full(len(near), a + h), a + near) for h, near in found if len(near)]
            is_hub[fresh_token & part] = True  # a group that other tasks have more of
            yield from rows(token[kept].view(np.int64), node[at[kept]], None, size[at[kept]], None, None, place[kept], is_hub[kept])
            nodes = np.stack([node, size], axis=1)
            found, n = [], 0
            for left, right in (*pairs, *run_pairs(run, place, size[at], kept, least)):
                x, y = at[left], at[right]
                apart = np.full(len(x), 1 << 20)
                close = pivots.near(fps, table, x, y)
                apart[close] = np.bitwise_count(fps[x[close]] ^ fps[y[close]]).sum(axis=1, dtype=np.int64)
                use = (apart < 1 << 20) | ~kept[left]
                x, y, turned = x[use], y[use], (node[x] > node[y])[use, None]
                found.append((np.where(turned, nodes[y], nodes[x]), np.where(turned, nodes[x], nodes[y]), apart[use], ~kept[left][use]))
                n += len(x)
                if n > HELD_PAIRS:
                    yield from sent(found)
                    found, n = [], 0
            if found:
                yield from sent(found)

        now, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                if row[0] != now and held:
                    yield from bucket(held)
                    held = []
                now = row[0]
                token, who, place, part, node, size, fps = (np.frombuffer(x, t) for x, t in zip(row[1:], ("<u8", "<u4", "<u4", "?", "<i8", "<u4", "<u8"), strict=True))
                held.append((token, place, part, node, size, fps.reshape(-1, pivots.width), who.astype(np.int64)))
        if held:
            yield from bucket(held)

    return task


def _alike(least: float):
    def task(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return task


def alike(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have that Jaccard similarity."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    n = pairs.count()
    wanted = scratch.save(nodes.join(wanted, "node").select("node", "id", "told"), "wanted", rows=2 * n)
    fetched = wanted.count()
    if fetched <= FETCHED:
        wanted = F.broadcast(wanted)  # 24 bytes a row
    own = texts.join(wanted, ["id", "told"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = scratch.save(own.select("node", "text").mapInArrow(_gram_sets(shingle), "id long, grams binary, bits binary, n int"), "sets", rows=20 * fetched)
    short = lambda c: sets.select(F.col("id").alias(c), F.col("bits").alias(f"{c}_bits"), F.col("n").alias(f"{c}_n"))
    pairs = pairs.join(short("a"), "a").join(short("b"), "b").select("a", "b", "a_bits", "b_bits", "a_n", "b_n").mapInArrow(_bounded(least), "a long, b long")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("right")), "b")
    return scratch.save(both.select("a", "b", "left", "right").mapInArrow(_alike(least), "a long, b long"), "alike", rows=20 * n)


def _across(entries: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of entries of one large group, from different components, that may be similar enough.

    A group's largest component meets the others, and these each other.  A group that is one component has no row here.
    """
    own = entries.join(roots, entries["node"] == roots["at"], "left").select("token", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    each = own.groupBy("token", "root").agg(F.count("*").alias("n"))
    several = each.groupBy("token").agg(F.max_by("root", "n").alias("top"), F.count("*").alias("roots")).where("roots > 1").select("token", "top")
    own = own.join(several, "token")
    one, other = (own.select("token", "top", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "size", "place", "root"))) for k in (1, 2))
    one = one.where("root_1 <> top").drop("top")
    fits = F.least("size_1", "size_2") >= least * F.greatest("size_1", "size_2") - 1e-9
    rest = F.least(F.col("size_1") - F.col("place_1"), F.col("size_2") - F.col("place_2"))
    fits = fits & (rest * (1 + least) >= least * (F.col("size_1") + F.col("size_2")) - 1e-6)
    order = (F.col("root_1") != F.col("root_2")) & ((F.col("root_2") == F.col("top")) | (F.col("root_1") < F.col("root_2")))
    met = one.join(other, (one["token"] == other["token"]) & order & fits)
    return met.select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()


def _similar_links(texts: DataFrame, nodes: DataFrame, pivots: Pivots, shingle: int, least: float, ranks: bytes, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join just what all pairs of nodes of that similarity join."""
    n, size = nodes.agg(F.count("*"), F.sum(F.octet_length("prefix"))).first()
    buckets = partitions_for(texts.sparkSession, size or 0, 8 * BUCKET_ENTRIES)
    dealt = nodes.select("node", "fp", "n", "prefix").mapInArrow(_deal(buckets, ranks, n), DEALT)
    met = dealt.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(_meet(least, pivots), MET)
    met = scratch.save(met.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, buckets // 8)), "met")  # small: few files
    entries = met.where("early is null").select(F.col("a").alias("token"), F.col("b").alias("node"), "size", "place", "hub")
    one, other = (entries.where("hub").select("token", F.col("node").alias(c)) for c in ("a", "b"))
    between = one.join(other, "token").where("a < b").select("a", "b", F.lit(True).alias("early"))  # a few hubs a group
    between = between.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("size")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("other")), "b").withColumn("shared", F.lit(UNCOUNTED))
    columns = ["a", "b", "early", "size", "other", "shared"]
    pairs = met.where("early is not null").select(*columns).unionByName(between.select(*columns)).groupBy("a", "b").agg(F.max("early").alias("early"), F.max("size").alias("size"), F.max("other").alias("other"), F.sum("shared").alias("shared"))
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("brief").alias(f"{c}_brief"))

    def likely(pairs: DataFrame) -> DataFrame:
        known = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "early", "a_n", "b_n", "a_brief", "b_brief")
        return known.mapInArrow(_possible(least), "a long, b long, early boolean")

    met_rows = met.count()
    uncounted = scratch.save(entries.groupBy("node").agg(F.count("*").alias("uncounted")), "uncounted", rows=met_rows)  # a node's shingles of large groups
    if uncounted.count() <= FETCHED:
        uncounted = F.broadcast(uncounted)  # 16 bytes a row
    more = lambda c: uncounted.select(F.col("node").alias(c), F.col("uncounted").alias(f"{c}_more"))
    pairs = pairs.join(more("a"), "a", "left").join(more("b"), "b", "left")
    after = lambda c: F.ceil(F.col(c) * least - 1e-9) - 1  # noqa: E731  what a set has after its prefix
    both = F.col("shared") + F.least(F.coalesce("a_more", F.lit(0)), F.coalesce("b_more", F.lit(0))) + F.greatest(after("size"), after("other"))
    pairs = pairs.where(both * (1 + least) >= least * (F.col("size") + F.col("other")) - 1e-6).select("a", "b", "early")
    pairs = scratch.save(pairs, "pairs", rows=met_rows)
    first = alike(texts, nodes, pairs.where("early").select("a", "b"), shingle, least, scratch)
    roots = stars(first, scratch, n).withColumnRenamed("node", "at")
    end_root = lambda c: roots.select(F.col("at").alias(c), F.col("root").alias(f"{c}_root"))
    apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
    rest = pairs.where("not early").join(end_root("a"), "a", "left").join(end_root("b"), "b", "left").where(apart).select("a", "b")
    if not entries.isEmpty():
        across = likely(_across(entries, roots, least).withColumn("early", F.lit(False)))
        rest = rest.unionByName(across.select("a", "b")).distinct()
    rest = scratch.save(rest, "rest", rows=met_rows)
    return first if rest.isEmpty() else first.unionByName(alike(texts, nodes, rest, shingle, least, scratch))


def _members(docs: DataFrame, pivots: Pivots, shingle: int, id_column: str, text_column: str, similar: float | None) -> DataFrame:
    """A row a document: id (LAST_ID for null), told (a hash of the text), fp, and of its group the first id and told."""
    spark, scratch, linking = docs.sparkSession, Scratch(docs.sparkSession, "simhash"), Scratch(docs.sparkSession, "simhash-links")
    texts = docs.select(_id(id_column).alias("id"), _told(text_column).alias("told"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    if similar is None:
        found = texts.mapInArrow(_fingerprints(shingle, pivots.width), "id long, told long, fp binary").withColumn("key", F.col("fp"))
    else:
        ranks = shingle_ranks(texts, shingle)
        found = texts.mapInArrow(_prefixes(shingle, pivots.width, similar, ranks), "id long, told long, key binary, fp binary, n int, prefix binary, brief binary")
    prints = linking.save(found, "prints")
    parts = [F.first(c).alias(c) for c in prints.columns[2:] if c != "key"]
    nodes = prints.groupBy("key").agg(F.min(F.struct("id", "told")).alias("least"), *parts)
    nodes = linking.save(nodes.select(F.monotonically_increasing_id().alias("node"), "least.*", *nodes.columns[:1], *nodes.columns[2:]), "nodes")
    if similar is None:
        keyed = nodes.select("node", "fp").mapInArrow(_keys(pivots), "key long, id long, fp binary")
        count = partitions_for(spark, nodes.count() * len(pivots.keys), 500_000)
        links = keyed.repartition(count, "key").sortWithinPartitions("key").mapInArrow(_links(pivots), "a long, b long")
    else:
        links = _similar_links(texts, nodes, pivots, shingle, similar, ranks, linking)
    many = nodes.count()
    roots = stars(links, linking, many)
    rooted = linking.save(nodes.join(roots.withColumnRenamed("node", "at"), nodes["node"] == F.col("at"), "left").select("key", "id", "told", F.coalesce("root", "node").alias("root")), "rooted", rows=many)
    first = rooted.groupBy("root").agg(F.min(F.struct("id", "told")).alias("first"))
    named = rooted.join(first, "root").select("key", F.col("first.id").alias("first_id"), F.col("first.told").alias("first_told"))
    out = scratch.save(prints.join(named, "key").select("id", "told", "fp", "first_id", "first_told"), "members", rows=prints.count())
    linking.close()
    return out


def _id(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def _told(column: str):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def groups(docs: DataFrame, pivots: Pivots, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text", similar: float | None = None) -> DataFrame:
    """A row a document: doc_id, fp (binary, little-endian words) and component_id.

    similar: links are the pairs of that Jaccard similarity of their shingle sets, not those within the radius.
    """
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    found = _members(docs, pivots, shingle, id_column, text_column, similar)
    return found.select(real("id").alias("doc_id"), "fp", real("first_id").alias("component_id"))


def keep_one(docs: DataFrame, pivots: Pivots, shingle: int, id_column: str = "doc_id", text_column: str = "text", similar: float | None = None) -> DataFrame:
    """docs without those whose group has a smaller doc_id; of rows that repeat that doc_id all in the group stay.

    Of a group without doc_ids one row stays.
    """
    found = _members(docs, pivots, shingle, id_column, text_column, similar)
    at, told, gone, gone_told = (fresh(x, docs.columns) for x in ("at", "told", "gone", "gone_told"))
    left = (F.col("first_id") != F.col("id")) | (F.col("id") == LAST_ID) & (F.col("first_told") != F.col("told"))
    drop = found.where(left).select(F.col("id").alias(gone), F.col("told").alias(gone_told)).distinct()
    drop = Scratch(docs.sparkSession, "simhash-gone").save(drop, "gone")
    if drop.count() <= FETCHED:  # 16 bytes a row: broadcast, so that docs stay in place; more are joined by a shuffle
        drop = F.broadcast(drop)
    marked = docs.withColumn(at, _id(id_column)).withColumn(told, _told(text_column))
    kept = marked.join(drop, (F.col(at) == F.col(gone)) & (F.col(told) == F.col(gone_told)), "left_anti")
    unnamed = kept.where(F.col(at) == LAST_ID).dropDuplicates([told])
    return kept.where(F.col(at) != LAST_ID).unionByName(unnamed).select(*docs.columns)
