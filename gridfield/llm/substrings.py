"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted over the corpus.

A window goes if the same words start earlier: in a smaller doc_id, or earlier in the same document.  Overlapping
repeated windows merge into maximal intervals, and the words that they cover are removed.

Plan.  (1) Each task rolls two polynomial hashes over its documents, a block of words at a time.  Inside a block only
the earliest window of each hash is sent on (map-side combine, so a passage that a third of the corpus shares costs one
entry a block); the others are removals already.  Entries go, as packed arrays, to buckets chosen by the second hash.
(2) A bucket orders its entries by the first hash and id, and sends back those that aren't the earliest.
(3) Removals meet the texts in partitions of ids, a row for each bucket and partition at most; a task takes its partition's
removals first, and applies them as the texts stream by.  Both exchanges name the partition outright, so that no two buckets
collide in one; a partition of a large corpus holds several buckets, one after the other.

Two windows count as equal if 64 hash bits and the bucket agree; for n windows about n*n / (2**65 * buckets) pairs of
unequal windows would be taken as equal (5e-6 for 30 GB of documents).

Cases.  Null or blank text: no words, nothing removed, kept text empty.  Fewer words than ``width``: kept whole.
Null doc_id: ordered after all others.  Rows that repeat a doc_id, or have none, are documents of their own, in order of
the first 15 hex digits of their text's MD5 (carried only if the table has such rows).  Of rows that agree in doc_id and text,
one is the earlier and the others lose every window; they meet in one task, which streams them.  Kept words are joined by one
blank; with ``keep_whole``, a text that loses nothing stays as it is, null included.  No repeated window at all: nothing is
removed.  Empty table: empty result.  Extra columns pass through; the two added columns take underscores if the input has
their names.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfield.llm import runtime
from gridfield.llm.runtime import LAST_ID, Scratch, fresh, partitions_for, release

runtime.ship(sys.modules[__name__])

#: Words that a task hashes at a time, windows that a bucket is meant to hold, and partitions that buckets are dealt to at most.
BLOCK_WORDS, BUCKET_WINDOWS, MOST_PARTITIONS = 800_000, 2_000_000, 50_000
#: Rows of a batch that are taken at a time.
ROWS = 1000
#: Odd multipliers of the two rolling polynomials (modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

PACKED = "bucket long, ids binary, tolds binary, counts binary, starts binary, hashes binary"
REMOVALS = "shard long, ids binary, tolds binary, counts binary, starts binary"


def _word_hasher(limit: int = 150_000):
    import xxhash

    known: dict[bytes, int] = {}

    def hashes(words: list[bytes]) -> np.ndarray:
        if len(known) > limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return hashes


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Sum of h[i + j] * base**(width - 1 - j) for each window, by doubling: log2(width) passes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    have, value, out, done = 1, h, None, 0
    left = width
    while left:
        if left & 1:
            part = value[done:]
            out = part if out is None else out[: len(part)] * power(have) + part[: len(out)]
            done += have
        left >>= 1
        if left:
            value = value[:-have] * power(have) + value[have:]
            have *= 2
    return out[:n]


def _rows(names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


PACKED_TYPES = [pa.int64(), *[pa.binary()] * 5]
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


class Places:
    """Arrays of window places: a document's id, what tells it from others of that id (None: nothing does), and the
    window's first word."""

    def __init__(self, ids: np.ndarray, tolds: np.ndarray | None, starts: np.ndarray):
        self.ids, self.tolds, self.starts = ids, tolds, starts.astype(np.uint32, copy=False)

    @staticmethod
    def joined(parts: list[Places]) -> Places:
        ids = np.concatenate([np.zeros(0, np.int64), *(p.ids for p in parts)])
        tolds = np.concatenate([np.zeros(len(p), np.int64) if p.tolds is None else p.tolds for p in parts]) if any(p.tolds is not None for p in parts) else None
        return Places(ids, tolds, np.concatenate([np.zeros(0, np.uint32), *(p.starts for p in parts)]))

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, which) -> Places:
        return Places(self.ids[which], None if self.tolds is None else self.tolds[which], self.starts[which])

    def _documents(self) -> list[np.ndarray]:
        return [self.ids] if self.tolds is None else [self.tolds, self.ids]

    def order(self, *first: np.ndarray) -> np.ndarray:
        return np.lexsort((self.starts, *self._documents(), *first))

    def edges(self) -> np.ndarray:
        """Where runs of one document begin."""
        fresh_run = np.zeros(len(self), bool)
        fresh_run[:1] = True
        for x in self._documents():
            fresh_run[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(fresh_run)

    def shard(self, shards: int) -> np.ndarray:
        """As ``shard_column`` has it."""
        x = (self.ids if self.tolds is None else self.ids ^ self.tolds).astype(np.uint64)
        x = (x ^ (x >> np.uint64(17)) ^ (x >> np.uint64(31))).astype(np.int64)
        return x % shards

    def pack(self, hashes: np.ndarray, squeeze) -> tuple:
        """Runs of documents; starts as differences inside a run; hashes as they are."""
        edge, starts = self.edges(), self.starts.astype(np.int64)
        step = np.diff(starts, prepend=0)
        step[edge] = starts[edge]
        tolds = np.zeros(0, np.int64) if self.tolds is None else self.tolds[edge]
        own = (np.diff(self.ids[edge], prepend=0).astype("<i8"), tolds.astype("<i8"), np.diff(np.r_[edge, len(self)]).astype("<u4"), step.astype("<u4"))
        return (*(squeeze(x.tobytes()) for x in own), hashes.tobytes())

    @staticmethod
    def unpack(ids: bytes, tolds: bytes, counts: bytes, starts: bytes, loose) -> Places:
        ids, tolds = np.cumsum(np.frombuffer(loose(ids), "<i8")), np.frombuffer(loose(tolds), "<i8")
        counts = np.frombuffer(loose(counts), "<u4").astype(np.int64)
        step = np.frombuffer(loose(starts), "<u4").astype(np.int64)
        total, edge = np.cumsum(step), np.cumsum(counts) - counts
        return Places(np.repeat(ids, counts), np.repeat(tolds, counts) if len(tolds) else None, total - np.repeat(total[edge] - step[edge], counts))

    def later(self, group: np.ndarray) -> np.ndarray:
        """In order of (group, place): which come after the first of their group, at another place."""
        head = np.r_[True, group[1:] != group[:-1]]
        first = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
        out = np.zeros(len(group), bool)
        for x in (*self._documents(), self.starts):
            out |= x != x[first]
        return out


def shard_column(key, told, shards: int):
    x = key.bitwiseXOR(told)
    return F.pmod(x.bitwiseXOR(F.shiftrightunsigned(x, 17)).bitwiseXOR(F.shiftrightunsigned(x, 31)), F.lit(shards)).cast("int")


def next_prime(n: int) -> int:
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _send(width: int, buckets: int, unique: bool):
    def task(batches):
        release()
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        hashes = _word_hasher()

        def block(held: dict[tuple[int, int], np.ndarray]):
            docs = sorted(held)
            sizes = np.array([len(held[d]) for d in docs])
            h = np.concatenate([held[d] for d in docs])
            one, two = (rolling(h, width, b) for b in BASES)
            offset = np.cumsum(sizes) - sizes
            doc = np.repeat(np.arange(len(docs)), sizes)[: len(one)]
            start = np.arange(len(one)) - offset[doc]
            whole = start + width <= sizes[doc]
            one, two, doc, start = one[whole], two[whole], doc[whole], start[whole]
            ids, tolds = (np.array([d[k] for d in docs], np.int64) for k in (0, 1))
            order = np.argsort(one, kind="stable")  # places are in order already
            same = np.r_[False, one[order][1:] == one[order][:-1]]
            gone, kept = np.sort(order[same]), np.sort(order[~same])
            at = lambda who: Places(ids[doc[who]], None if unique else tolds[doc[who]], start[who])
            bucket = ((two[kept] ^ (two[kept] >> np.uint64(29))) * np.uint64(BASES[0]) >> np.uint64(33)).astype(np.int64) % buckets
            turn = np.argsort(bucket, kind="stable")
            kept, bucket = kept[turn], bucket[turn]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            rows = [(int(bucket[a]), *at(kept[a:b]).pack(one[kept[a:b]], squeeze)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            for k in range(0, len(rows), 64):
                yield _rows(PACKED_NAMES, rows[k : k + 64], PACKED_TYPES)
            if len(gone):  # known already: they pass any bucket unchanged, told by empty hashes
                yield _rows(PACKED_NAMES, [(int(ids[doc[gone[0]]] % buckets), *at(gone).pack(one[:0], squeeze))], PACKED_TYPES)

        held, n = {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for i, told, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = text.split()
                    if len(words) >= width:
                        held[i, told] = hashes(words)  # rows that agree in id and text have the same windows
                        n += len(words)
                    if n >= BLOCK_WORDS:
                        yield from block(held)
                        held, n = {}, 0
        if held:
            yield from block(held)

    return task


def _judge(shards: int):
    """Rows come sorted by bucket.  Out: removals, a row for each bucket and shard of ids."""

    def task(batches):
        release()
        import zstandard

        loose, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress

        def told(places: Places):
            shard = places.shard(shards)
            turn = places.order(shard)
            places, shard = places.take(turn), shard[turn]
            edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            rows = [(int(shard[a]), *places.take(slice(a, b)).pack(shard[:0], squeeze)[:4]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            for k in range(0, len(rows), 1000):
                yield _rows(["shard", *PACKED_NAMES[1:5]], rows[k : k + 1000], PACKED_TYPES[:5])

        def bucket(rows):
            every, hashes = Places.joined([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            rows.clear()
            part, gone = (hashes >> np.uint64(61)).astype(np.uint8), []
            for k in range(8):  # equal hashes lie in one part; smaller arrays are sorted
                own = np.flatnonzero(part == k)
                places, h = every.take(own), hashes[own]
                order = places.order(h)
                places = places.take(order)
                gone.append(places.take(places.later(h[order])))
            gone = Places.joined(gone)
            if len(gone):
                yield from told(gone)

        at, held, known = None, [], []
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                if row[0] != at and held:
                    yield from bucket(held)
                    held = []
                at = row[0]
                places = Places.unpack(*row[1:5], loose)
                if row[5]:
                    held.append((places, np.frombuffer(row[5], "<u8")))
                else:
                    known.append(places)
                    if sum(map(len, known)) > BLOCK_WORDS:
                        yield from told(Places.joined(known))
                        known = []
        if held:
            yield from bucket(held)
        if known:
            yield from told(Places.joined(known))

    return task


def _cut(width: int, text_at: int, names: list[str], schema: pa.Schema, unique: bool, keep_whole: bool):
    """Rows come removals first: kind, id, told, ids, tolds, counts, starts, then the document's columns."""
    first = 7

    def task(batches):
        release()
        import zstandard

        loose, parts, starts, runs, seen = zstandard.ZstdDecompressor().decompress, [], None, {}, set()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            kinds, ids, tolds = (batch.column(k).to_pylist() for k in range(3))
            packed = [batch.column(k) for k in range(3, first)]
            texts, picked, out, total, removed = batch.column(first + text_at), [], [], [], []
            for k, who in enumerate(zip(ids, tolds, strict=True)):
                if kinds[k] == 0:
                    parts.append(Places.unpack(*(x[k].as_py() for x in packed), loose))
                    continue
                if starts is None:
                    places = Places.joined(parts)
                    places, parts = places.take(places.order()), []
                    edge = places.edges()
                    starts, known = places.starts, places.ids[edge].tolist()
                    known_told = [0] * len(edge) if places.tolds is None else places.tolds[edge].tolist()
                    runs = dict(zip(zip(known, known_told, strict=True), zip(edge.tolist(), [*edge[1:].tolist(), len(places)], strict=True), strict=True)) if len(edge) else {}
                text = texts[k].as_py()
                words = (text or "").encode().split()
                n, kept = len(words), words
                if n >= width:
                    if who in seen:
                        kept = []
                    elif who in runs:
                        s = starts[slice(*runs[who])].astype(np.int64)
                        edges = np.bincount(s, minlength=n + 1)[: n + 1] - np.bincount(s + width, minlength=n + 1)[: n + 1]
                        keep = np.cumsum(edges)[:n] == 0
                        kept = [w for w, y in zip(words, keep.tolist(), strict=True) if y]
                    if not unique:
                        seen.add(who)
                picked.append(k)
                out.append(text if keep_whole and len(kept) == n else b" ".join(kept).decode())
                total.append(n)
                removed.append(n - len(kept))
            if picked:
                rest = batch.take(pa.array(picked))
                columns = [rest.column(first + k) for k in range(len(names) - 2)]
                columns[text_at] = pa.array(out, schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names)

    return task


def added_columns(taken: list[str]) -> list[str]:
    """What the columns of word counts, before and removed, are called."""
    return [fresh(x, taken) for x in ("n_words", "n_removed")]


def remove_repeats(docs: DataFrame, width: int = 20, id_column: str = "doc_id", text_column: str = "text", keep_whole: bool = False) -> DataFrame:
    """docs with the text cut, and n_words (before) and n_removed.  See the module for the rules."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, names = docs.sparkSession, docs.columns
    size = runtime.text_bytes(docs, text_column)
    buckets, parts = partitions_for(spark, size / 6, BUCKET_WINDOWS), partitions_for(spark, size, 32e6)
    shards, dealt = next_prime(parts), min(buckets, MOST_PARTITIONS)
    key, text = F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(LAST_ID)), F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    unique = docs.groupBy(key.alias("id")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    told = F.lit(0).cast("long") if unique else F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    sent = docs.select(key.alias("id"), told.alias("told"), text.cast("binary").alias("text")).mapInArrow(_send(width, buckets, unique), PACKED)
    met = sent.repartitionById(dealt, F.pmod("bucket", F.lit(dealt)).cast("int")).sortWithinPartitions("bucket")
    judged = met.mapInArrow(_judge(shards), REMOVALS).repartition(max(spark.sparkContext.defaultParallelism, dealt // 8))  # small: few files
    removals = Scratch(spark, "repeats").save(judged, "removals")

    kind, at, known, *packed, shard = (fresh(f"own_{x}", names) for x in ("kind", "at", "told", *PACKED_NAMES[1:5], "shard"))
    whole = docs.select(shard_column(key, told, shards).alias(shard), F.lit(1).alias(kind), key.alias(at), told.alias(known), *(F.lit(None).cast("binary").alias(c) for c in packed), *(F.col(f"`{c}`") for c in names))
    gone = removals.select(F.col("shard").cast("int").alias(shard), F.lit(0).alias(kind), *(F.lit(None).cast("long").alias(c) for c in (at, known)), *(F.col(x).alias(c) for x, c in zip(PACKED_NAMES[1:5], packed, strict=True)), *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(x, T.LongType()) for x in added_columns(names)])
    both = whole.unionByName(gone).repartitionById(shards, F.col(shard)).sortWithinPartitions(kind).drop(shard)
    return both.mapInArrow(_cut(width, names.index(text_column), schema.names, to_arrow_schema(schema), unique, keep_whole), schema)
