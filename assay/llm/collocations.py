"""Phrase collocations by dynamic itemset counting over cyclic scans of shards.

Texts are dealt once into a few stored shards.  Round after round one shard is
scanned, in a cycle, and phrases of *all* lengths that are active are counted in
the same scan.  Words are active from the start; a longer phrase becomes active
in the round after both its subphrases (without its last and without its first
word) have been seen often enough, and stays so for one full cycle, so that each
shard counts once.  Nothing enumerates candidates: an occurrence is counted if
its subphrases have reached the threshold, so only phrases that occur are held.

What has reached it stands in two tables of a byte a slot, indexed by different
bits of the hash, with the round of each slot: they go to every task and have
2^``LEAST_BITS`` to 2^``MOST_BITS`` slots, more for more text.  Phrases that share
both slots with frequent ones only start earlier; they are still counted for one
full cycle, so counts are exact whatever the slots.  Beyond some fifty million
frequent phrases the slots fill up and sort out less (more is counted and
shuffled), which costs time, not results.

Phrases are counted by a 64-bit hash.  A task sorts the hashes it finds and hands
them on in blocks, one for a range of hashes, which are merged with the blocks of
the rounds before.  One more scan finds the texts of those that reached the
threshold; a second hash tells apart texts that share the first.  If there are
such texts, these few are counted by text in another scan.  Scores, best cuts, containment and ranks are joins and aggregations over
that table.

Defined results: null and empty texts hold no words; a null language is
``und``; repeated rows all count; very long texts are read whole; ties of score
and count go by the phrase's bytes; further columns may have any names; an
empty table, or one without a phrase that is frequent enough, gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, materialize, mix, modest_batches, partitions_for, shared_dir, slices

LONGEST = 4
LEAST = 30
SHARDS = 3
#: Slots of each table: one for so many bytes of stored texts, between two powers of 2.
SLOT_BYTES = 128
LEAST_BITS, MOST_BITS = 22, 25
#: Slots of the tables of the last scan have a bit and no round: so many for each frequent phrase, up to a power of 2.
WANTED_SLOTS = 16
MOST_WANTED_BITS = 27
NEVER = 255
#: Bytes of stored texts that one task reads: phrases are summed up in a task before they move, the better the more it reads.
TASK_BYTES = 32 << 20
#: The same in the scan that finds texts: each task hands on each frequent phrase that it finds.
TEXT_TASK_BYTES = 128 << 20
#: Bytes of stored texts for each range of hashes that is merged apart.
PART_BYTES = 8 << 20
#: Hashes and phrases that a task holds before it hands them on.
HELD = 2 << 20
HELD_TEXTS = 1 << 17
#: Frequent phrases for each range of hashes whose texts are brought together.
PART_PHRASES = 1 << 15
#: Slots of each of two tables of the phrases that a task of the last scan has handed on: more for more frequent phrases.
LEAST_SEEN_BITS, MOST_SEEN_BITS = 16, 22
#: As many as Spark allows a table.
MOST_BUCKETS = 1 << 16
#: Longer words are hashed one by one.
CHUNKED = 64

_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: 0 for bytes of words, 1 for blanks, 2 for breaks between pieces.
_KIND = bytes(2 if x in b".,;:!?\n\x0b\x0c\r" else x in b"\t " for x in range(256))
#: The first bytes of eight.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_FACTOR = U64(0x9E3779B97F4A7C15)
#: For each of two hashes a seed and odd factors, one for each place of a word in a phrase.
_SEED = (U64(0xD6E8FEB86659FD93), U64(0xA24BAED4963EE407))
_PLACE = mix(np.arange(1, 9, dtype=np.uint64) * _SEED[0]).reshape(2, 4) | U64(1)
_LENGTH = mix(np.arange(1, 6, dtype=np.uint64) * _SEED[1])

_BLOCKS = "part int, k int, start int, h binary, n binary"
_STATE = _BLOCKS + ", fresh array<long>"


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end and text of each word, whether a piece begins with it) of some texts."""
    kind = np.frombuffer(data.tobytes().translate(_KIND), np.uint8)
    solid = np.zeros(len(data) + 2, bool)
    np.equal(kind, 0, out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2].copy(), edges[1::2].copy()
    cuts = np.unique(off[solid[off] & solid[off + 1]])  # texts that end and begin with a word
    if len(cuts):
        starts, ends = (np.insert(x, np.searchsorted(x, cuts), cuts) for x in (starts, ends))
    first = np.searchsorted(starts, off)
    begins = np.zeros(len(starts) + 1, bool)
    begins[first] = True
    begins[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
    return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(first)), begins[:-1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple = _SEED[:1]) -> list[np.ndarray]:
    """A 64-bit hash of each word for each seed, made of eight bytes at a time."""
    size = ends - starts
    eights = sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)
    chunk = eights[starts].view("<u8")[:, 0] & _MASK[np.minimum(size, 8)]
    out = [mix(size.astype(np.uint64) * seed + chunk) for seed in seeds]
    at = np.flatnonzero(size > 8)
    for i in range(8, CHUNKED, 8):
        if not len(at):
            break
        left = size[at] - i
        chunk = eights[starts[at] + i].view("<u8")[:, 0] & _MASK[np.minimum(left, 8)]
        for h in out:
            h[at] = mix(h[at] * _FACTOR + chunk)
        at = at[left > 8]
    for i in at.tolist():
        word = data[starts[i] : ends[i]].tobytes()
        for which, h in enumerate(out):
            h[i] = xxhash.xxh3_64_intdigest(word, which)
    return out


def phrases(w: np.ndarray, lang: np.ndarray, begins: np.ndarray, marks: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """k, first words, hashes, later mark of both subphrases and own mark of the phrases of each length whose subphrases are marked.

    A phrase's own mark is not before its subphrases', so that it is seen from the round after its mark on.  Words have no subphrases and -1 for their mark. ``lang`` is a hash of each
    word's language and part of every phrase's hash."""
    at, total, after = np.arange(len(w)), lang + w * _PLACE[0, 0], np.full(len(w), -1, np.int16)
    for k in range(1, LONGEST + 1):
        h = mix(total + _LENGTH[k])
        own = marks(h)
        if k > 1:  # slots may be marked by others before the subphrases are
            own = np.maximum(own, after)
        yield k, at, h, after, own
        marked = np.full(len(w) + 1, NEVER, np.uint8)
        marked[at] = own
        later = np.maximum(own, marked[at + 1])
        on = np.flatnonzero(later != NEVER)
        on = on[~begins[at[on] + 1]]
        at, after = at[on], later[on]
        if k == LONGEST or not len(at):
            return
        total = total[on] + w[at + k] * _PLACE[0, k]


def _marks(tables: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The later mark of both slots of each hash: the highest bits index one table, the lowest the other."""
    bits = tables.shape[1].bit_length() - 1

    def marks(h: np.ndarray) -> np.ndarray:
        out = tables[0][(h >> U64(64 - bits)).astype(np.int64)]
        on = np.flatnonzero(out != NEVER)
        out[on] = np.maximum(out[on], tables[1][(h[on] & U64((1 << bits) - 1)).astype(np.int64)])
        return out

    return marks


def _wanted(tables: np.ndarray, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """0 or ``NEVER`` for each hash, from tables of a bit a slot."""

    def marks(h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), NEVER, np.uint8)
        on = np.arange(len(h))
        for table, slot in zip(tables, (lambda h: h >> U64(64 - bits), lambda h: h & U64((1 << bits) - 1)), strict=True):
            s = slot(h[on]).astype(np.int64)
            on = on[(table[s >> 3] << (s & 7).astype(np.uint8)) & 128 != 0]
        out[on] = 0
        return out

    return marks


def _texts(batch: pa.RecordBatch):
    """(languages, lower-case bytes, offsets, hash of each text's language) of slices of whole texts."""
    langs = batch.column(0).to_pylist()
    known = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(langs)}
    codes = np.array([known[x] for x in langs], np.uint64)
    for lo, hi, data, off in slices(batch):
        yield langs[lo:hi], np.frombuffer(data.tobytes().translate(_LOWER), np.uint8), off, codes[lo:hi]


def _packed(h: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes, their first bytes together and so on, as these compress; their numbers in as few bytes as the largest takes."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8).T).tobytes(), n.astype(np.min_scalar_type(n.max())).tobytes()


def _unpacked(h: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    out = np.ascontiguousarray(np.frombuffer(h, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return out, np.frombuffer(n, f"u{len(n) // len(out)}").astype(np.int64)


def _blocks(found: dict[tuple[int, int], list[np.ndarray]], parts: int) -> pa.RecordBatch:
    """What a task has found, counted: a row for each length, first round and range of hashes."""
    firsts = np.arange(parts, dtype=np.uint64) * U64((1 << 64) // parts if parts > 1 else 0)
    rows = []
    for (k, start), hashes in found.items():
        u, n = np.unique(np.concatenate(hashes), return_counts=True)
        edges = [*np.searchsorted(u, firsts).tolist(), len(u)]
        rows += [(part, k, start, *_packed(u[lo:hi], n[lo:hi])) for part, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "k", "start", "h", "n"])


def shard_counts(shard: DataFrame, reached: np.ndarray, now: int, cycle: int, parts: int) -> DataFrame:
    """Blocks of how often the active phrases of all lengths stand in one shard, in round ``now``.

    ``start`` is the round in which a phrase became active: words in the first
    one, longer phrases after both their subphrases had reached the threshold."""

    def run(batches):
        found, held = defaultdict(list), 0
        marks = _marks(reached)
        for batch in batches:
            for _, data, off, codes in _texts(batch):
                starts, ends, row, begins = words(data, off)
                for k, _, h, after, _ in phrases(*word_hashes(data, starts, ends), codes[row], begins, marks):
                    for start in range(max(0, now - cycle + 1), now + 1):
                        some = h[after == start - 1]
                        if len(some):
                            found[k, start].append(some)
                            held += len(some)
                if held >= HELD:
                    yield _blocks(found, parts)
                    found.clear()
                    held = 0
        yield _blocks(found, parts)

    return shard.select("lang", "text").mapInArrow(run, _BLOCKS)


def _merged(now: int, cycle: int, least: int):
    """Adds the blocks of a round to the state, range by range.

    ``fresh`` has the hashes that reach the threshold in this round and are not
    of the greatest length; what is through its cycle without that is left out."""

    def run(added: pa.Table, state: pa.Table) -> pa.Table:
        cohorts = defaultdict(list)
        for table in (state.select(added.column_names), added):
            for row in table.to_pylist():
                cohorts[row["k"], row["start"]].append((row["part"], *_unpacked(row["h"], row["n"]), table is not added))
        out = []
        for (k, start), blocks in cohorts.items():
            h = np.concatenate([h for _, h, _, _ in blocks])
            order = np.argsort(h, kind="stable")  # sorted runs
            h = h[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n, before = (np.add.reduceat(np.concatenate(x)[order], first) for x in ([n for _, _, n, _ in blocks], [n * old for _, _, n, old in blocks]))
            h = h[first]
            fresh = h[(n >= least) & (before < least)] if k < LONGEST else h[:0]
            if start + cycle - 1 <= now:
                h, n = h[n >= least], n[n >= least]
            if len(h):
                out.append({"part": blocks[0][0], "k": k, "start": start, "fresh": fresh.view(np.int64)} | dict(zip("hn", _packed(h, n), strict=True)))
        fields = [("part", pa.int32()), ("k", pa.int32()), ("start", pa.int32()), ("h", pa.binary()), ("n", pa.binary()), ("fresh", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(out, pa.schema(fields))

    return run


def _hashes(blocks: DataFrame) -> DataFrame:
    """k, h, n: a row for each phrase of some blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, n = _unpacked(row["h"], row["n"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row["k"], np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["k", "h", "n"])

    return blocks.select("k", "h", "n").mapInArrow(run, "k int, h long, n long")


def _slots(rows: DataFrame, bits: int) -> np.ndarray:
    """The slots of some phrases in both tables, a bit each; they are packed in tasks, so that no more than these bits come to the driver."""
    width = min(bits, 18)
    high, low = F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND((1 << bits) - 1)
    both = rows.select(F.explode(F.array(high, low + (1 << bits))).alias("slot"))

    def pack(table: pa.Table) -> pa.Table:
        slots = table.column("slot").to_numpy()
        marks = np.zeros(1 << width, bool)
        marks[slots & ((1 << width) - 1)] = True
        return pa.table({"region": pa.array([slots[0] >> width], pa.int64()), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    out = np.zeros((2 << bits - width, max(1, (1 << width) // 8)), np.uint8)
    for region, packed in both.groupBy(F.shiftright("slot", width).alias("region")).applyInArrow(pack, "region long, bits binary").collect():
        out[region] = np.frombuffer(packed, np.uint8)
    return out.reshape(2, -1)


def _shard_sizes(stored: DataFrame) -> dict[int, int]:
    """Bytes of the files of each shard."""
    files = stored.select("shard", "_metadata.file_path", "_metadata.file_size").distinct()
    return dict(map(tuple, files.groupBy("shard").agg(F.sum("file_size")).collect()))


def frequent_hashes(docs: DataFrame, least: int = LEAST, cycle: int = SHARDS, bits: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(k, h, n of the phrases that are found ``least`` times, the stored texts, their size).

    The state holds blocks of the phrases that are not through their cycle and of
    those that are and came often enough; it is written anew each round, in turn
    to two tables, so that two of them stand at a time.  They are bucketed by
    ranges of hashes: what a shard holds moves to its bucket once, and the state
    is added to it where it stands."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    numbered = docs.filter(F.length("text") > 0).select(lang.alias("lang"), "text", F.pmod(F.monotonically_increasing_id(), F.lit(cycle)).cast("int").alias("shard"))
    run = uuid.uuid4().hex
    folder = f"{shared_dir(spark)}/tables/collocations-{run}"
    numbered.write.partitionBy("shard").parquet(f"{folder}/texts")
    stored = spark.read.schema(numbered.schema).parquet(f"{folder}/texts")
    sizes = _shard_sizes(stored)
    size = sum(sizes.values())
    if bits is None:
        bits = min(max((size // SLOT_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
    parts = min(1 << (partitions_for(size, PART_BYTES) - 1).bit_length(), MOST_BUCKETS)
    reached = np.full((2, 1 << bits), NEVER, np.uint8)
    state, now, last = spark.createDataFrame([], _STATE), 0, cycle - 1
    try:
        while now <= last:
            shard = now % cycle
            texts = stored.filter(F.col("shard") == shard).coalesce(partitions_for(sizes.get(shard, 0), TASK_BYTES))
            added = shard_counts(texts, reached.copy(), now, cycle, parts).repartition(parts, "part")
            kept = added.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(_merged(now, cycle, least), _STATE)
            table = f"collocations_{run}_{now % 2}"
            kept.write.mode("overwrite").bucketBy(parts, "part").option("path", f"{folder}/state-{now % 2}").saveAsTable(table)
            state = spark.table(table)
            slots = np.unpackbits(_slots(state.select(F.explode("fresh").alias("h")), bits), axis=1, count=1 << bits).view(bool)
            reached[slots & (reached == NEVER)] = now
            last = max(last, now + cycle if slots.any() else 0)  # what starts in the next round needs all shards
            now += 1
        done = spark.read.schema(state.schema).parquet(f"{folder}/state-{(now - 1) % 2}")
    finally:  # the files stay, they are read from their folder
        for turn in (0, 1):
            spark.sql(f"DROP TABLE IF EXISTS collocations_{run}_{turn}")
    return _hashes(done), stored, size


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of distinct pairs of two hashes and how many there are of each."""
    order = np.argsort(h)
    new = np.concatenate((np.ones(min(1, len(h)), bool), h[order[1:]] != h[order[:-1]]))
    other = np.concatenate((np.zeros(min(1, len(h)), bool), g[order[1:]] != g[order[:-1]]))
    if (other & ~new).any():
        order = np.lexsort((g, h))
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(h)))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, k: int) -> pa.Array:
    """The texts of phrases of ``k`` words: words of a phrase are parted by one space."""
    at = first[:, None] + np.arange(k)
    size = ends[at] - starts[at]
    size[:, :-1] += 1
    off = np.concatenate(([0], np.cumsum(size)))
    out = data[np.repeat(starts[at].ravel() - off[:-1], size.ravel()) + np.arange(off[-1])]
    out[off[1:].reshape(-1, k)[:, :-1] - 1] = 32
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(off[::k].copy()), pa.py_buffer(out)).cast(pa.string())


class _Seen:
    """Phrases that a task has handed on: a place by the first hash in one of two tables, or none where both are taken, that has the second hash."""

    def __init__(self, bits: int):
        self.tables = np.zeros((2, 1 << bits), np.uint64)
        self.slots = (lambda h: h >> U64(64 - bits), lambda h: h & U64((1 << bits) - 1))

    def missing(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The places of phrases that are not in the tables."""
        on = np.arange(len(h))
        for table, slot in zip(self.tables, self.slots, strict=True):
            on = on[table[slot(h[on]).astype(np.int64)] != g[on] | U64(1)]
        return on

    def add(self, h: np.ndarray, g: np.ndarray) -> None:
        g = g | U64(1)  # 0 is a free place
        for table, slot in zip(self.tables, self.slots, strict=True):
            s = slot(h).astype(np.int64)
            free = table[s] == 0
            table[s[free]] = g[free]
            rest = table[s] != g
            h, g = h[rest], g[rest]


_FOUND = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("h", pa.int64()), ("phrase", pa.string()), ("f", pa.int64())])


def _summed(rows: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(rows).group_by(["lang", "k", "h", "phrase"], use_threads=False).aggregate([("f", "sum")])
    return out.rename_columns({"f_sum": "f"}).select(_FOUND.names).cast(_FOUND)


def _dealt(rows: pa.Table, bits: int) -> pa.RecordBatch:
    """Rows as Arrow blocks, one for each range of hashes, by their highest bits."""
    part = (rows["h"].to_numpy().view(np.uint64) >> U64(63 - bits) >> U64(1)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rows, part = rows.take(pa.array(order)), part[order]
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    blocks = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _FOUND, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(rows.slice(lo, hi - lo).combine_chunks())
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(blocks, pa.binary())], names=["part", "block"])


def _gathered(blocks: pa.Table) -> pa.Table:
    return _summed([pa.ipc.open_stream(b.as_buffer()).read_all() for b in blocks["block"]])


def phrase_texts(stored: DataFrame, tables: np.ndarray, bits: int, part_bits: int, seen_bits: int, counted: bool = False) -> DataFrame:
    """lang, k, h, phrase, f: the texts of wanted phrases, and the number of all words of a language with 0 for k.

    ``f`` of phrases is 0 unless they are ``counted``; else a task looks at the
    texts of those only that it has not handed on.  They are brought together by
    2^``part_bits`` ranges of hashes."""

    def run(batches):
        totals, held, marks, seen = Counter(), [], _wanted(tables, bits), _Seen(seen_bits)
        for batch in batches:
            for langs, data, off, codes in _texts(batch):
                starts, ends, row, begins = words(data, off)
                for x, n in zip(langs, np.bincount(row, minlength=len(langs)).tolist(), strict=True):
                    totals[x] += n
                w, other = word_hashes(data, starts, ends, _SEED)
                names = pa.array(langs, pa.string())
                for k, at, h, _, own in phrases(w, codes[row], begins, marks):
                    on = np.flatnonzero(own != NEVER)
                    at, h = at[on], h[on]
                    g = sum((other[at + j] * _PLACE[1, j] for j in range(k)), np.zeros(len(at), np.uint64))
                    if not counted:
                        new = seen.missing(h, g)
                        at, h, g = at[new], h[new], g[new]
                    i, n = _distinct(h, g)
                    seen.add(h[i], g[i])
                    columns = (names.take(pa.array(row[at[i]])), np.full(len(i), k, np.int32), h[i].view(np.int64), _joined(data, starts, ends, at[i], k), n * counted)
                    held.append(pa.table([pa.array(c, x.type) for c, x in zip(columns, _FOUND, strict=True)], schema=_FOUND))
                if sum(map(len, held)) >= HELD_TEXTS:
                    yield _dealt(_summed(held), part_bits)
                    held.clear()
        held.append(pa.Table.from_pylist([{"lang": x, "k": 0, "h": 0, "phrase": "", "f": n} for x, n in totals.items()], _FOUND))
        if any(map(len, held)):
            yield _dealt(_summed(held), part_bits)

    blocks = stored.select("lang", "text").mapInArrow(run, "part int, block binary")
    return blocks.groupBy("part").applyInArrow(_gathered, "lang string, k int, h long, phrase string, f long")


def phrase_counts(docs: DataFrame, least: int = LEAST, cycle: int = SHARDS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f of all phrases of one to four words that are found ``least`` times; lang, n of its words)."""
    hashes, stored, size = frequent_hashes(docs, least, cycle, bits)
    frequent = hashes.count()
    part_bits, seen_bits = (frequent // PART_PHRASES).bit_length(), min(max(frequent.bit_length(), LEAST_SEEN_BITS), MOST_SEEN_BITS)
    if bits is None:
        bits = min(max((WANTED_SLOTS * frequent).bit_length(), LEAST_BITS), MOST_WANTED_BITS)
    tables = _slots(hashes, bits)
    for counted in (False, True):  # texts of one hash are told apart by their own counts, which are found only if there are such texts
        seen = materialize(phrase_texts(stored.coalesce(partitions_for(size, TEXT_TASK_BYTES)), tables, bits, part_bits, seen_bits, counted), "collocations-texts")
        named = seen.filter("k > 0").join(hashes.withColumnRenamed("n", "counted"), ["k", "h"])
        alone = F.count("*").over(W.partitionBy("k", "h")) == 1
        f = F.when(F.col("alone"), F.col("counted")).otherwise(F.col("f"))
        table = materialize(named.withColumn("alone", alone).select("lang", "k", "phrase", f.alias("f"), "alone"), "collocations-counts")
        if counted or table.filter(~F.col("alone")).isEmpty():
            break
    return table.filter(F.col("f") >= least).select("lang", "k", "phrase", "f"), seen.filter("k = 0").select("lang", F.col("f").alias("n"))


def _part(words: str, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def best_cuts(table: DataFrame) -> DataFrame:
    """lang, k, phrase, a, l, r, score: of each phrase of several words the cut that scores lowest, of several the first."""
    c = table.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    c = c.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    c = c.select("lang", "k", "phrase", "a", "cut", _part("words", F.lit(1), F.col("cut")).alias("left"), _part("words", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = table.select("lang", "phrase", "f")
    c = c.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    c = c.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast((cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return c.groupBy("lang", "k", "phrase", "a").agg(best).select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def contained(table: DataFrame) -> DataFrame:
    """lang, phrase, most: of phrases of several words that stand in longer ones the largest count of such a longer one."""
    c = table.filter("k > 2").select("lang", "k", F.split("phrase", " ").alias("words"), "f")
    c = c.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    c = c.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)))
    return c.select("lang", _part("words", F.col("i"), F.col("n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, first: int = 2000, covered: int = 80, cycle: int = SHARDS, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases by score.

    Phrases of which a longer one holds ``covered`` percent of the occurrences are left out."""
    modest_batches(docs.sparkSession)
    table, words = phrase_counts(docs, least, cycle, bits)
    c = best_cuts(table).join(contained(table), ["lang", "phrase"], "left")
    wide = lambda x: F.col(x).cast("decimal(22,0)")
    c = c.filter(F.col("most").isNull() | (wide("most") * 100 < wide("a") * covered))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    c = c.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first)
    return c.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), w AS (
  SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM p
), w4 AS MATERIALIZED (
  SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)
), g AS (
  SELECT lang, 1 AS k, w AS t FROM w4 UNION ALL SELECT lang, 2, w || ' ' || w2 FROM w4 WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM w4 WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM w4 WHERE w4 IS NOT NULL
), f AS MATERIALIZED (
  SELECT lang, k, string_split(t, ' ') AS words, n AS f FROM (SELECT lang, k, t, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30)
), n AS (
  SELECT lang, count(*) AS n FROM w4 GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.words, c.f AS a, t.cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
  FROM f c JOIN (VALUES (1), (2), (3)) t(cut) ON t.cut < c.k
  JOIN f l ON l.lang = c.lang AND l.words = c.words[1:t.cut] JOIN f r ON r.lang = c.lang AND r.words = c.words[t.cut + 1:]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, words, max(f) AS most FROM (
    SELECT lang, f, unnest([words[i:i + m - 1] FOR i IN range(1, k - m + 2)]) AS words FROM f JOIN (VALUES (2), (3)) t(m) ON m < k)
  GROUP BY ALL
), kept AS (
  SELECT b.lang, array_to_string(b.words, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN inside USING (lang, words) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
