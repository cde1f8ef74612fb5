"""Similarity join of documents on word n-grams: a blocked sparse matrix product.

Rows of the incidence matrix are *classes* (documents with one n-gram set),
columns are 5-word n-grams.  Two classes link when 100 * overlap >= 80 * union.

1. ``signatures``: set size and a 128-bit fingerprint of every document; copies
   collapse into one class before anything is compared.
2. ``shared_grams``: the incidence is dealt out by n-gram in packed blocks; an
   n-gram of one class cannot add to any overlap and is dropped, the others go
   back to their class with their document frequency.  N-grams of a large share
   of all documents (found on a sample; it matters for cost only, never for
   results) stay with their class and are not dealt out at all.
3. Size-derived bounds: a class needs ``ceil(0.8 n)`` shared n-grams to link at
   all; of those that have them, two can only link if they share one of their
   ``shared - ceil(0.8 n) + 1`` rarest.  Classes joined by such n-grams form
   candidate groups (connected components over star edges, never all pairs).
4. ``linked``: each group is one block, or, if large, blocks by size band (a
   factor of 1.25: links stay in one band or neighbouring bands) and hash tile.
   Inside a block overlap counts accumulate over column chunks, and the block
   stops when no pair can reach its bound.  A block gives its classes' link
   counts and a spanning star for each linked set.
5. Components of the stars are components of the documents.

Defined results: null text, empty text and text without words have an empty set,
link with nothing and are components of their own; repeated rows give repeated
rows; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, local_components, materialize, modest_batches, partitions_for, set_fingerprint, shingle_sets, slices, unused

_HOT_DF = np.uint32(0xFFFFFFFF)
#: Ranges of n-grams that a slice of texts is dealt to; more of them are dealt out in a second step.
COARSE = 1024
#: N-grams that the second step deals out together.
DEAL_GRAMS = 2_000_000


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n, f1, f2): n-gram set size and 128-bit set fingerprint of each whole text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, off in slices(batch):
                sets = shingle_sets(data, off, size)
                prints = [set_fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                    ],
                    names=["doc_id", "n", "f1", "f2"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def _class_keys(sets: list[np.ndarray], ambiguous: frozenset[int]) -> list[int]:
    out = []
    for s in sets:
        f1, f2 = set_fingerprint(s)
        out.append(f2 if f1 in ambiguous else f1)
    return out


def hot_grams(docs: DataFrame, n_docs: int, size: int, sample_docs: int = 4000, share: float = 0.01) -> np.ndarray:
    """N-grams in at least ``share`` of a sample of about ``sample_docs`` documents.

    At most (mean n-grams of a document) / ``share`` values, whatever the input."""
    fraction = min(1.0, sample_docs / max(n_docs, 1))

    def run(batches):
        for batch in batches:
            for _, _, data, off in slices(batch):
                sets = shingle_sets(data, off, size)
                g, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], names=["g", "c"])

    least = max(40, int(share * fraction * n_docs))
    counts = docs.select("text").sample(False, fraction, 11).mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    got = counts.filter(F.col("c") >= least).select("g").toPandas()["g"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def _packed(g: np.ndarray, owner: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """A block of sorted n-grams: upper 16 bits, lower 48, owners, and the owners' keys and sizes."""
    used, local = np.unique(owner, return_inverse=True)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    low = np.ascontiguousarray(g.view(np.uint8).reshape(-1, 8)[:, :6])
    return (g >> np.uint64(48)).astype(np.uint16).tobytes(), low.tobytes(), local.astype(kind).tobytes(), keys[used].tobytes(), n[used].tobytes()


_BLOCK = "part int, high binary, low binary, owner binary, keys binary, sizes binary"
_NAMES = ["part", "high", "low", "owner", "keys", "sizes"]


def _deal(parts: int, size: int, hot: np.ndarray, ambiguous: frozenset[int], coarse: int):
    """Blocks of the n-grams of each slice, by which of ``coarse`` ranges their part of ``parts`` is in."""

    def run(batches):
        for batch in batches:
            for _, _, data, off in slices(batch):
                sets = shingle_sets(data, off, size)
                keys = _class_keys(sets, ambiguous)
                first: dict[int, np.ndarray] = {}
                for k, s in zip(keys, sets, strict=True):
                    if len(s):
                        first.setdefault(k, s)
                if not first:
                    continue
                key = np.array(list(first), np.int64)
                n = np.array([len(s) for s in first.values()], np.uint32)
                g = np.concatenate(list(first.values()))
                owner = np.repeat(np.arange(len(n), dtype=np.uint32), n)
                begin = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                rows = []
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
                    is_hot = hot[at] == g
                    if is_hot.any():  # these stay with their class: a block for each, without owners
                        for k in np.unique(owner[is_hot]):
                            mine = g[begin[k] : begin[k + 1]][is_hot[begin[k] : begin[k + 1]]]
                            rows.append((int(key[k].view(np.uint64) % np.uint64(parts)) * coarse // parts, b"", mine.tobytes(), b"", key[k].tobytes(), n[k].tobytes()))
                        g, owner = g[~is_hot], owner[~is_hot]
                order = np.argsort(g, kind="stable")
                g, owner = g[order], owner[order]
                rows += _by_part(_parts_of(g, parts) * np.int64(coarse) // np.int64(parts), g, owner, key, n)
                yield _blocks(rows)

    return run


def _parts_of(g: np.ndarray, parts: int) -> np.ndarray:
    return (((g >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _by_part(part: np.ndarray, g: np.ndarray, owner: np.ndarray, key: np.ndarray, n: np.ndarray) -> list[tuple]:
    """A block for each part that occurs; n-grams and parts are sorted."""
    cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    return [(int(part[a]), *_packed(g[a:b], owner[a:b], key, n)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=_NAMES)


def _merged(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks with owners as one: keys and sizes of the classes, sorted n-grams and the owner of each."""
    gs, ks, keys, sizes, base = [], [], [], [], 0
    for high, low, owner, key, size in blocks:
        h = np.frombuffer(high, np.uint16)
        g = np.zeros((len(h), 8), np.uint8)
        g[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
        gs.append(g.view(np.uint64).ravel() | (h.astype(np.uint64) << np.uint64(48)))
        ks.append(np.frombuffer(owner, np.uint16 if len(owner) == 2 * len(h) else np.uint32).astype(np.int32) + np.int32(base))
        keys.append(np.frombuffer(key, np.int64))
        sizes.append(np.frombuffer(size, np.uint32))
        base += len(keys[-1])
    key, at, same = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    size = np.concatenate(sizes)[at]
    g = np.concatenate(gs)
    owner = same.astype(np.int32)[np.concatenate(ks)]
    del gs, ks, same
    order = np.argsort(g, kind="stable")
    return key, size, g[order], owner[order]


def _deal_again(parts: int, grams: int):
    """Blocks of coarse ranges → blocks of parts, made of about ``grams`` n-grams together."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            hot = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(1, len(_NAMES))], strict=True):
                if not row[2]:  # hot n-grams of one class
                    hot.append((int(np.frombuffer(row[3], np.uint64)[0] % np.uint64(parts)), *row))
                    continue
                held.append(row)
                count += len(row[0]) // 2
                if count >= grams:
                    key, n, g, owner = _merged(held)
                    yield _blocks(_by_part(_parts_of(g, parts), g, owner, key, n))
                    held, count = [], 0
            if hot:
                yield _blocks(hot)
        if held:
            key, n, g, owner = _merged(held)
            yield _blocks(_by_part(_parts_of(g, parts), g, owner, key, n))

    return run


_SHARED = "dest int, keys binary, sizes binary, counts binary, grams binary, dfs binary"


def _gather(dests: int):
    """Blocks of one range of n-grams → the n-grams of more than one class, packed for ``dests`` groups of classes."""

    def run(table: pa.Table) -> pa.Table:
        some: list[tuple] = []
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # (key, n, n-gram, frequency) of each entry
        for block in zip(*[table.column(c).to_pylist() for c in _NAMES[1:]], strict=True):
            if block[2]:
                some.append(block)
                continue
            g, k, n = np.frombuffer(block[1], np.uint64), np.frombuffer(block[3], np.int64), np.frombuffer(block[4], np.uint32)  # hot n-grams of one class
            own.append((np.full(len(g), k[0]), np.full(len(g), n[0]), g, np.full(len(g), _HOT_DF)))
        if some:
            key, size, g, owner = _merged(some)
            del some
            new = np.concatenate([[True], g[1:] != g[:-1]])
            alone = new & np.concatenate([new[1:], [True]])
            g, owner = g[~alone], owner[~alone]
            order = np.lexsort((owner, g))
            g, owner = g[order], owner[order]
            once = np.ones(len(g), bool)
            once[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
            g, owner = g[once], owner[once]  # copies in several slices count once
            if len(g):
                count = np.diff(np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g)))
                df = np.repeat(count, count)
                several = df > 1
                own.append((key[owner[several]], size[owner[several]], g[several], df[several].astype(np.uint32)))
        rows = []
        if own:
            key, n, g, df = (np.concatenate(x) for x in zip(*own, strict=True))
            dest = (key.view(np.uint64) % np.uint64(dests)).astype(np.int64)
            order = np.lexsort((key, dest))
            key, n, g, df, dest = key[order], n[order], g[order], df[order], dest[order]
            cut = np.searchsorted(dest, np.arange(dests + 1))
            for d in np.flatnonzero(np.diff(cut)):
                part = slice(cut[d], cut[d + 1])
                first = np.flatnonzero(np.concatenate([[True], key[part][1:] != key[part][:-1]]))
                counts = np.diff(np.append(first, cut[d + 1] - cut[d])).astype(np.uint32)
                rows.append((int(d), key[part][first].tobytes(), n[part][first].tobytes(), counts.tobytes(), g[part].tobytes(), df[part].tobytes()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        names = ["dest", "keys", "sizes", "counts", "grams", "dfs"]
        return pa.table({c: pa.array(v, pa.int32() if c == "dest" else pa.binary()) for c, v in zip(names, cols, strict=True)})

    return run


def shared_grams(docs: DataFrame, parts: int, size: int, hot: np.ndarray, ambiguous: frozenset[int]) -> DataFrame:
    """N-grams that classes share with others, from each range of n-grams, packed by groups of classes.

    A slice of texts is dealt to at most ``COARSE`` ranges, so that its blocks
    stay long however many parts there are.  With more parts the blocks of one
    range meet in a few tasks, which deal them to the range's parts, many
    slices together."""
    coarse = min(parts, COARSE)
    blocks = docs.select("text").mapInArrow(_deal(parts, size, hot, ambiguous, coarse), _BLOCK)
    if parts > coarse:
        spread = -(-parts // (4 * coarse))  # tasks a range: about four parts' n-grams each
        blocks = blocks.repartition(coarse * spread, "part", F.pmod(F.xxhash64("low"), F.lit(spread))).mapInArrow(_deal_again(parts, DEAL_GRAMS), _BLOCK)
    return blocks.groupBy("part").applyInArrow(_gather(parts), _SHARED)


def _able(table: pa.Table) -> pa.Table:
    """One group of classes: those that share enough n-grams, the rarest first; ``prefix`` of them can make candidates."""
    column = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()])
    counts = column("counts", np.uint32)
    key, n = np.repeat(column("keys", np.int64), counts), np.repeat(column("sizes", np.uint32), counts)
    g, df = column("grams", np.uint64), column("dfs", np.uint32)
    order = np.lexsort((g, df, key))
    key, n, g = key[order], n[order].astype(np.int64), g[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])  # copies in several slices bring hot n-grams again
    key, n, g = key[once], n[once], g[once]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(first[1:], len(key))
    need = (4 * n[first] + 4) // 5
    some = np.flatnonzero(end - first >= need)
    return pa.table({
        "key": pa.array(key[first[some]], pa.int64()), "n": pa.array(n[first[some]], pa.int64()),
        "grams": pa.array([g[first[i] : end[i]].tobytes() for i in some], pa.binary()), "prefix": pa.array((end - first - need + 1)[some], pa.int32()),
    })


def possible(shared: DataFrame) -> DataFrame:
    """(key, n, grams, prefix) of the classes that share enough n-grams to link at all."""
    return shared.groupBy("dest").applyInArrow(_able, "key long, n long, grams binary, prefix int")


def _prefixes(batches):
    for batch in batches:
        key, _, grams, prefix = [c.to_pylist() for c in batch.columns]
        g = [np.frombuffer(x, np.int64)[:p] for x, p in zip(grams, prefix, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)), pa.array(np.repeat(np.array(key, np.int64), [len(x) for x in g]))], names=["g", "key"])


def candidate_groups(able: DataFrame) -> DataFrame:
    """(node, component): classes that may link, directly or over others."""
    entries = able.mapInArrow(_prefixes, "g long, key long")
    star = entries.groupBy("g").agg(F.min("key").alias("m"), F.count("*").alias("c")).filter("c > 1")
    return connected_components(entries.join(star, "g").filter("key <> m").select(F.col("key").alias("a"), F.col("m").alias("b")).distinct())


def tiled(able: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """(unit, side, key, n, grams): every block with its rows.

    A group of up to ``tile`` classes is one block.  Larger ones split into size
    bands and hash tiles; blocks are pairs of tiles of one band or of
    neighbouring bands, so each pair that can link meets in just one block."""
    rows = able.join(groups.withColumnRenamed("node", "key"), "key")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25))).cast("int")
    rows = rows.withColumn("band", band)
    sizes = rows.groupBy("component", "band").agg(F.count("*").alias("c"))
    total = sizes.groupBy("component").agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", "c"))).alias("bands"))
    rows = rows.join(total, "component")
    tiles = lambda b: F.coalesce(F.ceil(F.try_element_at("bands", b) / tile), F.lit(0)).cast("int")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("key"), tiles(F.col("band"))).cast("int"))
    span = lambda b: F.when(tiles(b) > 0, F.sequence(F.lit(0), tiles(b) - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda b, i, c, j, side: F.struct(F.concat_ws("/", b, i, c, j).alias("unit"), side.cast("int").alias("side"))
    b, t = F.col("band"), F.col("t")
    own = F.transform(span(b), lambda j: unit(b, F.least(t, j), b, F.greatest(t, j), (t > j)))
    up = F.transform(span(b + 1), lambda j: unit(b, t, b + 1, j, F.lit(0)))
    down = F.transform(span(b - 1), lambda j: unit(b - 1, j, b, t, F.lit(1)))
    whole = F.array(F.struct(F.lit("all").alias("unit"), F.lit(0).alias("side")))
    rows = rows.withColumn("u", F.explode(F.when(F.col("total") <= tile, whole).otherwise(F.concat(own, up, down))))
    return rows.select(F.concat_ws(":", "component", "u.unit").alias("unit"), F.col("u.side").alias("side"), "key", "n", "copies", "grams")


def block_links(n: np.ndarray, side: np.ndarray, grams: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Which pairs of rows link (upper triangle); overlap counts accumulate over chunks of columns."""
    m = len(n)
    both = len(set(side.tolist())) == 2
    open_ = np.triu(np.ones((m, m), bool), 1)
    if both:
        open_ &= side[:, None] != side[None, :]
    need = 4 * (n[:, None] + n[None, :])
    g = np.concatenate(grams)
    row = np.repeat(np.arange(m), [len(x) for x in grams])
    _, col, count = np.unique(g, return_inverse=True, return_counts=True)
    use = count[col] > 1
    row, col = row[use], col[use]
    if not len(col):
        return np.zeros((m, m), bool)
    col = (np.cumsum(np.bincount(col) > 0) - 1)[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    rest = np.bincount(row, minlength=m)
    over = np.zeros((m, m), np.int64)
    for c in range(0, int(col[-1]) + 1, columns):
        a, b = np.searchsorted(col, (c, c + columns))
        block = np.zeros((m, min(columns, int(col[-1]) + 1 - c)), np.float32)
        block[row[a:b], col[a:b] - c] = 1
        over += (block @ block.T).astype(np.int64)  # at most ``columns``, so exact
        rest = rest - np.bincount(row[a:b], minlength=m)
        open_ &= 9 * (over + np.minimum(rest[:, None], rest[None, :])) >= need
        if not open_.any():
            break
    return open_ & (9 * over >= need)


def _linker(batches):
    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def result(out):
        c = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["key", "root", "links"])

    out: list[tuple] = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        member = list(group)
        key = np.array([r[2] for r in member], np.int64)
        copies = np.array([r[4] for r in member], np.int64)
        link = block_links(np.array([r[3] for r in member], np.int64), np.array([r[1] for r in member]), [np.frombuffer(r[5], np.uint64) for r in member])
        a, b = np.nonzero(link)
        if len(a):
            root = local_components(len(member), a, b)
            links = (link | link.T) @ copies
            out += [(int(key[i]), int(key[root[i]]), int(links[i])) for i in np.flatnonzero(links)]
        if len(out) > 20_000:
            yield result(out)
            out = []
    if out:
        yield result(out)


def linked(units: DataFrame, parts: int) -> DataFrame:
    """(key, root, links): link counts and spanning stars from every block."""
    dealt = units.select("unit", "side", "key", "n", "copies", "grams").repartition(parts, "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(_linker, "key long, root long, links long")


def ngram_components(docs: DataFrame, size: int = 5, tile: int = 256, part_grams: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id reachable by links (null if no row of the
    component has one); n_links counts the other documents (rows) that a document
    links with, its copies and rows without a doc_id included."""
    modest_batches(docs.sparkSession)
    sig = materialize(signatures(docs, size), "signatures")
    classes = sig.filter("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = materialize(classes, "classes")
    total, n_docs = sig.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # 64-bit class keys; where two classes agree in them, they take the other half of their fingerprint
    twice = classes.groupBy("f1").agg(F.count("*").alias("c")).filter("c > 1").select("f1").collect()
    ambiguous = frozenset(r[0] for r in twice)
    key = F.when(F.col("f1").isin(list(ambiguous)), F.col("f2")).otherwise(F.col("f1")) if ambiguous else F.col("f1")
    keyed = classes.select(key.alias("key"), "rep", "copies", "f1", "f2")
    hot = hot_grams(docs, n_docs, size)
    able = materialize(possible(shared_grams(docs, partitions_for(total, part_grams), size, hot, ambiguous)), "able")
    groups = candidate_groups(able)
    units = tiled(able.join(keyed.select("key", "copies"), "key"), groups, tile)
    found = materialize(linked(units, max(8, partitions_for(total, part_grams))), "links")
    rep = keyed.select("key", "rep")
    # classes are the nodes, as a class of rows without a doc_id has no document to stand for it
    comps = materialize(connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key"), "components")
    low = comps.join(rep, "key").groupBy("component").agg(F.min("rep").alias("low"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    info = keyed.join(counts, "key", "left").join(comps.join(low, "component").select("key", "low"), "key", "left")
    info = info.select("f1", "f2", F.coalesce("low", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sig.join(info, ["f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id.

    Where doc_ids are null or repeated, rows are numbered in a stored table and
    known by their number, so that texts of one doc_id are compared as well; of
    a component the smallest doc_id that is not null stays, of several rows one.
    Rows without words link with nothing, so all of them stay."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").isEmpty():
        stay = ngram_components(docs).filter("doc_id = component_id").select("doc_id")
        return docs.join(stay, "doc_id", "left_semi")
    row, group, best = (unused(docs, c) for c in ("row", "in", "best"))
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    comps = ngram_components(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    of = comps.join(rows.select(row, "doc_id"), row).groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias(best))
    return rows.join(of.select(F.col(f"{best}.{row}").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id)) AS component_id,
       coalesce((SELECT count(*) FROM l WHERE l.a = w.doc_id), 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id)
"""
