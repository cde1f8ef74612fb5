"""Removal of repeated 200-byte strings with suffix arrays built by induced sorting.

Equal strings have to meet in one shard before suffixes can be sorted, and no
text may be sorted whole.  So every 200-byte window is dealt out by content:

1. ``segments``: a window's minimizer is the leftmost of its 32-byte strings with
   the smallest hash.  Windows in a row with one minimizer are a segment; equal
   windows have equal minimizers.  Only numbers about segments move: a segment
   whose minimizer occurs nowhere else has no repeated window; identical
   segments are all repeated.
2. ``cut``: of the others, and one of each identical lot, windows are split by
   where the minimizer stands in them (four bins), keyed by the 158 bytes that
   all windows of a bin share, and their bytes go to the shard of the key.
3. ``sort_shard``: each shard is one text with its suffix array (induced sorting)
   and permuted common prefixes: windows whose common prefix with a neighbour is
   200 bytes or more are repeated.
4. Keys with too many pieces for a shard (a passage that very many documents
   share, in contexts of their own) are found by an exact count.  Their windows
   do not go to shards: each is dealt out by a 128-bit digest of its 200 bytes,
   once for each slice of the input that holds it.
5. Runs of repeated windows return to their documents, which drop what they cover.

Minimizers of a large share of all documents (found on a sample; it matters for
cost only) are dealt out by segment instead, and copies inside a slice of the
input are settled there, so that no popular string collects in one task.

Defined results: null text is empty; rows with a null doc_id are rows like others; texts under 200 bytes lose nothing;
repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_VALUE, U64, known_id, materialize, mix, modest_batches, partitions_for, powers, prefix_hash, range_hash, slices
from .suffix_array import permuted_lcp, suffix_array

K, BINS = 32, 4
#: Bytes of text that are cut into segments together.
SLICE = 1 << 20
SEGMENT = np.dtype([("start", "<u4"), ("n", "<u4"), ("o", "<u2"), ("flag", "u1")])
#: Flags of a segment: its windows go to a shard; all are repeated; all are repeated and it stands for its lot in a shard.
OPEN, REPEATED, STANDS = 0, 1, 2
#: The bits of those flags, and a bit for segments whose minimizer is in more segments than a key may have pieces.
STATE, POPULAR = 3, 4


def segments(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, offset of the minimizer in the first window, minimizer hash, content hash) of each segment."""
    size = np.diff(off)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if len(data) < width or not (size >= width).any():
        return none
    c = prefix_hash(BYTE_VALUE[data])
    m = len(data) - K + 1
    _, inv = powers(m)
    h = mix((c[K:] - c[:m]) * inv)
    key = (h & U64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    w = width - K + 1
    blocks = -(-m // w)
    grid = np.full(blocks * w, ~U64(0))
    grid[:m] = key
    grid = grid.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - width + 1
    p = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & U64(0xFFFFFFFF)).astype(np.int64)
    long_ = size >= width
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, off[:-1][long_], 1)
    np.add.at(edge, off[1:][long_] - width + 1, -1)
    valid = np.cumsum(edge[:count]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (p[1:] != p[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (p[1:] != p[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    doc = np.searchsorted(off, a, "right") - 1
    return doc, a - off[doc], b - a + 1, p[a] - a, h[p[a]], range_hash(c, a, b + width)


_FIELDS = [("f", "<u8"), ("h", "<u8"), ("start", "<u4"), ("n", "<u4"), ("o", "<u2"), ("doc", "<u4"), ("weight", "u1")]
_SEG = "part int, kind int, " + ", ".join(f"{k} binary" for k, _ in _FIELDS) + ", ids binary, tids binary"
_SEG_NAMES = ["part", "kind", *[k for k, _ in _FIELDS], "ids", "tids"]
NORMAL, HOT, SETTLED = 0, 1, 2


def _deal(parts: int, width: int, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            ids, tids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for turn, (lo, hi, data, off) in enumerate(slices(batch, limit=SLICE)):
                doc, start, n, o, f, h = segments(data, off, width)
                if not len(doc):
                    continue
                order = np.lexsort((h, f))
                doc, start, n, o, f, h = (x[order] for x in (doc, start, n, o, f, h))
                first = np.concatenate([[True], (f[1:] != f[:-1]) | (h[1:] != h[:-1])])
                lot = np.cumsum(first) - 1
                copies = np.bincount(lot)[lot]
                at = np.minimum(np.searchsorted(hot, f), max(0, len(hot) - 1))
                is_hot = (hot[at] == f) if len(hot) else np.zeros(len(f), bool)
                rows = []

                def pack(pick: np.ndarray, part: int, kind: int) -> None:
                    used, local = np.unique(doc[pick], return_inverse=True)
                    values = {"f": f[pick], "h": h[pick], "start": start[pick], "n": n[pick], "o": o[pick], "doc": local, "weight": np.minimum(copies[pick], 2)}
                    rows.append((part, kind, *[values[k].astype(t).tobytes() for k, t in _FIELDS], ids[lo:hi][used].tobytes(), tids[lo:hi][used].tobytes()))

                spread = mix(np.where(is_hot, f ^ h, f))  # minimizers are small numbers: mixed anew, they fill all parts
                part = (((spread >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
                for kind in (NORMAL, HOT):
                    pick = np.flatnonzero(first & (is_hot == (kind == HOT)))
                    pick = pick[np.argsort(part[pick], kind="stable")]
                    cut = np.searchsorted(part[pick], np.arange(parts + 1))
                    for q in np.flatnonzero(np.diff(cut)):
                        pack(pick[cut[q] : cut[q + 1]], int(q), kind)
                again = np.flatnonzero(~first)
                if len(again):
                    pack(again, (int(ids[lo]) + turn) % parts, SETTLED)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(cols)], names=_SEG_NAMES)

    return run


_PACKED = "dest int, ids binary, tids binary, segs binary"


def _packed(ids: np.ndarray, tids: np.ndarray, segs: np.ndarray, dests: int) -> pa.Table:
    """One row for each group of documents."""
    dest = (mix(ids.view(np.uint64)) % U64(dests)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(dest, kind="stable")
    ids, tids, segs, dest = ids[order], tids[order], segs[order], dest[order]
    cut = np.searchsorted(dest, np.arange(dests + 1))
    got = np.flatnonzero(np.diff(cut))
    each = lambda x: pa.array([x[cut[d] : cut[d + 1]].tobytes() for d in got], pa.binary())
    return pa.table({"dest": pa.array(got, pa.int32()), "ids": each(ids), "tids": each(tids), "segs": each(segs)})


def _judge(dests: int, most: int):
    """Segments of one range of minimizers → those whose minimizer occurs again, with their flags."""

    def run(table: pa.Table) -> pa.Table:
        col = {k: table.column(k).to_pylist() for k in _SEG_NAMES[1:]}
        v = {k: np.concatenate([np.frombuffer(b, t) for b in col[k]]) for k, t in _FIELDS}
        size = np.array([len(b) // 4 for b in col["doc"]])
        kind = np.repeat(np.array(col["kind"], np.int8), size)
        base = np.concatenate([[0], np.cumsum([len(b) // 8 for b in col["ids"]])[:-1]]).astype(np.int32)
        doc = v.pop("doc").astype(np.int32) + np.repeat(base, size)
        ids, tids = (np.concatenate([np.frombuffer(b, np.int64) for b in col[k]]) for k in ("ids", "tids"))
        open_ = np.flatnonzero(kind != SETTLED)
        order = open_[np.lexsort((v["h"][open_], v["f"][open_]))]
        f, h, weight = v["f"][order], v["h"][order], v["weight"][order].astype(np.int64)
        flag = np.full(len(kind), REPEATED, np.uint8)
        keep = np.ones(len(kind), bool)
        if len(order):
            new_f = np.concatenate([[True], f[1:] != f[:-1]])
            new_h = new_f | np.concatenate([[True], h[1:] != h[:-1]])
            of_f, of_h = np.cumsum(new_f) - 1, np.cumsum(new_h) - 1
            again = np.bincount(of_h, weight)[of_h] > 1
            lots = np.bincount(of_f, new_h)[of_f]  # different segments with this minimizer
            several = (lots > 1) | (kind[order] == HOT)
            popular = np.where((lots > most) | (kind[order] == HOT), POPULAR, 0)
            flag[order] = np.where(again, np.where(new_h & several, STANDS | popular, REPEATED), OPEN | popular)
            keep[order] = again | several
        segs = np.zeros(int(keep.sum()), SEGMENT)
        for k in ("start", "n", "o"):
            segs[k] = v[k][keep]
        segs["flag"] = flag[keep]
        return _packed(ids[doc[keep]], tids[doc[keep]], segs, dests)

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """Packed segments of one group of documents → one row a document: (doc_id, tid, segs in order, bytes for shards, popular segments)."""
    ids, tids = (np.concatenate([np.frombuffer(b, np.int64) for b in table.column(k).to_pylist()]) for k in ("ids", "tids"))
    segs = np.concatenate([np.frombuffer(b, SEGMENT) for b in table.column("segs").to_pylist()])
    order = np.lexsort((segs["start"], tids, ids))
    ids, tids, segs = ids[order], tids[order], segs[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tids[1:] != tids[:-1])]))
    end = np.append(first[1:], len(ids))
    cost = np.where(segs["flag"] == REPEATED, 0, segs["n"].astype(np.int64) + 200 * BINS)
    total, popular = (np.concatenate([[0], np.cumsum(x)]) for x in (cost, segs["flag"] & POPULAR > 0))
    return pa.table({
        "doc_id": pa.array(ids[first]), "tid": pa.array(tids[first]), "segs": pa.array([segs[a:b].tobytes() for a, b in zip(first, end, strict=True)], pa.binary()),
        "cost": pa.array(total[end] - total[first]), "popular": pa.array(popular[end] - popular[first]),
    })


_OF_DOCUMENT = "doc_id long, tid long, segs binary, cost long, popular long"


def _pieces(batch: pa.RecordBatch, width: int):
    """Windows of open segments, split by the place of the minimizer: of each slice its first row, bytes and offsets,
    and (key, first window, windows, row, flag) of every piece."""
    step = -(-(width - K + 1) // BINS)
    every = batch.column(3).to_pylist()
    for lo, hi, data, off in slices(batch, limit=SLICE):
        s0, s1, p, owner, flag = [], [], [], [], []
        for i in range(lo, hi):
            g = np.frombuffer(every[i], SEGMENT)
            g = g[g["flag"] != REPEATED]
            a = g["start"].astype(np.int64) + off[i - lo]
            s0.append(a)
            s1.append(a + g["n"] - 1)
            p.append(a + g["o"])
            owner.append(np.full(len(g), i))
            flag.append(g["flag"])
        s0, s1, p, owner, flag = (np.concatenate(x) for x in (s0, s1, p, owner, flag))
        if not len(s0):
            continue
        c = prefix_hash(BYTE_VALUE[data])
        out = []
        for b in range(BINS):
            first, last = np.maximum(s0, p - (step * (b + 1) - 1)), np.minimum(s1, p - step * b)
            ok = np.flatnonzero(first <= last)
            q = p[ok] - step * b  # all windows of the bin hold [q, q + width - step + 1)
            key = range_hash(c, q, q + width - step + 1) + U64(b)
            out.append((key, first[ok], last[ok] - first[ok] + 1, owner[ok], flag[ok]))
        yield lo, data, off, tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _among(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``some``."""
    return some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key if len(some) else np.zeros(len(key), bool)


def _count(width: int):
    """Of each text its keys of popular minimizers, with their pieces and windows."""

    def run(batches):
        for batch in batches:
            for lo, _, off, (key, _, n, owner, flag) in _pieces(batch, width):
                pick = flag & POPULAR > 0
                key, n, owner = key[pick], n[pick], owner[pick]
                order = np.lexsort((key, owner))
                key, n, owner = key[order], n[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])) if len(key) else np.zeros(0, np.int64)
                at = pa.array(owner[first])
                windows = np.add.reduceat(n, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
                pieces = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(key[first].view(np.int64)), pa.array(pieces.astype(np.int64)), pa.array(windows)],
                    names=["doc_id", "tid", "key", "pieces", "windows"],
                )

    return run


def hot_keys(open_: DataFrame, width: int, most: int) -> tuple[DataFrame, int]:
    """(doc_id, tid, hot: the keys of each text that have more than ``most`` pieces, counted exactly), and the number of their windows.

    All pieces of a key have one minimizer, so only popular minimizers are
    looked at.  Hot keys grow with the data, so they stay a table: a text gets
    its own, by a join, and only a number comes to the driver."""
    of_text = materialize(open_.filter("popular > 0").mapInArrow(_count(width), "doc_id long, tid long, key long, pieces long, windows long"), "popular-keys")
    over = of_text.groupBy("key").agg(F.sum("pieces").alias("all_pieces"), F.sum("windows").alias("all_windows")).filter(F.col("all_pieces") > most)
    over = materialize(over, "hot-keys")
    windows = over.agg(F.coalesce(F.sum("all_windows"), F.lit(0))).first()[0]
    return of_text.join(over, "key", "left_semi").groupBy("doc_id", "tid").agg(F.collect_set("key").alias("hot")), int(windows)


def _hot_in(batch: pa.RecordBatch, lo: int, off: np.ndarray) -> np.ndarray:
    """The hot keys of the texts of a slice, sorted: the last column of the batch."""
    some = batch.column(batch.num_columns - 1).slice(lo, len(off) - 1).flatten()
    return np.unique(some.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _cut(shards: int, width: int):
    """(shard, key, bytes) of each piece whose key is not hot."""

    def run(batches):
        for batch in batches:
            ids, tids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, data, off, pieces in _pieces(batch, width):
                cold = ~_among(pieces[0], _hot_in(batch, lo, off))
                key, first, n, owner, flag = (x[cold] for x in pieces)
                if not len(key):
                    continue
                shard = (((key >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                raw = data.tobytes()
                rows = []
                for d in np.flatnonzero(np.diff(cut)):
                    x = order[cut[d] : cut[d + 1]]
                    own = owner[x]
                    rel = first[x] - off[own - lo]
                    text = b"".join([raw[a : a + m] for a, m in zip(first[x].tolist(), (n[x] + width - 1).tolist(), strict=True)])
                    rows.append((
                        int(d), key[x].tobytes(), np.array([ids[i] for i in own], np.int64).tobytes(), np.array([tids[i] for i in own], np.int64).tobytes(),
                        rel.astype("<u4").tobytes(), n[x].astype("<u4").tobytes(), (flag[x] & STATE).tobytes(), text,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if i == 0 else pa.binary()) for i, v in enumerate(zip(*rows, strict=True))], names=_PIECE_NAMES)

    return run


_PIECE = "shard int, key binary, ids binary, tids binary, start binary, n binary, flag binary, text binary"
_PIECE_NAMES = ["shard", "key", "ids", "tids", "start", "n", "flag", "text"]


def repeated_starts(texts: list[bytes], n: np.ndarray, width: int) -> list[np.ndarray]:
    """For each piece, which of its first ``n`` positions start a string of ``width`` bytes that starts elsewhere too."""
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # no UTF-8 text holds this byte
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    sa = suffix_array(data)
    lcp, before = permuted_lcp(data, sa)
    hit = np.zeros(len(data), bool)
    i = np.flatnonzero(lcp >= width)
    hit[i] = True
    hit[before[i]] = True
    return [hit[b : b + m] for b, m in zip(begin, n, strict=True)]


def _sort_shard(dests: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        col = {k: table.column(k).to_pylist() for k in _PIECE_NAMES[1:]}
        v = {k: np.concatenate([np.frombuffer(b, t) for b in col[k]]) for k, t in (("key", "<u8"), ("ids", "<i8"), ("tids", "<i8"), ("start", "<u4"), ("n", "<u4"), ("flag", "u1"))}
        data = b"".join(col["text"])
        at = np.concatenate([[0], np.cumsum(v["n"].astype(np.int64) + width - 1)])
        _, same, count = np.unique(v["key"], return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[same] > 1)
        got = repeated_starts([data[at[i] : at[i + 1]] for i in some], v["n"][some], width) if len(some) else []
        ids, tids, segs = [], [], []
        for i, hit in zip(some, got, strict=True):
            if v["flag"][i] == STANDS or not hit.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            run_ = np.zeros(len(edge) // 2, SEGMENT)
            run_["start"], run_["n"], run_["flag"] = edge[::2] + v["start"][i], edge[1::2] - edge[::2], REPEATED
            segs.append(run_)
            ids.append(np.full(len(run_), v["ids"][i]))
            tids.append(np.full(len(run_), v["tids"][i]))
        empty = np.zeros(0, np.int64)
        return _packed(np.concatenate(ids) if ids else empty, np.concatenate(tids) if tids else empty, np.concatenate(segs) if segs else np.zeros(0, SEGMENT), dests)

    return run


_WINDOW_FIELDS = [("d0", "<u8"), ("d1", "<u8"), ("ids", "<i8"), ("tids", "<i8"), ("start", "<u4"), ("n", "<u4"), ("weight", "u1")]
_WINDOW = "part int, " + ", ".join(f"{k} binary" for k, _ in _WINDOW_FIELDS)
#: Weights of a row of windows: a run that is settled; a window that asks whether it is repeated; one that is known to be.
DONE, ASKS, KNOWN = 0, 1, 2
#: Windows that are dealt out together.
WINDOWS = 1 << 18


def _deal_windows(parts: int, width: int):
    """The windows of hot keys, each dealt out by a digest of all its bytes: one of each kind in a slice, and runs that are settled there."""

    def run(batches):
        for batch in batches:
            ids, tids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for lo, data, off, pieces in _pieces(batch, width):
                pick = _among(pieces[0], _hot_in(batch, lo, off))
                _, first, n, owner, flag = (x[pick] for x in pieces)
                if not len(n):
                    continue
                raw = data.tobytes()
                turns = (np.cumsum(n) - n) // WINDOWS
                for turn in np.unique(turns):
                    t = np.flatnonzero(turns == turn)
                    piece = np.repeat(t, n[t])
                    a = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(n[t]) - n[t], n[t])
                    d = np.frombuffer(b"".join([hashlib.blake2b(raw[i : i + width], digest_size=16).digest() for i in a.tolist()]), "<u8").reshape(-1, 2)
                    order = np.lexsort((d[:, 1], d[:, 0]))
                    new = np.concatenate([[True], (d[order[1:]] != d[order[:-1]]).any(axis=1)])
                    lot = np.empty(len(a), np.int64)
                    lot[order] = np.cumsum(new) - 1
                    stands = flag[piece] & STATE == STANDS
                    known = (np.bincount(lot) > 1) | (np.bincount(lot, stands) > 0)
                    one = order[new]
                    done = known[lot] & ~stands
                    begin = np.flatnonzero(done & np.concatenate([[True], ~done[:-1] | (piece[1:] != piece[:-1])]))
                    end = np.flatnonzero(done & np.concatenate([~done[1:] | (piece[1:] != piece[:-1]), [True]]))
                    at = np.concatenate([one, begin])
                    own = owner[piece[at]]
                    v = {
                        "d0": d[at, 0], "d1": d[at, 1], "ids": ids[own], "tids": tids[own], "start": a[at] - off[own - lo],
                        "n": np.concatenate([np.ones(len(one), np.int64), end - begin + 1]), "weight": np.concatenate([np.where(known, KNOWN, ASKS), np.full(len(begin), DONE)]),
                    }
                    spread = np.where(v["weight"] == DONE, mix(v["ids"].view(np.uint64)), v["d0"])
                    part = (((spread >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    cut = np.searchsorted(part[by], np.arange(parts + 1))
                    rows = [(int(q), *[v[k][by[cut[q] : cut[q + 1]]].astype(w).tobytes() for k, w in _WINDOW_FIELDS]) for q in np.flatnonzero(np.diff(cut))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=["part", *[k for k, _ in _WINDOW_FIELDS]])

    return run


def _judge_windows(dests: int):
    """Windows of one range of digests → those that are repeated."""

    def run(table: pa.Table) -> pa.Table:
        v = {k: np.concatenate([np.frombuffer(b, w) for b in table.column(k).to_pylist()]) for k, w in _WINDOW_FIELDS}
        live = np.flatnonzero(v["weight"] != DONE)
        order = live[np.lexsort((v["d1"][live], v["d0"][live]))]
        hit = v["weight"] == DONE
        if len(order):
            d0, d1, weight = v["d0"][order], v["d1"][order], v["weight"][order]
            lot = np.cumsum(np.concatenate([[True], (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1])])) - 1
            hit[order] = (np.bincount(lot, weight)[lot] > 1) & (weight == ASKS)
        segs = np.zeros(int(hit.sum()), SEGMENT)
        segs["start"], segs["n"], segs["flag"] = v["start"][hit], v["n"][hit], REPEATED
        return _packed(v["ids"][hit], v["tids"][hit], segs, dests)

    return run


def _strip(width: int, keep: bool):
    """Drops what runs of repeated windows cover; digests of what is left, and with ``keep`` the bytes themselves."""

    def run(batches):
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, data, off in slices(batch):
                raw = data.tobytes()
                out = []
                for i in range(lo, hi):
                    text = raw[off[i - lo] : off[i - lo + 1]]
                    runs = [np.frombuffer(x, SEGMENT) for x in (one[i], two[i]) if x]
                    runs = np.concatenate(runs) if runs else np.zeros(0, SEGMENT)
                    runs = runs[runs["flag"] & STATE != OPEN]
                    if not len(runs):
                        out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                        continue
                    a = np.sort(runs["start"].astype(np.int64))
                    b = runs["start"].astype(np.int64) + runs["n"] - 1 + width
                    b = np.maximum.accumulate(b[np.argsort(runs["start"], kind="stable")])
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    spans = list(zip(a[new].tolist(), b[np.append(new[1:] - 1, len(b) - 1)].tolist(), strict=True))
                    kept, last = [], 0
                    for x, y in spans:
                        kept.append(text[last:x])
                        last = y
                    rest = b"".join([*kept, text[last:]])
                    out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest))
                cols, kinds = list(zip(*out, strict=True)), [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 4 + keep]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep],
                )

    return run


def hot_minimizers(docs: DataFrame, width: int, n_docs: int, sample_docs: int = 4000, share: float = 0.01) -> np.ndarray:
    """Minimizers of at least ``share`` of a sample of about ``sample_docs`` documents: a list bounded by the sample."""
    fraction = min(1.0, sample_docs / max(n_docs, 1))

    def run(batches):
        for batch in batches:
            for _, _, data, off in slices(batch, limit=SLICE):
                f, c = np.unique(segments(data, off, width)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(c.astype(np.int64))], names=["f", "c"])

    counts = docs.select("text").sample(False, fraction, 11).mapInArrow(run, "f long, c long").groupBy("f").agg(F.sum("c").alias("c"))
    got = counts.filter(F.col("c") >= max(40, int(share * fraction * n_docs))).select("f").toPandas()["f"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def strip_repeats(docs: DataFrame, width: int = 200, part_bytes: int = 40 << 20, shard_bytes: int = 2 << 20, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep``, kept (the remaining bytes) of every row of ``docs``."""
    modest_batches(docs.sparkSession)
    t = docs.select(known_id().alias("doc_id"), F.xxhash64("text").alias("tid"), "text", F.col("doc_id").alias("given"))
    n_docs, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = partitions_for(total, part_bytes)
    most = shard_bytes // (4 * width)  # pieces of a key: a quarter of a shard
    popular_ones = hot_minimizers(docs, width, n_docs)
    dealt = t.select("doc_id", "tid", "text").mapInArrow(_deal(parts, width, popular_ones), _SEG)
    judged = dealt.groupBy("part").applyInArrow(_judge(parts, most), _PACKED)
    marks = materialize(judged.groupBy("dest").applyInArrow(_by_document, _OF_DOCUMENT), "marks")
    cost, popular = marks.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.coalesce(F.sum("popular"), F.lit(0))).first()
    shards = partitions_for(cost, shard_bytes)
    key = ["doc_id", "tid"]
    segs = marks.filter("cost > 0").select(*key, "segs", "popular")
    hot, windows = hot_keys(t.join(segs, key).select("doc_id", "tid", "text", "segs", "popular"), width, most) if popular else (None, 0)
    segs = segs.join(hot, key, "left") if windows else segs.withColumn("hot", F.lit(None).cast("array<long>"))
    open_ = t.join(segs, key).select("doc_id", "tid", "text", "segs", "popular", "hot")
    sorted_ = open_.mapInArrow(_cut(shards, width), _PIECE).groupBy("shard").applyInArrow(_sort_shard(parts, width), _PACKED)
    if windows:
        dealt = open_.filter("hot is not null").mapInArrow(_deal_windows(partitions_for(windows, 200_000), width), _WINDOW)
        sorted_ = sorted_.union(dealt.groupBy("part").applyInArrow(_judge_windows(parts), _PACKED))
    found = materialize(sorted_.groupBy("dest").applyInArrow(_by_document, _OF_DOCUMENT), "runs")
    whole = t.join(marks.select(*key, F.col("segs").alias("marks")), key, "left").join(found.select(*key, F.col("segs").alias("runs")), key, "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    return whole.select(F.col("given").alias("doc_id"), "text", "marks", "runs").mapInArrow(_strip(width, keep), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), p AS MATERIALIZED (
  SELECT doc_id, n, 400 * j AS b, substr(h, 800 * j + 1, 1198) AS part FROM (SELECT doc_id, h, n, unnest(range((n + 200) // 400)) AS j FROM t WHERE n >= 200)
), w AS (
  SELECT doc_id, b + x AS i, md5(substr(part, 2 * x + 1, 400)) AS k FROM (SELECT doc_id, n, b, part, unnest(range(least(400, n - 199 - b))) AS x FROM p)
), s AS (
  SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)
), g AS (
  SELECT doc_id, i, coalesce((i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200)::INT, 1) AS new FROM s
), r AS (
  SELECT doc_id, no, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM g) GROUP BY ALL
), d AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list([a, b] ORDER BY a) AS runs FROM r GROUP BY doc_id
), k AS (
  SELECT t.doc_id, t.n, coalesce(d.n_removed, 0) AS n_removed, coalesce(d.n_spans, 0) AS n_spans,
         array_to_string([substr(h, 2 * CASE WHEN j = 1 THEN 0 ELSE runs[j - 1][2] END + 1,
           2 * (CASE WHEN j > len(runs) THEN t.n ELSE runs[j][1] END - CASE WHEN j = 1 THEN 0 ELSE runs[j - 1][2] END)) FOR j IN range(1, len(runs) + 2)], '') AS rest, h
  FROM t LEFT JOIN d USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(CASE WHEN n_spans = 0 THEN h ELSE rest END)) AS kept_sha256 FROM k
"""
