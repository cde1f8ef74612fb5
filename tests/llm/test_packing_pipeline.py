import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assay.llm import packing
from assay.llm.packing import best_fit_plan

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def check_packed(rows, docs, tokenizer):
    """Pieces rebuild every document's ids, and sequences are gapless and not too long."""
    ids = {}
    for d, t in docs:
        ids.setdefault(d, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(ids)
    want = sorted((d, k, a, b - a, zlib.crc32(t[a:b].tobytes())) for d, ts in ids.items() for t in ts for k, (a, b) in enumerate(cuts(len(t))))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for v in seqs.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    return len(seqs), -(-total // 1024)


def cuts(n):
    first = n % 1024 or 1024
    edge = [0, *range(first, n + 1, 1024)]
    return list(zip(edge[:-1], edge[1:], strict=True))


def test_packing(spark, edges, no_rows, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, edges):
        rows = packing.packed(df, VOCABULARY).collect()
        n, least = check_packed(rows, [(r["doc_id"], r["text"]) for r in df.collect()], tokenizer)
        assert n <= least * 1.05 + 1
    assert packing.packed(no_rows, VOCABULARY).count() == 0


def plain_best_fit(lengths, room):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, left in enumerate(bins) if left >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(room - n)
    return len(bins)


def test_plan_is_best_fit():
    rng = np.random.default_rng(4)
    for room in (10, 37, 128):
        for _ in range(60):
            lengths = rng.integers(1, room, rng.integers(1, 300)).tolist()
            counts = {n: lengths.count(n) for n in set(lengths)}
            runs = best_fit_plan(counts, room)
            used, ranks = {}, {}
            for n, a, b, first, off in runs:
                for k in range(b - a):
                    used.setdefault(first + k, []).append((off, n))
                ranks.setdefault(n, []).append((a, b))
            for n, c in counts.items():
                edge = sorted(ranks[n])
                assert edge[0][0] == 0 and edge[-1][1] == c and all(x[1] == y[0] for x, y in zip(edge, edge[1:], strict=False))
            for v in used.values():
                at = 0
                for off, n in sorted(v):
                    assert off == at
                    at += n
                assert at <= room
            assert len(used) <= plain_best_fit(lengths, room) + 1


def test_both_tokenizers_agree(tokenizer):
    _, fast, _ = packing.encoders(VOCABULARY)
    plain = [chr(c) for c in range(0x2100) if not packing._PLAIN.search(chr(c))]
    assert len(plain) > 500
    for c in plain:
        for t in (f"a{c}b", f" {c} ", f"{c}{c}x", f"1{c}'s {c}1", f"{c}\n {c}"):
            assert fast.encode_ordinary(t) == tokenizer.encode(t, add_special_tokens=False).ids, (c, t)
    assert packing.token_ids("<|endoftext|>", VOCABULARY).tolist() == [50256]
    for t in ("<|endoftext|>", "a plain text <|endoftext|> goes on<|endoftext|>", "<|endoftext|", "漢字 🙂", "a   b\n\n\n c", "　x", "\x85y\xa0z"):
        assert packing.token_ids(t, VOCABULARY).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_pipeline_stages(spark, sf, edges, no_rows, tokenizer):
    import corpus_pipeline as C
    from assay.llm.common import materialize
    from test_pairs import brute_components, texts

    from assay.llm import language_id
    from assay.llm.exact_dedup import normalise
    from assay.llm.language_id import predict as op7_rows
    from assay.llm.mixing import taken_words

    stages = dict(C.STAGES)
    assert list(stages) == ["language", "exact", "near", "mix", "pack"]
    for source in (spark.read.parquet(f"{sf}/documents.parquet"), edges):
        docs = materialize(source, "docs")
        kept = {n: None for n in stages}
        for name, f in C.STAGES[:-1]:
            before = docs
            docs = materialize(f(spark, before, sf), name)
            kept[name] = before, docs
            assert docs.columns == source.columns
        before, after = kept["language"]
        rejected = {r["doc_id"] for r in op7_rows(before, language_id.fit(before)).collect() if r["rejected"]}
        assert {d for d, t in texts(before) if not any(c.isalpha() for c in t.decode())} <= rejected
        assert sorted(texts(after)) == sorted((d, t) for d, t in texts(before) if d not in rejected)
        before, after = kept["exact"]
        low = {}
        for d, t in texts(before):
            low[normalise(t)] = min(d, low.get(normalise(t), d))
        assert sorted(low.values()) == sorted(d for d, _ in texts(after))
        before, after = kept["near"]
        assert sorted(d for d, _, c, _ in brute_components(texts(before)) if d == c) == sorted(d for d, _ in texts(after))
        before, after = kept["mix"]
        want = {r["doc_id"]: r["copies"] for r in taken_words(before).collect() if r["copies"]}
        got = [d for d, _ in texts(after)]
        assert {d: got.count(d) for d in set(got)} == want
        rows = stages["pack"](spark, docs, sf).collect()
        check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer)
    docs = no_rows
    for name, f in C.STAGES:
        docs = materialize(f(spark, docs, sf), name)
    assert docs.count() == 0


def test_registered_queries(spark, sf):
    import __spark_entry__ as e

    got = e.queries()
    assert {k.split("_")[0] for k in got if k.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in got
    assert "pipeline" not in e.oracle_sql()
