import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from cases import edge_docs, edge_texts, empty_docs

from ebbflow.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain_best_fit(sizes, length):
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits)[1]] -= size
        else:
            room.append(length - size)
    return sorted(room)


def test_segment_tree_finds_the_best_fit():
    r = random.Random(3)
    for _ in range(200):
        length = r.choice([1, 2, 7, 8, 63, 64, 100])
        sizes = [r.randint(1, length) for _ in range(r.randint(0, 60))]
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in row) for row in rows) == plain_best_fit(sizes, length)


def test_no_token_is_lost(spark):
    encode = packing.encoder(PATH)
    for shard_bytes in (1 << 10, 8 << 20):
        rows = packing.pack(edge_docs(spark), PATH, length=64, shard_bytes=shard_bytes).collect()
        pieces = defaultdict(list)
        for r in rows:
            ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
            assert len(ids) == len(positions) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
            assert (ids[r.n_tokens :] == packing.END_ID).all()
            for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
                assert positions[a:b].tolist() == list(range(b - a))
                pieces[d].append((start, tuple(ids[a:b].tolist())))
        want = defaultdict(list)
        for d, text in edge_texts():
            ids = [*encode(text or ""), packing.END_ID]
            want[d] += [(at, tuple(ids[at : at + 64])) for at in range(0, len(ids), 64)]
        assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    assert packing.pack(empty_docs(spark), PATH).count() == 0


def test_matrices_on_disk(spark, tmp_path):
    packed = packing.pack(edge_docs(spark), PATH, length=64, shard_bytes=1 << 12)
    rows = {(r.shard, r.row): r for r in packed.collect()}
    for s in packing.write_matrices(packed, f"file://{tmp_path}/out", 64).collect():
        ids, lengths = np.load(f"{s.path}.ids.npy"), np.load(f"{s.path}.cu_seqlens.npy")
        segments = np.load(f"{s.path}.segments.npy")
        assert ids.shape == np.load(f"{s.path}.positions.npy").shape == (s.rows, 64)
        at = 0
        for k in range(s.rows):
            assert ids[k].tobytes() == rows[s.shard, k].ids
            assert lengths[at : at + segments[k] + 1].tolist() == rows[s.shard, k].cu_seqlens
            at += segments[k] + 1
    assert not list(tmp_path.glob("**/*.tmp"))
