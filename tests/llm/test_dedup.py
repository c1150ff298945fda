import hashlib
import re
import string
from collections import defaultdict

import duckdb
import numpy as np
from cases import edge_docs, edge_texts, empty_docs, words

from ebbflow.llm import exact_dedup, fuse, jaccard_join, suffix_dedup
from ebbflow.llm.common import table
from ebbflow.llm.components import components
from ebbflow.llm.rolling import Powers
from ebbflow.llm.suffix_sort import Text, equal_neighbours, sort_groups

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# ------------------------------------------------------------------ exact copies
def test_fuse_filter_holds_its_keys():
    for n in (0, 1, 2, 3, 17, 1000, 50_000):
        r = np.random.default_rng(n)
        keys = r.integers(0, 1 << 63, n).astype(np.uint64)
        blob = fuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse.contains(blob, keys).all()
        assert fuse.contains(blob, r.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01


def test_exact_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(exact_dedup.OP5_SQL).fetchall())
    assert sorted(map(tuple, exact_dedup.op5_exact_dedup(spark, SF).collect())) == want


def expected_copies(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        for k, i in enumerate(sorted(ids, key=str)):
            first = i == keep and (k == 0 or sorted(ids, key=str)[k - 1] != i)
            out.append((str(i), str(keep), len(ids), first, digest))
    return sorted(out)


def test_exact_dedup_edge_cases(spark):
    new = exact_dedup.second_half()
    for is_new in (new, new.isNull(), ~new.isNull()):  # dealt, all in the snapshot, all in the batch
        rows = exact_dedup.exact_dedup(edge_docs(spark), is_new).collect()
        assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in rows) == expected_copies(edge_texts())
        assert exact_dedup.exact_dedup(empty_docs(spark), is_new).count() == 0
    kept = exact_dedup.drop_copies(edge_docs(spark), new)
    assert kept.columns == edge_docs(spark).columns
    want = sorted((r[0], r[4]) for r in expected_copies(edge_texts()) if r[3])
    got = [(str(r.doc_id), hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got) == want


# ------------------------------------------------------------------ near copies
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted((str(i), len(sets[k]), str(least.get(top(k), i))) for k, (i, _) in enumerate(rows))


def near(spark, rows):
    found = jaccard_join.near_duplicates(edge_docs(spark, rows)).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)


def test_jaccard_edge_cases(spark):
    assert near(spark, edge_texts()) == brute_components(edge_texts())
    assert near(spark, []) == []
    kept = jaccard_join.drop_near_duplicates(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["1", "4", "5", "6", "7", "9", "11", "12", "13", "None", "14", "15"]
    )


def test_jaccard_near_the_bound(spark):
    rows, k = [], 0
    for size in (5, 6, 7, 9, 12, 20, 33, 60, 150, 400):
        base = words(size, size).split(" ")
        for edits in range(8):
            changed = list(base)
            for e in range(edits):
                changed[(e * 7) % size] = f"x{size}y{edits}"
            rows.append((k := k + 1, " ".join(changed)))
            rows.append((k := k + 1, " ".join(base[: size - edits])))
    assert near(spark, rows) == brute_components(rows)


def copies_of(base, n, seed, edits):
    """Near copies of a text: ``edits`` words of each changed, at places of its own."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        changed = list(base)
        for place in r.choice(len(base), edits, replace=False):
            changed[place] = f"w{seed}x{k}y{place}"
        out.append(" ".join(changed))
    return out


def test_blocks_of_many_tiles(spark, monkeypatch):
    """Groups far larger than a tile, of close copies, of copies about the bound, and two that share blocks without a link."""
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    base = words(41, 100).split(" ")
    other = base[:62] + words(42, 38).split(" ")
    texts = copies_of(base, 60, 1, 1) + copies_of(base, 50, 2, 3) + copies_of(other, 40, 3, 1) + copies_of(words(43, 60).split(" "), 30, 4, 1)
    rows = list(enumerate(texts, 1))
    got = near(spark, rows)
    assert got == brute_components(rows) and len({c for _, _, c in got}) < len(rows)


def test_all_tiles_meet_every_two_roots(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    roots = [1] * 30 + [2] * 21 + [3] * 5 + [4, 5, 6, 7]
    rows = [(9, k, r) for k, r in enumerate(roots)] + [(8, k, r) for k, r in enumerate(roots[26:34])]
    blocks = spark.createDataFrame(rows, "key long, set_id long, root long")
    tiles = jaccard_join.all_tiles(blocks).collect()
    met = {}
    for t in tiles:
        met.setdefault((t.key, t.i, t.j), []).append(t)
    pairs = set()
    for (key, i, j), held in met.items():
        pairs |= {(key, *sorted((a.set_id, b.set_id))) for a in held for b in held if a.root != b.root and (i == j or a.part != b.part)}
        assert len(held) <= 40
    want = {(k, *sorted((a, b))) for k, a, ra in rows for m, b, rb in rows if k == m and ra != rb}
    assert pairs == want


def test_tiles_grow_with_the_group(spark):
    made = []
    for n in (600, 1200):
        blocks = spark.range(n).selectExpr("1L AS key", "id AS set_id", "id AS root")
        made.append(jaccard_join.chained_tiles(blocks).count())
    assert made[0] <= 2 * 600 and made[1] <= 2 * 1200


def test_jaccard_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert near(spark, rows) == brute_components(rows)


def test_blocks_of_every_size_leave_a_need():
    r = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 1000, 5000]:
        entries = list(jaccard_join.block_keys(np.sort(r.integers(0, 1 << 63, n).astype(np.uint64))))
        assert all(entry >> 16 >= 1 and len(keys) for entry, keys in entries)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (60, 50), (70, 60), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(1, 41)} | {50: 50, 60: 50, 70: 50, 100: 50}


# ------------------------------------------------------------------ passages
def brute_cut(rows, length=50):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1) if i is not None else ():
            g = b[p : p + length]
            least[g] = min(least.get(g, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1) if i is not None else ():
            if least[b[p : p + length]] < i:
                gone[p : p + length] = True
        runs = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((str(i), len(b), runs[::2].tolist(), runs[1::2].tolist(), kept))
    return sorted(out)


def cut(spark, rows):
    found = suffix_dedup.remove_repeats(edge_docs(spark, rows)).collect()
    return sorted((str(r.doc_id), r.n_bytes, list(r.starts), list(r.ends), bytes(r.kept)) for r in found)


def test_suffix_dedup_edge_cases(spark):
    rows = [(i, t if t is None else t[:2000]) for i, t in edge_texts()]
    assert cut(spark, rows) == brute_cut(rows)
    assert cut(spark, []) == []


def test_suffix_dedup_passages(spark):
    parts = [words(k, 12) for k in range(30)] + ["ab" * 60, "a" * 120]
    r = np.random.default_rng(4)
    rows = [(k, " ".join(parts[p] for p in r.integers(0, len(parts), r.integers(1, 9)))) for k in range(60)]
    assert cut(spark, rows) == brute_cut(rows)


def test_suffix_dedup_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert cut(spark, rows) == brute_cut(rows)


def test_hot_anchors_split_over_tasks(spark, monkeypatch):
    shared = words(5, 12)
    rows = [(k, f"{words(100 + k, 6)} {shared} {words(200 + k % 7, 6)}") for k in range(40)]
    monkeypatch.setattr(suffix_dedup, "HOT_REGIONS", 3)
    sizes = []
    repartition = type(spark.range(1)).repartition

    def spied(df, *columns):
        if columns == ("anchor", "part"):
            sizes.extend(df.groupBy("anchor", "part").count().groupBy("anchor").count().toPandas()["count"])
        return repartition(df, *columns)

    monkeypatch.setattr(type(spark.range(1)), "repartition", spied)
    assert cut(spark, rows) == brute_cut(rows)
    assert max(sizes) > 3


def test_a_hot_string_is_sorted_in_bounded_pieces(monkeypatch):
    n = 100
    text = bytes(range(50))
    columns = [np.full(n, 7), np.full(n, 9), np.arange(n), np.zeros(n, int), np.arange(n), np.zeros(n, int), np.full(n, 4)]
    rows = suffix_dedup.pa.table([*map(suffix_dedup.pa.array, columns), suffix_dedup.pa.array([text] * n)], suffix_dedup.SENT)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 500)
    seen, sort = [], suffix_dedup.earlier_strings
    monkeypatch.setattr(suffix_dedup, "earlier_strings", lambda rows, powers: seen.append(len(rows)) or sort(rows, powers))
    told = [r for b in suffix_dedup.sort_stream(iter(rows.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    assert sorted({(r["region"], r["first"], r["last"]) for r in told}) == [(k, 4, 4) for k in range(1, n)]
    assert max(seen) <= 12


def test_texts_longer_than_a_piece(monkeypatch):
    anchors = suffix_dedup.Anchors()
    monkeypatch.setattr(suffix_dedup, "PIECE_BITS", 9)
    data = np.random.default_rng(2).integers(97, 100, 3000).astype(np.uint8)
    _, _, first, last, _ = anchors.of(data)
    assert first[0] == 0 and last[-1] == 3000 - 50 and (first[1:] == last[:-1] + 1).all()


def test_suffix_sort():
    r = np.random.default_rng(0)
    for letters in (1, 2, 4, 26):
        data = r.integers(97, 97 + letters, 4000).astype(np.uint8)
        text = Text(data, 20, Powers())
        sizes = np.array([1, 2, 3, 9, 100, 900, 1])
        starts = r.permutation(3900)[: sizes.sum()]
        order = sort_groups(text, starts, sizes)
        equal, at = equal_neighbours(text, order, sizes), 0
        for size in sizes:
            own = [bytes(data[i : i + 20]) for i in order[at : at + size]]
            assert sorted(order[at : at + size]) == sorted(starts[at : at + size]) and own == sorted(own)
            assert equal[at : at + size].tolist() == [False, *(x == y for x, y in zip(own, own[1:]))]
            at += size
