"""Links between documents whose sets of word shingles are alike, by parity sketches.

Shingles are dealt into blocks by a hash, and a block's parity sketch flips one bit for
each of its shingles; it is held as the XOR of the shingles' codes, which is the same
for equal parities.  Two sets that differ in ``d`` shingles differ in at most ``d``
blocks, and the Hamming distance of their parities is at most ``d``.

Two sets that link have at most a ninth of their joint size in difference.  So for each
band of sizes that a set can meet a partner in, the larger one's, there are half as many
blocks again as differences possible there (``blocks_of``), and partners agree in at
least ``need`` of the blocks that hold something.  Three exact steps follow:

1. sets with fewer than ``need`` blocks found elsewhere have no partner; the others keep
   their rarest blocks only, as many as a partner must hit (a prefix filter);
2. sets that share a kept block are compared by finer sketches, in tiles of bounded size;
   pairs whose Hamming distance rules out a link go.  Large blocks are first compared along
   a chain of tiles, each of their parts with the next, so that a set is in two tiles of a block
   whatever the block's size; of the pairs left in a tile a spanning forest is verified on the
   shingles, and its links make components.  This is done for each set's largest blocks, then
   for all blocks that still hold several components;
3. blocks that hold several components even then are compared in full, all tiles of parts
   that are not of one component, and every pair left between two components is verified.

Where a set leaves so many blocks empty that ``need`` is none, it is dealt anew by
further seeds until it does not; a pair is found by the first seed at which either has a
need.  Equal sets are one from the start, known by a 64-bit hash as shingles are.

Defined results: a document without words has no shingles and links with nothing; one
with fewer than five words has its whole sequence as one; a null ``doc_id`` never names
a component that holds another id; repeated rows link like copies; only ``doc_id`` and
``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import table, whole_text, with_row_id, written
from ebbflow.llm.components import components, contracted, merged
from ebbflow.llm.rolling import STEP, Powers, U, mix, prefixes, windows
from ebbflow.llm.screening import bit_map, passes

WORDS = 5
BAND_RATIO = 1.5
#: Sets in one part of a block, about: a tile is one part or two.
TILE = 256
#: Blocks of each set that are looked at first, those with most sets: they make components of most copies.
FIRST_BLOCKS = 3
FAR = 1 << 30
SECOND_STEP = 0xC2B2AE3D27D4EB4F
SEED_STEP = U(0x165667B19E3779F9)
CODE = U(0x27D4EB2F165667C5)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class Shingler:
    """Sorted distinct hashes of a text's word shingles."""

    def __init__(self, width: int = WORDS):
        self.width, self.letters, self.words = width, Powers(STEP), Powers(SECOND_STEP)

    def of(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        edges = np.flatnonzero(np.diff(~SPACE[raw], prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        if not len(start):
            return np.zeros(0, U)
        sums = prefixes(LOWER[raw].astype(U) + U(1), self.letters)
        words = mix((sums[end] - sums[start]) * self.letters.down[start] + (end - start).astype(U))
        width = min(self.width, len(words))
        return np.unique(windows(prefixes(words, self.words), width, self.words) + U(width))


def bands() -> list[int]:
    """The least size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


BANDS = bands()


def blocks_of(band: int) -> tuple[int, int]:
    """(differences that two linked sets can have, blocks) where the larger set is of this band."""
    most = 2 * (BANDS[band + 1] - 1) // 9
    return most, most + 1 + (max(2, -(-most // 2)) if most else 0)


def block_keys(shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(need << 16 | band << 8 | seed, key of each block that holds something)."""
    codes = mix(shingles ^ CODE)
    band = bisect_right(BANDS, len(shingles)) - 1
    first = band
    while band == first or BANDS[band] * 4 <= len(shingles) * 5:
        most, blocks = blocks_of(band)
        for seed in range(256):
            dealt = mix(shingles + U(seed) * SEED_STEP) >> U(32)
            block = ((dealt * U(blocks)) >> U(32)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            block = block[order]
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            parity = np.bitwise_xor.reduceat(codes[order], cut)
            place = block[cut].astype(U) + U((band << 40) + (seed << 48))
            need = len(cut) - most
            yield max(1, need) << 16 | band << 8 | seed, mix(parity + mix(place + U(1)))
            if need >= 1:
                break
        else:
            raise ValueError(f"256 seeds leave a set of {len(shingles)} shingles in too few blocks")
        band += 1


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities as 64-bit words: a power of two of bits, at least eight for each shingle."""
    bits = 1 << max(6, int(8 * len(shingles) - 1).bit_length())
    place = (mix(shingles + CODE) & U(bits - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U)


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    while len(words) > length:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def set_id(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def sets_of(texts: DataFrame) -> DataFrame:
    """rid, doc_id, set_id, n of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            found = [shingler.of(t.as_py()) for t in batch.column(2)]
            ids = pa.array([set_id(s) if len(s) else None for s in found], pa.int64())
            counts = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, counts], ["rid", "doc_id", "set_id", "n"])

    return texts.mapInArrow(run, "rid long, doc_id long, set_id long, n long")


def keyed(texts: DataFrame) -> DataFrame:
    """key, set_id, entry: one row for each block key of each document, but copies within a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            seen: set[int] = set()
            ids, entries, keys = [], [], []
            for text in batch.column(0):
                shingles = shingler.of(text.as_py())
                if len(shingles) and (own := set_id(shingles)) not in seen:
                    seen.add(own)
                    for entry, found in block_keys(shingles):
                        ids.append(own)
                        entries.append(entry)
                        keys.append(found.view(np.int64))
            if ids:
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(entries, pa.int64()), lists], ["set_id", "entry", "keys"]
                )

    rows = texts.select("text").mapInArrow(run, "set_id long, entry long, keys array<long>")
    return rows.select(F.explode("keys").alias("key"), "set_id", "entry")


def meeting_blocks(texts: DataFrame) -> DataFrame:
    """key, set_id: the blocks in which a set has to meet each of its partners (step 1)."""
    # both uses of the rows below read the same columns through the same filters, so they share one shuffle
    rows = keyed(texts).where("key is not null and entry is not null").repartition("key")
    shared = (
        rows.groupBy("key")
        .agg(
            F.min("set_id").alias("low"),
            F.max("set_id").alias("high"),
            F.count("*").alias("held"),
            F.min("entry").alias("entry"),
        )
        .where("low != high and entry > 0")
        .select("key", "held")
    )
    met = rows.join(shared.hint("shuffle_hash"), "key").distinct()
    own = Window.partitionBy("set_id", "entry")
    need = F.shiftright("entry", 16)
    return (
        met.withColumn("found", F.count("*").over(own))
        .withColumn("rank", F.row_number().over(own.orderBy("held", "key")))
        .where((F.col("found") >= need) & (F.col("rank") <= F.col("found") - need + 1))
        .select("key", "set_id")
    )


def distinct_groups(blocks: DataFrame) -> DataFrame:
    """key, set_id, size: of blocks that hold the same sets, one."""
    groups = blocks.groupBy("key").agg(F.bit_xor(F.xxhash64("set_id")).alias("sets"), F.count("*").alias("size"))
    one = groups.where("size > 1").groupBy("sets", "size").agg(F.min("key").alias("key"))
    return blocks.join(one.select("key", "size"), "key")


def described(texts: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, n, sketch, shingles of the wanted sets."""
    named = sets.join(wanted, "set_id").groupBy("set_id").agg(F.min("rid").alias("rid"))
    screen = bit_map(named.select(F.xxhash64("rid").alias("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bits = Shingler(), np.frombuffer(screen, np.uint8)
        for batch in batches:
            may = np.flatnonzero(passes(bits, batch.column(2).to_numpy().view(U)))
            if not len(may):
                continue
            batch = batch.take(pa.array(may))
            found = [shingler.of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([set_id(s) for s in found], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([sketch(s).tobytes() for s in found], pa.binary()),
                    pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                ],
                ["rid", "set_id", "n", "sketch", "shingles"],
            )

    read = texts.select("rid", "text", F.xxhash64("rid").alias("hash")).mapInArrow(
        run, "rid long, set_id long, n long, sketch binary, shingles array<long>"
    )
    return read.join(named, ["rid", "set_id"]).drop("rid").dropDuplicates(["set_id"])


def with_sketches(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows with n and sketch of their set.  Sketches grow with the table and pack far below their size: never broadcast."""
    return rows.join(sketches.hint("merge"), "set_id").select("key", "i", "j", "part", "set_id", "root", "n", "sketch")


def chained_tiles(blocks: DataFrame) -> DataFrame:
    """key, i, j, part, set_id, root: each part of a block beside the next, as one tile; a set is in two at most."""
    sizes = blocks.groupBy("key").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / TILE)
    own = F.col("own")
    tiles = F.when(F.col("parts") <= 2, F.array(F.lit(0).cast("long"))).otherwise(F.array(own, F.pmod(own + 1, F.col("parts"))))
    return (
        blocks.join(sizes.where("size > 1"), "key")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("parts")))
        .withColumn("i", F.explode(tiles))
        .select("key", "i", F.col("i").alias("j"), F.lit(0).cast("long").alias("part"), "set_id", "root")
    )


def all_tiles(blocks: DataFrame) -> DataFrame:
    """key, i, j, part, set_id, root: every two sets of a block that differ in root, in some tile.

    A block of up to ``TILE`` sets is one tile.  A larger one is cut into parts, each of one root with many sets in
    the block or of several with few, and two parts make a tile unless they have the same one root.
    """
    sizes = blocks.groupBy("key").agg(F.count("*").alias("size"))
    rows = blocks.join(sizes, "key")
    zero = F.lit(0).cast("long")
    small = rows.where(f"size <= {TILE}").select("key", zero.alias("i"), zero.alias("j"), zero.alias("part"), "set_id", "root")
    large = rows.where(f"size > {TILE}")
    of_root = large.groupBy("key", "root").agg(F.count("*").alias("held"))
    alone = F.col("held") >= TILE // 2
    rest = of_root.where(~alone).groupBy("key").agg(F.sum("held").alias("rest"))
    cut = of_root.join(rest, "key", "left").select(
        "key", "root", alone.alias("alone"), F.ceil(F.when(alone, F.col("held")).otherwise(F.col("rest")) / TILE).alias("parts")
    )
    named = F.when(F.col("alone"), F.xxhash64(F.col("root"), "nth")).otherwise(F.xxhash64("nth"))
    each = cut.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    each = each.select("key", F.when(F.col("alone"), F.col("root")).alias("only"), named.alias("part")).distinct()
    p, q = each.alias("p"), each.alias("q")
    meet = (F.col("p.key") == F.col("q.key")) & ~F.coalesce(F.col("p.only") == F.col("q.only"), F.lit(False))
    pairs = p.join(q, meet).select(F.col("p.key").alias("key"), F.col("p.part").alias("part"), F.col("q.part").alias("other"))
    own = large.join(cut, ["key", "root"]).withColumn("nth", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    tiles = own.withColumn("part", named).join(pairs, ["key", "part"])
    i, j = F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    return small.unionByName(tiles.select("key", i, j, "part", "set_id", "root"))


def margins(part, ids, roots, sizes, sketches) -> np.ndarray:
    """For each two sets of a tile, how far inside a link's bound their sketches are; FAR if they cannot link."""
    length = min(map(len, sketches)) // 8
    held = np.stack([folded(np.frombuffer(s, U), length) for s in sketches])
    out = np.full((len(ids), len(ids)), FAR, np.int32)
    between = (part != part[0]).any()
    for k in range(len(ids) - 1):
        apart = np.bitwise_count(held[k + 1 :] ^ held[k]).sum(axis=1, dtype=np.int64)
        over = 9 * apart - sizes[k] - sizes[k + 1 :]
        may = (over <= 0) & (roots[k + 1 :] != roots[k])
        may &= 5 * np.minimum(sizes[k], sizes[k + 1 :]) >= 4 * np.maximum(sizes[k], sizes[k + 1 :])
        if between:
            may &= part[k + 1 :] != part[k]
        out[k, k + 1 :] = out[k + 1 :, k] = np.where(may, over, FAR)
    return out


def closest_forest(near: np.ndarray) -> np.ndarray:
    """Edges (rows of two places) of a spanning forest of the closest pairs, grown from the first set on."""
    n = len(near)
    best, source = np.full(n, FAR, np.int32), np.full(n, -1)
    out, left = [], np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmin(np.where(left, best, FAR + 1)))
        left[at] = False
        if best[at] < FAR:
            out.append((source[at], at))
        nearer = left & (near[at] < best)
        best[nearer], source[nearer] = near[at][nearer], at
    return np.array(out, np.int64).reshape(-1, 2)


def near_pairs(tiles: DataFrame, forest: bool) -> DataFrame:
    """a, b: sets of a tile of different roots that their sketches may link; a spanning forest of the closest at will."""

    def compare(part, ids, roots, sizes, sketches) -> np.ndarray:
        order = np.argsort(ids)  # tiles with the same sets then choose the same forest
        sketches = [sketches[k] for k in order]
        near = margins(part[order], ids[order], roots[order], sizes[order], sketches)
        places = closest_forest(near) if forest else np.argwhere(np.triu(near < FAR, 1))
        return np.sort(ids[order][places], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "i", "j", "part", "set_id", "root", "n"]
        kept: list = []
        for batch in chained(batches):
            last = batch is None
            tables = kept if last else [*kept, batch]
            if not tables:
                continue
            rows = pa.Table.from_batches(tables).combine_chunks()
            c = {k: rows.column(k).to_numpy() for k in names}
            new = np.ones(len(rows), bool)
            new[1:] = (np.diff(c["key"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)
            starts = [*np.flatnonzero(new).tolist(), len(rows)]
            if not last:
                kept = rows.slice(starts[-2]).to_batches()
                starts = starts[:-1]
            sketches = rows.column("sketch")
            found = []
            for a, b in zip(starts, starts[1:]):
                if b - a > 1 and not (c["root"][a:b] == c["root"][a]).all():
                    blobs = sketches.slice(a, b - a).to_pylist()
                    found.append(compare(c["part"][a:b], c["set_id"][a:b], c["root"][a:b], c["n"][a:b], blobs))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingles make a link."""
    a = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    b = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("s_a", "s_b")))
    return both.where("100 * both >= 80 * (n_a + n_b - both)").select("a", "b")


def rooted(blocks: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows of blocks (key, set_id) whose sets have several roots."""
    if roots is None:
        return blocks.select("key", "set_id", F.col("set_id").alias("root"))
    rows = blocks.select("key", "set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rows = rows.withColumn("root", F.coalesce("root", "set_id"))
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return rows.join(several.select("key"), "key", "left_semi")


def most_held(blocks: DataFrame) -> DataFrame:
    """Of the blocks of each set, the FIRST_BLOCKS that hold most sets."""
    order = Window.partitionBy("set_id").orderBy(F.desc("size"), "key")
    return blocks.withColumn("nth", F.row_number().over(order)).where(f"nth <= {FIRST_BLOCKS}").drop("nth")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components with these links too."""
    if links.isEmpty():
        return roots
    return components(links) if roots is None else merged(roots, components(contracted(links, roots)))


def set_components(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """node (set_id), root: the components of the sets that link with another."""
    blocks = written(distinct_groups(written(meeting_blocks(texts), "blocks")), "groups")
    held = written(described(texts, sets, blocks.select("set_id").distinct()), "sets")
    sketches = held.select("set_id", "n", "sketch")
    roots, tried = None, []
    for some in (most_held(blocks), blocks):
        rows = written(rooted(some, roots), "rooted")
        tried.append(written(near_pairs(with_sketches(chained_tiles(rows), sketches), forest=True), "pairs"))
        roots = joined(roots, written(verified(tried[-1], held), "links"))
    rows = written(rooted(blocks, roots), "rooted")
    rest = near_pairs(with_sketches(all_tiles(rows), sketches), forest=False)
    for pairs in tried:
        rest = rest.join(pairs, ["a", "b"], "left_anti")
    roots = joined(roots, written(verified(rest, held), "links"))
    return blocks.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots


def document_components(docs: DataFrame) -> DataFrame:
    """rid (see with_row_id), doc_id, n, component_id of every document."""
    texts = with_row_id(docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))).select("rid", "row.*")
    sets = written(sets_of(texts), "shingled")
    some = sets.where("n > 0")
    roots = set_components(texts, some.select("rid", "set_id"))
    least = some.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    least = least.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "doc_id", F.coalesce("root", "set_id").alias("root")
    )
    named = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = least.join(named, "root").select("set_id", "component_id")
    return sets.join(by_set, "set_id", "left").select(
        "rid", "doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return document_components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that name their component; rows with one id stay or go together."""
    kept = document_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("rid").distinct()
    return with_row_id(docs).join(kept, "rid", "left_semi").select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, its set of word shingles and the component it is linked to."""
    return near_duplicates(table(spark, sf_dir, "documents"))
