"""Removal of passages that also start in an earlier document, by suffix sorting.

Every string of ``LENGTH`` bytes has an anchor: of the ``ANCHOR``-byte strings in it, the
one whose hash is least.  Equal strings have equal anchors at the same place, so only
what stands around equal anchors needs comparing.  The strings of one anchor lie side by
side, and the bytes that they cover are its region.

1. Batches of documents (dealt by the hash of their id) give, for each anchor and region,
   the least and greatest document; one shuffle by anchor finds the regions that more than
   one document has, and the anchors with several regions.  A region that is also in a
   smaller document goes as a whole.
2. For anchors with several regions, the first document of each region sends its bytes;
   the suffixes that start their strings are sorted by hash comparison, equal neighbours
   are verified byte by byte, and strings that some smaller document has are told.
   An anchor with more than ``HOT_REGIONS`` sends every string by itself, dealt by the hash
   of its bytes, so that it spreads over tasks and equal strings still meet.
3. Each batch marks what was told, and cuts it out of its texts.

Regions are known by two 64-bit hashes, of the anchor and of the whole.  A hot passage
sends one row a batch, not one a document.  Defined results: a null or empty text, or one
under ``LENGTH`` bytes, stays as it is; documents with equal ids take nothing from each
other; one with a null id neither gives nor loses bytes; only ``doc_id`` and ``text`` are
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import blocks_for, table, whole_text, written
from ebbflow.llm.rolling import STEP, Powers, U, mix, prefixes, windows
from ebbflow.llm.suffix_sort import Text, equal_neighbours, sort_groups

LENGTH = 50
ANCHOR = 16
BATCH_BYTES = 8 << 20
#: Bytes of a text looked at in one go, and positions that fit beside a hash in 64 bits.
PIECE_BITS = 20
#: Bytes of regions that are suffix-sorted at once, beyond one anchor's.
SORT_BYTES = 4 << 20
#: Regions that one task sorts for one anchor.
HOT_REGIONS = 20_000
I64 = np.int64
SENT = pa.schema([(n, pa.int64()) for n in ("anchor", "part", "region", "batch", "least", "before", "nth")] + [("bytes", pa.binary())])


class Anchors:
    """Anchors of texts with what surrounds them."""

    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        self.length, self.anchor, self.powers = length, anchor, Powers()

    def of(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, region hash, first start, last start, anchor's place), one for each anchor in order."""
        pieces = []
        step = (1 << PIECE_BITS) - self.length
        for at in range(0, max(1, len(data) - self.length + 1), step):
            piece = data[at : at + step + self.length - 1]
            if len(piece) >= self.length:
                h, r, first, last, place = self.piece(piece)
                pieces.append((h, r, first + at, last + at, place + at))
        if not pieces:
            none = np.zeros(0, I64)
            return none.astype(U), none.astype(U), none, none, none
        return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))

    def piece(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        prefix = prefixes(data.astype(U) + U(1), self.powers)
        hashes = windows(prefix, self.anchor, self.powers)
        low = U((1 << PIECE_BITS) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=U)
        width, span = 1, self.length - self.anchor + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        place = (least & low).astype(I64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        region = (prefix[last + self.length] - prefix[first]) * self.powers.down[first]
        return hashes[place], mix(region + (last - first).astype(U)), first, last, place


def named(anchor: np.ndarray, region: np.ndarray) -> np.ndarray:
    """A region's name: with its anchor's hash it stands for both hashes, alone it is 64 bits of them."""
    return mix(anchor ^ mix(region))


def texts_in(batch: pa.Table) -> Iterator[tuple[int | None, np.ndarray]]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        held = text.as_buffer()
        yield doc_id, np.frombuffer(held, np.uint8) if held.size else np.zeros(0, np.uint8)


def regions_of_batch(batch: pa.Table) -> pa.Table:
    """anchor, region (its name), low, more: what the documents of a batch hold, each region once.

    ``low`` is the least document with the region, ``low + more`` the greatest.
    """
    anchors = Anchors()
    found = []
    for doc_id, data in texts_in(batch.filter(pc.is_valid(batch.column("doc_id"))).sort_by("doc_id")):
        h, r, *_ = anchors.of(data)
        found.append((h, named(h, r), np.full(len(h), doc_id, I64)))
    none = np.zeros(0, I64)
    h, name, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)
    order = np.argsort(name, kind="stable")
    name, d = name[order], d[order]
    cut = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else none
    low, high = (d[cut], d[np.r_[cut[1:], len(d)] - 1]) if len(name) else (none, none)
    return pa.table(
        {"anchor": h[order[cut]].view(I64), "region": name[cut].view(I64), "low": low, "more": high - low}
    )


def told_regions(regions: DataFrame, batch_of: Callable[[str], Column]) -> DataFrame:
    """batch, anchor, region, least, owner, hot: regions that concern a batch.

    ``least`` is the first document with the region; ``owner`` says that the batch holds it
    and has to send the bytes, as the anchor has other regions elsewhere.
    """
    return (
        regions.repartition("anchor")
        .selectExpr(
            "*",
            "min(low) over (partition by anchor, region) as least",
            "min(region) over (partition by anchor) <> max(region) over (partition by anchor)"
            " and min(low) over (partition by anchor) < max(low + more) over (partition by anchor) as several",
            f"count(*) over (partition by anchor) > {HOT_REGIONS} as hot",
        )
        .withColumn("owner", F.col("several") & (F.col("low") == F.col("least")))
        .where("owner or low + more > least")
        .select(batch_of("low").alias("batch"), "anchor", "region", "least", "owner", "hot")
    )


def sent_bytes(batch: pa.Table, told: pa.Table) -> pa.Table:
    """The regions that the batch's documents own as in SENT: whole, part 0, or the strings of hot anchors one by one.

    ``part`` is a hash of a string's bytes, ``nth`` the string's number in its region.
    """
    longs: list[tuple] = []
    blobs: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    if batch.num_rows and told.num_rows:
        names, least = told.column("region").to_numpy().view(U), told.column("least").to_numpy()
        order = np.argsort(names)
        names, least, hot = names[order], least[order], told.column("hot").to_numpy(zero_copy_only=False)[order]
        sent = np.zeros(len(names), bool)
        anchors = Anchors()
        for doc_id, data in texts_in(batch):
            if doc_id is None or len(data) < LENGTH:
                continue
            h, r, first, last, place = anchors.of(data)
            own = named(h, r)
            at, has = lookup(names, own)
            mine = np.flatnonzero(has & (least[at] == doc_id) & ~sent[at])
            if not len(mine):
                continue
            mine = mine[np.unique(at[mine], return_index=True)[1]]
            sent[at[mine]] = True
            begin, strings, nth = first[mine], last[mine] - first[mine] + 1, np.zeros(len(mine), I64)
            apart = hot[at[mine]]
            if apart.any():
                rows = np.where(apart, strings, 1)
                mine, begin, strings, apart = (np.repeat(x, rows) for x in (mine, begin, np.where(apart, 1, strings), apart))
                nth = np.arange(len(mine)) - np.repeat(np.cumsum(rows) - rows, rows)
                begin = begin + nth
            part = np.zeros(len(mine), U)
            if apart.any():
                whole = windows(prefixes(data.astype(U) + U(1), anchors.powers), LENGTH, anchors.powers)
                part[apart] = whole[begin[apart]] | U(1)
            size = strings + LENGTH - 1
            ends = np.cumsum(size)
            blobs.append(data[np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)])
            lengths.append(size)
            before = place[mine] - begin
            longs.append((h[mine].view(I64), part.view(I64), own[mine].view(I64), np.full(len(mine), doc_id, I64), before, nth))
    if not longs:
        return pa.table([pa.array([], f.type) for f in SENT], SENT)
    h, part, name, doc, before, nth = (np.concatenate(x) for x in zip(*longs, strict=True))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
    held = pa.Array.from_buffers(
        pa.binary(), len(h), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate(blobs).tobytes())]
    )
    number = np.full(len(h), told.column("batch")[0].as_py(), I64)
    return pa.table([*map(pa.array, (h, part, name, number, doc, before, nth)), held], SENT)


def lookup(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``names``, and whether each wanted one is there."""
    at = np.minimum(np.searchsorted(names, wanted), max(0, len(names) - 1))
    return at, names[at] == wanted if len(names) else np.zeros(len(wanted), bool)


def earlier_strings(rows: pa.Table, powers: Powers) -> pa.Table:
    """batch, region, least, first, last: runs of the regions' strings that a smaller document has, by suffix sort."""
    blobs = rows.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], I64)
    begin = np.cumsum(sizes) - sizes
    strings = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(blobs)), strings)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    anchor = rows.column("anchor").to_numpy()[owner]
    before = rows.column("before").to_numpy()[owner] - nth  # the anchor's place in the string
    text = Text(data, LENGTH, powers)
    starts = begin[owner] + nth
    # equal strings have equal ends: only the suffixes that agree there are sorted together
    ends = text.words(starts) * U(STEP) + text.words(starts + LENGTH - 8)
    key = mix(anchor.view(U) + mix(ends + before.astype(U)))
    order = np.argsort(key, kind="stable")
    starts, owner, nth = starts[order], owner[order], nth[order]
    cut = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else order
    groups = np.diff(np.append(cut, len(order)))
    busy = np.repeat(groups > 1, groups)
    starts, owner, nth, groups = starts[busy], owner[busy], nth[busy], groups[groups > 1]
    ranked = sort_groups(text, starts, groups)
    same = equal_neighbours(text, ranked, groups)
    back = np.argsort(starts, kind="stable")  # starts are distinct: places of the sorted ones in the rows above
    source = back[np.searchsorted(starts[back], ranked)]
    who = owner[source]
    where = nth[source] + rows.column("nth").to_numpy()[who]
    doc = rows.column("least").to_numpy()[who]
    classes = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(doc, classes), np.diff(np.append(classes, len(doc)))) if len(doc) else doc
    hit = least < doc
    who, where = who[hit], where[hit]
    order = np.lexsort((where, who))
    who, where = who[order], where[order]
    cut = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(where, prepend=-2) != 1))
    ends = np.append(cut[1:], len(who))[: len(cut)] - 1  # none without a hit
    told = rows.take(pa.array(who[cut])).select(["batch", "region", "least"])
    return told.append_column("first", pa.array(where[cut])).append_column("last", pa.array(where[ends]))


def firsts(rows: pa.Table) -> pa.Table:
    """The first row of each string among the strings of one part, which come in the order of their documents."""
    seen: dict[bytes, int] = {}
    for k, held in enumerate(rows.column("bytes").to_pylist()):
        seen.setdefault(held, k)
    return rows.take(pa.array(list(seen.values()), pa.int64()))


def sort_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sorts rows that come in the order of their anchors and parts, some at a time."""
    powers = Powers()
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SORT_BYTES:
            rows = pa.Table.from_batches(held)
            anchor, part = rows.column("anchor").to_numpy(), rows.column("part").to_numpy()
            other = np.flatnonzero((anchor != anchor[-1]) | (part != part[-1])) if len(anchor) else []
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from earlier_strings(rows.slice(0, cut).combine_chunks(), powers).to_batches()
            rows = rows.slice(cut).combine_chunks()
            if len(rows) and part[-1] and not cut:  # one hot string: only its first document is needed for the rest
                yield from earlier_strings(rows, powers).to_batches()
                rows = firsts(rows)
            held = rows.to_batches()
            size = sum(b.nbytes for b in held) if cut or len(rows) and part[-1] else 0
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        if len(rows):
            yield from earlier_strings(rows, powers).to_batches()


def cut_batch(batch: pa.Table, told: pa.Table) -> pa.Table:
    """doc_id, n_bytes, starts, ends, kept of a batch's documents.

    Told rows with ``first`` -1 say from which document on a region goes as a whole, the
    others which of its strings go in the first document that has it.
    """
    c = {k: told.column(k).to_numpy() for k in ("region", "least", "first", "last")}
    names, least = c["region"].view(U), c["least"]
    parts = np.flatnonzero(c["first"] >= 0)
    parts = parts[np.argsort(names[parts], kind="stable")]
    part_names, part_first, part_last = names[parts], c["first"][parts], c["last"][parts]
    order = np.argsort(names)
    names, least = names[order], least[order]
    anchors = Anchors()
    out: list[list] = [[], [], [], [], []]
    for doc_id, data in texts_in(batch):
        starts = ends = np.zeros(0, I64)
        kept = data
        if doc_id is not None and len(data) >= LENGTH and len(names):
            h, r, first, last, _ = anchors.of(data)
            own = named(h, r)
            at, has = lookup(names, own)
            gone = np.flatnonzero(has & (least[at] < doc_id))
            begin, end = [first[gone]], [last[gone] + LENGTH]
            if len(parts):
                mine = np.flatnonzero(has & (least[at] == doc_id))
                low, high = (np.searchsorted(part_names, own[mine], side) for side in ("left", "right"))
                count = high - low
                mine = np.repeat(mine, count)
                which = np.arange(len(mine)) + np.repeat(low - (np.cumsum(count) - count), count)
                begin.append(first[mine] + part_first[which])
                end.append(first[mine] + part_last[which] + LENGTH)
            begin, end = np.concatenate(begin), np.concatenate(end)
            if len(begin):
                n = len(data) + 1
                delta = np.bincount(begin, minlength=n) - np.bincount(end, minlength=n)
                removed = np.cumsum(delta[:-1]) > 0
                edges = np.flatnonzero(np.diff(removed, prepend=False, append=False))
                starts, ends = edges[::2], edges[1::2]
                kept = data[~removed]
        for column, value in zip(out, (doc_id, len(data), starts, ends, kept.tobytes()), strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "starts", "ends", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, starts and ends (of removed runs), kept (the other bytes) of every document."""
    texts = docs.select(F.col("doc_id").cast("long"), F.encode(whole_text(), "UTF-8").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    n_batches = blocks_for(total or 0, BATCH_BYTES)

    def batch_of(column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n_batches))

    batch = F.when(F.col("doc_id").isNull(), batch_of("text")).otherwise(batch_of("doc_id"))
    dealt = texts.withColumn("batch", batch).select("batch", "doc_id", "text")
    regions = dealt.groupBy("batch").applyInArrow(regions_of_batch, "anchor long, region long, low long, more long")
    told = written(told_regions(regions, batch_of), "regions")
    sent = (
        dealt.groupBy("batch")
        .cogroup(told.where("owner").groupBy("batch"))
        .applyInArrow(sent_bytes, "anchor long, part long, region long, batch long, least long, before long, nth long, bytes binary")
    )
    strings = (
        sent.repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part", "least")
        .mapInArrow(sort_stream, "batch long, region long, least long, first long, last long")
    )
    whole = told.selectExpr("batch", "region", "least", "-1L as first", "-1L as last")
    return (
        dealt.groupBy("batch")
        .cogroup(whole.unionByName(strings).groupBy("batch"))
        .applyInArrow(cut_batch, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the bytes that a document before it holds too."""
    gone = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
