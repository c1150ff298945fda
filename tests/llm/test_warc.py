import base64
import gzip
import hashlib

import pytest

from ebbflow.llm import warc
from ebbflow.llm.common import shared_folder

PAGES = [
    (1, "http://a.example/1", "<p>one</p>"),
    (2, "http://a.example/2", "<p>two</p>"),
    (3, None, "<p>one</p>"),
    (4, "http://a.example/\r\nX: 4é", ""),
    (5, "http://b.example/", None),
    (6, "http://b.example/6", "<p>one</p>"),
    (6, "http://b.example/6", "<p>one</p>"),
    (7, "http://b.example/7", "é" * 300_000),
    (None, "http://b.example/n", "<p>two</p>"),
]
SCHEMA = "page_id long, url string, html string, range string, sha string, kind string, shard string"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", None, "y", None) for r in rows], SCHEMA).repartition(3)


def archived(spark, rows=PAGES, **how):
    root = shared_folder(spark, "warc-test")
    manifest = warc.write_warc(pages(spark, rows), root, **how)
    return root, spark.read.parquet(manifest), warc.read_warc(spark, manifest, root).collect()


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    _, _, rows = archived(spark, shard_bytes=200, roll_bytes=300)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows)
    largest = {digest("<p>one</p>"): 6, digest("<p>two</p>"): 2, digest(""): 5, digest(PAGES[7][2]): 7}
    want, seen = [], set()
    for i, _, html in sorted(PAGES, key=str):
        d, first = digest(html), False
        if largest[d] == i and i not in seen:
            seen.add(i)
            first = True
        want.append((str(i), len((html or "").encode()), d, "response" if first else "revisit", "None" if first else str(largest[d])))
    assert got == sorted(want)
    held = {r.page_id: r.payload.decode() for r in rows if r.record_type == "response"}
    assert held == {6: "<p>one</p>", 2: "<p>two</p>", 5: "", 7: PAGES[7][2]}
    assert {r.page_id: r.url for r in rows}[4] == "http://a.example/%0D%0AX: 4é"


def test_small_payloads_are_no_revisits(spark):
    _, _, rows = archived(spark, min_bytes=11)
    assert {r.record_type for r in rows} == {"response"}


def test_same_rows_same_files(spark):
    names = []
    for parts in (PAGES, PAGES[::-1]):
        root, manifest, _ = archived(spark, parts, shard_bytes=200, roll_bytes=300)
        files = sorted(manifest.collect(), key=lambda r: (r.shard, r.seq))
        names.append([(r.path.rpartition("/")[2], hashlib.sha1(open(r.path, "rb").read()).hexdigest()) for r in files])
        assert len(files) > 2 and sum(r.records for r in files) == len(PAGES)
        assert gzip.open(files[0].path).read().startswith(b"WARC/1.1\r\n")
    assert names[0] == names[1]


@pytest.mark.parametrize("far", [[], [9 * 10**12], [-(2**63), 2**63 - 1], [10**6 + k for k in range(50)]])
def test_ids_far_off_do_not_fill_one_shard(spark, far):
    ids = [*range(2000), *far, None]
    rows = pages(spark, [(i, None, "x" * 99) for i in ids])
    ranged, n_shards = warc.with_range(rows.select("page_id", "url", "html"), 10_000)
    shards = warc.shard_of_range(ranged.withColumn("size", warc.F.lit(100)), 10_000)
    got = ranged.join(shards, "range").select("page_id", "range", "shard").collect()
    order = sorted(got, key=lambda r: (r.page_id is not None, r.page_id or 0))
    assert [r.range for r in order] == sorted(r.range for r in got) and [r.shard for r in order] == sorted(r.shard for r in got)
    held = [sum(r.shard == s for r in got) for s in {r.shard for r in got}]
    assert len(got) == len(ids) and n_shards == -(-len(ids) // 100)
    assert len(held) >= n_shards - 1 and max(held) <= 115


def test_a_damaged_block_is_found():
    raw = gzip.decompress(warc.member(1, "u", b"payload", None, False))
    assert warc.parse(raw)[2] == 7
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paylaod"))


def test_empty_table(spark):
    assert archived(spark, [])[2] == []
