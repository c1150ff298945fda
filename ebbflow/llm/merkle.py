"""Merkle manifest of a table: every row's digest, its proof, and a root over all sources.

The leaves of a source, in order of ``doc_id``, are cut into aligned tiles of 16**3; a
tile is one partition of the exchange.  It hashes its own subtree, and from there on
the roots travel by a butterfly: in round r, tiles whose numbers (to the base 16)
differ in digit r only swap the roots they hold, and each hashes the common ancestor
for itself.  All tiles below a node hold its digest, so the proof of the levels above a
tile is complete when the rounds are over, and nothing is sent down again.  The
rounds over sources work alike; a source stands there with all of its tiles, each of
which sends to the tiles of the partner source that have its number, modulo the
sender's tile count.  At the ragged right edge the few tiles of the last node serve all
partners in turn.  A last pass over each tile's leaves folds every leaf with its proof.

Sources of any size only add tiles; a task holds a tile's leaves (digests, no texts), and
a round moves at most sixteen rows for each tile.

Defined results: a null field hashes as ``-``; a null source comes first, a null
``doc_id`` before others, and its row is never tampered with; rows that repeat a doc_id are
ordered by leaf, and rows equal in all fields are leaves each; a single leaf is its
source's subroot and a single source's subroot the root, with the proof of no siblings;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import lower_ascii, table, written
from ebbflow.llm.ranks import ranked

FANOUT = 16
#: Levels that a tile hashes by itself.
TILE_LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_ONE_IN = 5
HEX = 64


class Step(NamedTuple):
    """What stands before and after a node in its run."""

    before: bytes
    after: bytes


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def source_key(source: Column) -> Column:
    """A string that orders sources bytewise, null first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """key, doc_id, leaf, and told: the leaf of the row as tampered with, null where it is not."""
    held = [F.col(c) for c in FIELDS]
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER_ONE_IN)) == 0
    told = F.when(tampered, leaf_of([*held[:-1], lower_ascii(held[-1])]))
    return docs.select(source_key(F.col("source")).alias("key"), "doc_id", leaf_of(held).alias("leaf"), told.alias("told"))


def levels(count: int) -> int:
    """Levels above ``count`` nodes."""
    out = 0
    while count > 1:
        count, out = -(-count // FANOUT), out + 1
    return out


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def tile_levels(leaves: list[bytes], of_source: int, height: int) -> list[list[bytes]]:
    """The levels of a tile's subtree, leaves first; a tile among others rises its full height."""
    out = [leaves]
    for _ in range(min(height, levels(of_source))):
        last = out[-1]
        out.append([digest(b"".join(last[k : k + FANOUT])) for k in range(0, len(last), FANOUT)])
    return out


def tiles_of(docs: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """(source, tile, place, n, doc_id, leaf, told) of every row; (source, n, tiles) of every source, numbered in order."""
    leaves = written(leaves_of(docs), "leaves")
    placed = ranked(leaves, [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("told")], "ranked")
    sources = written(placed.groupBy("key").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "sources")
    held = FANOUT**height
    named = ranked(sources, [F.col("key")], "sources").withColumnRenamed("rank", "source")
    named = written(named.withColumn("tiles", F.ceil(F.col("n") / held)), "sources")
    at = F.col("rank") - F.col("first")
    rows = placed.join(named, "key").select(
        "source", at.alias("place"), (at / held).cast("long").alias("tile"), "tiles", "n", "doc_id", "leaf", "told"
    )
    return rows, named.select("source", "n", "tiles")


def tile_roots(rows: DataFrame, height: int) -> DataFrame:
    """source, tile, tiles, hash, upper (no steps yet) of every tile."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("place")
        leaves = [x.hex().encode() for x in tile.column("leaf").to_pylist()]
        top = tile_levels(leaves, tile.column("n")[0].as_py(), height)[-1][0].decode()
        return tile.slice(0, 1).select(["source", "tile", "tiles"]).append_column("hash", pa.array([top]))

    roots = rows.select("source", "tile", "tiles", "place", "n", "leaf").groupBy("source", "tile")
    roots = roots.applyInArrow(run, "source long, tile long, tiles long, hash string")
    return roots.withColumn("upper", F.expr("CAST(array() AS array<struct<before:string,after:string>>)"))


def partners(at: str, count: Column, turn: int) -> Column:
    """Those to which ``at``, of ``count`` in all, sends its root in a turn: itself, and in every other node of its group
    the one at its own place below the node, or several if its own node has fewer places."""
    width = FANOUT**turn
    return F.expr(
        f"""flatten(transform(
            sequence(({at} div {width * FANOUT}) * {FANOUT},
                     least(({at} div {width * FANOUT}) * {FANOUT} + {FANOUT - 1}, ({{0}} - 1) div {width})),
            j -> CASE WHEN j = {at} div {width} THEN array({at})
                      WHEN j * {width} + {at} % {width} < least((j + 1) * {width}, {{0}})
                      THEN sequence(j * {width} + {at} % {width}, least((j + 1) * {width}, {{0}}) - 1,
                                    least({width}, {{0}} - {at} div {width} * {width}))
                      ELSE cast(array() AS array<bigint>) END))""".replace("{0}", count)
    )


def swapped(sent: DataFrame, to: list[str], at: str, count: Column, turn: int) -> DataFrame:
    """What each partner holds after it received the roots of its group: the ancestor's digest and one step more."""
    got = sent.groupBy(*to).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "hash"))), lambda x: x["hash"]).alias("run"),
        F.first("own", ignorenulls=True).alias("own"),
    )
    width = FANOUT**turn
    slot = F.expr(f"cast({at} div {width} % {FANOUT} as int)")
    step = F.struct(
        F.array_join(F.slice("run", F.lit(1), slot), "").alias("before"),
        F.array_join(F.slice("run", slot + 2, F.lit(FANOUT)), "").alias("after"),
    )
    more = count > width
    return got.withColumn("count", count).select(
        *to,
        "own.*",
        F.when(more, F.sha2(F.array_join("run", ""), 256)).otherwise(F.element_at("run", 1)).alias("hash"),
        F.when(more, F.concat("own.upper", F.array(step))).otherwise(F.col("own.upper")).alias("steps"),
    )


def up_sources(nodes: DataFrame, most_tiles: int) -> DataFrame:
    """Rounds between the tiles of each source, after which each holds its subroot."""
    for turn in range(levels(most_tiles)):
        sent = nodes.withColumn("to", F.explode(partners("tile", "tiles", turn))).select(
            "source",
            "to",
            F.expr(f"tile div {FANOUT**turn}").alias("slot"),
            "hash",
            F.when(F.col("to") == F.col("tile"), F.struct("tiles", "upper")).alias("own"),
        )
        got = swapped(sent, ["source", "to"], "to", F.col("own.tiles"), turn)
        nodes = got.drop("upper").withColumnsRenamed({"to": "tile", "steps": "upper"})
    return nodes.withColumn("subroot", F.col("hash"))


def up_all(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rounds between sources, after which every tile holds the root and all steps above it."""
    n_sources = sources.count()
    theirs = sources.select(F.col("source").alias("to"), F.col("tiles").alias("to_tiles"))
    for turn in range(levels(n_sources)):
        sent = nodes.withColumn("to", F.explode(partners("source", str(n_sources), turn))).join(theirs, "to")
        numbers = F.expr("sequence(tile, to_tiles - 1, tiles)")
        sent = sent.where("tile < to_tiles").withColumn("to_tile", F.explode(numbers))
        own = (F.col("to") == F.col("source")) & (F.col("to_tile") == F.col("tile"))
        sent = sent.select(
            "to",
            "to_tile",
            F.expr(f"source div {FANOUT**turn}").alias("slot"),
            "hash",
            F.when(own, F.struct("tiles", "upper", "subroot")).alias("own"),
        )
        got = swapped(sent, ["to", "to_tile"], "to", F.lit(n_sources), turn)
        nodes = got.drop("upper").withColumnsRenamed({"to": "source", "to_tile": "tile", "steps": "upper"})
    return nodes.withColumnRenamed("hash", "root")


def local_steps(tree: list[list[bytes]], place: int) -> list[Step]:
    """The steps from a leaf of the tile to the tile's root."""
    out = []
    for nodes in tree[:-1]:
        first = place - place % FANOUT
        out.append(Step(b"".join(nodes[first:place]), b"".join(nodes[place + 1 : first + FANOUT])))
        place //= FANOUT
    return out


def folded(leaf: bytes, steps: list[Step]) -> bytes:
    for step in steps:
        leaf = digest(step.before + leaf + step.after)
    return leaf


def proofs(rows: DataFrame, nodes: DataFrame, height: int) -> DataFrame:
    """Every row with its proof, and the root that the row, tampered with or not, folds to."""

    def run(tile: pa.Table, top: pa.Table) -> pa.Table:
        tile = tile.sort_by("place")
        leaves = [x.hex().encode() for x in tile.column("leaf").to_pylist()]
        tree = tile_levels(leaves, tile.column("n")[0].as_py(), height)
        above = [Step(s["before"].encode(), s["after"].encode()) for s in top.column("upper")[0].as_py()]
        subroot, root = top.column("subroot")[0].as_py(), top.column("root")[0].as_py()
        proved, ends = [], []
        for k, told in enumerate(tile.column("told").to_pylist()):
            steps = [*local_steps(tree, k), *above]
            proved.append(sha256(b"".join(part for step in steps for part in step)).hexdigest())
            ends.append(folded(told.hex().encode() if told else leaves[k], steps).decode())
        n = len(leaves)
        return pa.table(
            {
                "doc_id": tile.column("doc_id"),
                "leaf": pa.array([x.decode() for x in leaves]),
                "subroot": pa.array([subroot] * n),
                "root": pa.array([root] * n),
                "proof_sha256": pa.array(proved),
                "folded_root": pa.array(ends),
                "verified": pa.array([x == root for x in ends]),
            }
        )

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    own = rows.select("source", "tile", "place", "n", "doc_id", "leaf", "told").groupBy("source", "tile")
    return own.cogroup(nodes.select("source", "tile", "upper", "subroot", "root").groupBy("source", "tile")).applyInArrow(
        run, schema
    )


def manifest(docs: DataFrame, height: int = TILE_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; a tile rises ``height`` levels."""
    docs = docs.select(F.col("doc_id").cast("long"), *FIELDS[1:])
    rows, sources = tiles_of(docs, height)
    most_tiles = sources.agg(F.max("tiles")).first()[0] or 0
    nodes = up_all(up_sources(tile_roots(rows, height), most_tiles), sources)
    return proofs(rows, nodes, height)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and which of them fail it once a fifth is tampered with."""
    return manifest(table(spark, sf_dir, "documents"))


def sql(height: int = 8) -> str:
    """DuckDB: the same, level by level, for up to 16**height leaves a source and as many sources."""

    def f(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"

    def tree(name: str, start: str) -> list[str]:
        """Tables {name}_k (g, p, n, h, and the run below as one string, empty for a lone node)."""
        out = [f"{name}_0 AS ({start})"]
        for k in range(height):
            out.append(
                f"{name}_{k + 1} AS (SELECT g, p // {FANOUT} AS p, (n + {FANOUT - 1}) // {FANOUT} AS n, "
                f"CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h, "
                f"CASE WHEN n = 1 THEN '' ELSE string_agg(h, '' ORDER BY p) END AS whole "
                f"FROM {name}_{k} GROUP BY g, p // {FANOUT}, n)"
            )
        return out

    def climb(name: str, rows: str, tag: str) -> list[str]:
        """Rows (g, p, proof, now) folded through the levels of a tree."""
        out = []
        for k in range(height):
            before, after = f"left(whole, (r.p % {FANOUT}) * {HEX})", f"substr(whole, (r.p % {FANOUT}) * {HEX} + {HEX + 1})"
            out.append(
                f"{tag}_{k} AS (SELECT r.* REPLACE (r.p // {FANOUT} AS p, "
                f"proof || {before} || {after} AS proof, "
                f"CASE WHEN whole = '' THEN now ELSE sha256({before} || now || {after}) END AS now) "
                f"FROM {rows} r JOIN {name}_{k + 1} t ON t.g = r.g AND t.p = r.p // {FANOUT})"
            )
            rows = f"{tag}_{k}"
        return out

    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    bytes_ = "list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT))"
    crc = f"xor(list_reduce({bytes_}, lambda c, b: {bits}), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(map(f, FIELDS[:-1]))
    return ",\n".join(
        [
            f"WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS key, sha256({head} || {f('text')}) AS leaf, "
            f"sha256({head} || {f(lowered)}) AS lower_leaf, {crc} % {TAMPER_ONE_IN} = 0 AS tampered FROM documents)",
            "k AS (SELECT key, row_number() OVER (ORDER BY key::BLOB) - 1 AS g FROM (SELECT DISTINCT key FROM d))",
            "l AS (SELECT d.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, "
            "count(*) OVER (PARTITION BY g) AS n FROM d JOIN k USING (key))",
            *tree("s", "SELECT g, p, n, leaf AS h FROM l"),
            f"subs AS (SELECT g, h FROM s_{height})",
            *tree("u", "SELECT 0 AS g, g AS p, count(*) OVER () AS n, h FROM subs"),
            "r AS (SELECT doc_id, leaf, g, p, g AS src, '' AS proof, "
            "CASE WHEN tampered THEN lower_leaf ELSE leaf END AS now FROM l)",
            *climb("s", "r", "a"),
            f"m AS (SELECT * REPLACE (0 AS g, src AS p) FROM a_{height - 1})",
            *climb("u", "m", "b"),
        ]
    ) + (
        f"\nSELECT doc_id, leaf, subs.h AS subroot, u_{height}.h AS root, sha256(proof) AS proof_sha256, "
        f"now AS folded_root, now = u_{height}.h AS verified FROM b_{height - 1} b JOIN subs ON subs.g = b.src, u_{height}"
    )


OP13_SQL = sql()
