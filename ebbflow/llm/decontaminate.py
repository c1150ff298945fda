"""Benchmark decontamination by template windows.

A word is its letters without the punctuation around it, in lower case.  In the template
form numbers, units and capitalised words (names) give way to typed placeholders, and
what stood there is kept as the window's slots.  Windows of ``WINDOW`` words of both forms
are hash-joined with those of the benchmark; the join's input is first screened by a bit
map of the benchmark's hashes, whose size is fixed whatever the benchmark holds.  A run of
matching windows counts if its slots are consistent: wherever the item repeats a value,
the document repeats the one it has instead.  So a question with other numbers or names
is caught, and a template filled at random is not.

An item shorter than ``WINDOW`` words is one window, of its own length.  Its words are
found anywhere; a single word, and the template of fewer than ``LEAST_WORDS`` words, only
in a document that holds nothing else.  Every template window with a placeholder and a
literal word is joined, however dense in numbers and names.  Lists of numbers are told
apart afterwards, by the literal words of the whole run: one that covers its item has
``WHOLE_LITERALS`` different ones, one of a part of it ``PART_LITERALS`` different ones or
a window with ``WINDOW_LITERALS``.  A verbatim (plain form) window has no placeholders.

Defined results: a null or empty text is clean; a null or empty item matches nothing;
repeated items give the same matches, each with its own id; repeated rows with one
``doc_id`` share its result, and rows without one are told apart by their text; only ``doc_id``, ``item_id`` and the texts are read; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import table, whole_text, with_row_id
from ebbflow.llm.rolling import Powers, U, prefixes, windows
from ebbflow.llm.screening import bit_map, passes

WINDOW = 13
LEAST_WORDS = 5
LEAST_VERBATIM = 2
WHOLE_LITERALS, PART_LITERALS, WINDOW_LITERALS = 2, 4, 8
REMEMBERED_WORDS = 400_000
PLAIN, TEMPLATE = 0, 1
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
KIND_HASHES = {k: xxhash.xxh64_intdigest(k) for k in (NUMBER, UNIT, NAME)}

EDGES = re.compile(r"^\W+|\W+$")
NUMERIC = re.compile(r"[+-]?\d[\d.,:/]*")
MEASURED = re.compile(r"[+-]?\d[\d.,]*[a-zµ°%]{1,3}\d?")
UNITS = frozenset(
    "mm cm dm m km inch inches foot feet ft yard yards yd mile miles mi mg g kg ton tons tonne tonnes oz lb lbs pound pounds"
    " ml cl dl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days"
    " week weeks month months year years dollar dollars usd eur euro euros cent cents gbp percent degree degrees hz khz mhz"
    " ghz w kw mw v a j kj cal kcal pa kpa bar kmh mph".split()
)
#: Words that begin sentences in capitals and are no names; first names (Will, May) are not among them.
FUNCTION_WORDS = frozenset(
    "a an the this that these those what which who whom whose when where why how if is are was were be been am do does did"
    " has have had can could would should shall must might not no yes and or but nor so yet for of in on at by to from with"
    " without into onto over under above below between among about after before during until while since because although"
    " though unless as than then there here it its he she they we you i his her hers their our your my me him them us each"
    " every all any some both either neither many much more most few several other another such only also however given"
    " suppose assume let find calculate compute determine solve evaluate show prove simplify write choose state explain"
    " estimate convert consider per".split()
)
WORDS = "form int, hash long, window string, slots array<string>, at int, of int"


def bare(raw: str) -> str:
    """The word without the punctuation around it."""
    return raw if raw.isalnum() else EDGES.sub("", raw)


def placeholder(word: str, low: str | None = None) -> str | None:
    """The type of a stripped word (``low``: its lower case) that can be re-parameterised."""
    low = word.lower() if low is None else low
    if not word.isalpha():  # letters alone hold no digit
        if NUMERIC.fullmatch(word):
            return NUMBER
        if MEASURED.fullmatch(low):
            return UNIT
    if low in UNITS:
        return UNIT
    if word[:1].isupper() and word[1:].islower() and low not in FUNCTION_WORDS:
        return NAME
    return None


class Forms(dict):
    """Raw word -> its place in arrays of plain hashes, template hashes and kinds; ``settle`` fills these for new words."""

    def __init__(self) -> None:
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes = np.zeros((2, REMEMBERED_WORDS // 4), U)
        self.literal = np.zeros(REMEMBERED_WORDS // 4, np.int8)  # 1 literal, 0 placeholder, -1 no word
        self.settled = 0
        self.new: tuple[list[int], list[int], list[int]] = ([], [], [])

    def __missing__(self, raw: str) -> int:
        place = self[raw] = len(self)
        word = bare(raw)
        low = word.lower()
        kind = placeholder(word, low)
        plain = xxhash.xxh64_intdigest(low)
        for held, value in zip(self.new, (plain, KIND_HASHES.get(kind, plain), (kind is None) if word else -1)):
            held.append(value)
        return place

    def settle(self) -> None:
        first, last = self.settled, len(self)
        if last > len(self.literal):
            more = max(last, 2 * len(self.literal)) - len(self.literal)
            self.hashes = np.pad(self.hashes, ((0, 0), (0, more)))
            self.literal = np.pad(self.literal, (0, more))
        if last > first:
            plain, template, literal = self.new
            self.hashes[0, first:last], self.hashes[1, first:last], self.literal[first:last] = plain, template, literal
            self.new, self.settled = ([], [], []), last


class Reader:
    """Windows of texts in both forms."""

    def __init__(self) -> None:
        self.forms, self.powers = Forms(), Powers()

    def rows(self, text: str, widths: list[int] | None, screen: np.ndarray | None) -> Iterator[tuple]:
        """Windows that the screen lets through, as in WORDS; of the text's own width if none is given."""
        if len(self.forms) >= REMEMBERED_WORDS:
            self.forms.reset()
        raw = text.split()
        places = np.fromiter(map(self.forms.__getitem__, raw), np.int64, len(raw))
        self.forms.settle()
        held = np.flatnonzero(self.forms.literal[places] >= 0)
        places = places[held]
        n = len(places)
        literals = np.concatenate([[0], np.cumsum(self.forms.literal[places], dtype=np.int64)])
        for form in (PLAIN, TEMPLATE):
            prefix = prefixes(self.forms.hashes[form, places], self.powers)
            for width in [min(n, WINDOW)] * (n > 0) if widths is None else widths:
                if n < width or width < (LEAST_VERBATIM, LEAST_WORDS)[form] and n != width:
                    continue
                found = windows(prefix, width, self.powers) + U(form * 64 + width)
                if form == TEMPLATE:
                    literal = literals[width:] - literals[:-width]
                    worth = (literal > 0) & (literal < width)  # without a slot it is the plain window
                else:
                    worth = np.ones(len(found), bool)
                if screen is not None:
                    worth &= passes(screen, found)
                of = int(worth.sum())
                for at in np.flatnonzero(worth).tolist():
                    own = [bare(raw[k]) for k in held[at : at + width]]
                    lower = [w.lower() for w in own]
                    kinds = [placeholder(w, low) if form == TEMPLATE else None for w, low in zip(own, lower)]
                    window = " ".join(k or low for k, low in zip(kinds, lower))
                    slots = [low for k, low in zip(kinds, lower) if k]
                    yield form, int(found[at].astype(np.int64)), window, slots, at, of


def windowed(texts: DataFrame, key: str, widths: list[int] | None = None, screen: bytes | None = None) -> DataFrame:
    """``key`` and the windows (WORDS) of every text; only those of ``widths`` that the screen lets through, if given."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32()]
    names = [key, *(f.split()[0] for f in WORDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        bits = np.frombuffer(screen, np.uint8) if screen is not None else None
        for batch in batches:
            rows = [
                (k, *row)
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for row in reader.rows(text.as_py() or "", widths, bits)
            ]
            if rows:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return texts.select(F.col(key).cast("long"), "text").mapInArrow(run, f"{key} long, {WORDS}")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, exact, n_windows: consistent runs, the best one of each document and item."""
    none = F.lit(None).cast("string")
    items = windowed(benchmark.select("item_id", whole_text().alias("text")), "item_id")
    words = items.select(F.size(F.split("window", " ")).alias("n")).distinct().collect()  # at most WINDOW numbers
    found = windowed(docs, "doc_id", sorted(r.n for r in words), bit_map(items.select("hash")))
    keys = ["form", "hash", "window"]
    items = items.withColumnsRenamed({"slots": "item_slots", "at": "item_at", "of": "item_of"})
    met = found.join(items, keys).withColumn("shift", F.col("at") - F.col("item_at"))
    run = ["doc_id", "item_id", "form", "shift"]
    literals = F.array_remove(F.array_remove(F.array_remove(F.split("window", " "), NUMBER), UNIT), NAME)
    parts = F.concat(
        F.transform(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda p: F.struct(p["i"], p["d"], none.alias("w"))),
        F.transform(F.array_distinct(literals), lambda w: F.struct(none.alias("i"), none.alias("d"), w.alias("w"))),
    )
    words_in = met.select(*run, "at", "item_of", F.size(literals).alias("literals"), F.explode(parts).alias("p"))
    runs = words_in.groupBy(*run).agg(
        F.count_distinct("at").alias("n_windows"),
        F.count_distinct("p.i").alias("values"),
        F.count_distinct("p.i", "p.d").alias("pairs"),
        F.count_distinct("p.w").alias("words"),
        F.max("literals").alias("literals"),
        F.max("item_of").alias("of"),
        F.coalesce(F.bool_and(F.col("p.i") == F.col("p.d")), F.lit(True)).alias("exact"),
    )
    whole = (F.col("n_windows") == F.col("of")) & (F.col("words") >= WHOLE_LITERALS)
    part = (F.col("words") >= PART_LITERALS) | (F.col("literals") >= WINDOW_LITERALS)
    return (
        runs.where((F.col("values") == F.col("pairs")) & ((F.col("form") == PLAIN) | whole | part))
        .groupBy("doc_id", "item_id")
        .agg(F.bool_or("exact").alias("exact"), F.max("n_windows").alias("n_windows"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document: doc_id, contaminated, item_ids, kind, n_windows."""
    rows = with_row_id(docs).select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
    hits = matches(rows.select(F.col("rid").alias("doc_id"), "text"), benchmark).groupBy(F.col("doc_id").alias("rid")).agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),  # at most the items of the benchmark
        F.bool_or("exact").alias("exact"),
        F.max("n_windows").alias("n_windows"),
    )
    kind = F.when(F.col("exact"), "verbatim").when(~F.col("exact"), "re-parameterised")
    return rows.select("rid", "doc_id").join(hits, "rid", "left").select(
        "doc_id",
        F.col("exact").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        kind.alias("kind"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, that hold no item of the benchmark."""
    rows = with_row_id(docs)
    texts = rows.select(F.col("rid").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
    hit = matches(texts, benchmark).select(F.col("doc_id").alias("rid")).distinct()
    return rows.join(hit, "rid", "left_anti").select("row.*")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, verbatim or re-parameterised."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
