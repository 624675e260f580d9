"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are those of the ASCII-lower-cased text; a window is ``span`` consecutive
words of a benchmark item, or a whole item of fewer. Of each ``span - k + 1``
neighbouring k-gram hashes winnowing keeps the least (the leftmost of equal
ones), so every passage of ``span`` words shared by a document and an item
leaves the same fingerprint in both. Documents' fingerprints meet those of the
benchmark in an equi-join; each hit carries the few words around it and extends
to the windows that hold it, which an equi-join on their text confirms. So
every occurrence of every window is found, and nothing else.

Items of fewer than ``span`` words have no such guarantee: all document windows
of their lengths are compared by hash, then by text. That costs a pass over the
words for each such length, and nothing where there are none.

A bitmap of the benchmark's fingerprints, if they are few, drops most of a
document's before they leave its row; the join sees what is left.

Fingerprints and windows of the benchmark are broadcast only if counting them
first showed at most ``broadcast_rows`` and ``broadcast_bytes``; else they are
joined by shuffle. Nothing is grouped by passage: a passage in a third of all
documents is a broadcast row or a join's key that AQE can split. Hits carry a
window's number; the items that hold it are joined to the distinct windows of a
document, so a passage of many items is no long cell of every hit.

Null and empty texts have no words and no hits. Rows that repeat a doc_id are
documents of their own; repeated whole rows each get the same result. Items
with null text have no window; a null item_id is not listed. An empty benchmark
leaves all clean, an empty table of documents gives an empty result. Very long
texts are one row each, of which only fingerprints found in the benchmark leave
the row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footgrid.llm.common import LOWER, UPPER, stored

#: Bits of a word's place in packed fingerprints: a string of under 2**31 bytes has fewer than 2**30 words.
PLACE_BITS = 30


@dataclass(frozen=True)
class Decontaminate:
    span: int = 10
    k: int = 5
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 << 20
    #: Fingerprints of the benchmark up to which a bitmap of them screens documents' fingerprints within their row.
    bitmap_prints: int = 20_000
    #: Short items' windows up to which documents' windows are looked up in a literal set before they leave their row.
    literal_rows: int = 2_000


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_bit(table: Column, bit: Column) -> Column:
    """Whether the bit of a table of 64-bit words is set."""
    return F.getbit(table[F.shiftright(bit, 6).cast("int")], bit.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def words_of(text: Column) -> Column:
    """The text's words; null and empty texts have none."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    line = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.length(line) > 0, F.split(line, " ")).otherwise(F.array().cast("array<string>"))


def _gram(hashes: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[hashes[i + j] for j in range(k)])


def winnowed(words: Column, span: int, k: int) -> Column:
    """Packed (33-bit hash, place) of the kept k-grams; empty for fewer than ``span`` words."""
    width = span - k + 1

    def pack(hashes):
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - k),
            lambda i: F.shiftleft(F.shiftrightunsigned(_gram(hashes, i, k), 31), PLACE_BITS).bitwiseOR(i.cast("long")),
        )

    def keep(packed):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(packed) - (width - 1)), lambda i: F.array_min(F.slice(packed, i, width))))

    kept = let(let(F.transform(words, lambda w: F.xxhash64(w)), pack), keep)
    return F.when(F.size(words) >= span, kept).otherwise(F.array().cast("array<long>"))


def _joined(words: Column, start: Column, n) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def bitmap_of(prints: list[int], bits_a_print: int = 32) -> tuple[list[int], int]:
    """A bitmap over the top bits of fingerprints, as 64-bit words, and the number of those bits."""
    top = min(33, max(12, (bits_a_print * max(1, len(prints)) - 1).bit_length()))
    words = [0] * (1 << (top - 6))
    for fp in prints:
        bit = fp >> (33 - top)
        words[bit >> 6] |= 1 << (bit & 63)
    return [w - (1 << 64) if w >> 63 else w for w in words], top


def item_windows(benchmark: DataFrame, config: Decontaminate) -> DataFrame:
    """(window, m, item_id) of every distinct window and item that it occurs in."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    m = F.least(F.size("words"), F.lit(config.span))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - m))
    return (
        words.select("item_id", "words", m.alias("m"), starts.alias("start"))
        .select("item_id", _joined(F.col("words"), F.col("start"), F.col("m")).alias("window"), "m")
        .distinct()
    )


def item_fingerprints(benchmark: DataFrame, config: Decontaminate) -> DataFrame:
    words = benchmark.select(words_of(F.col("text")).alias("words"))
    kept = words.select(F.explode(winnowed(F.col("words"), config.span, config.k)).alias("x"))
    return kept.select(F.shiftright("x", PLACE_BITS).alias("fp")).distinct()



def hits(documents: DataFrame, benchmark: DataFrame, config: Decontaminate = Decontaminate()) -> DataFrame:
    """One row a document, with ``place`` null, and one for each occurrence of a window in it.

    Columns: doc_id, text_hash (to tell rows of one doc_id apart), n_words,
    place (of the window's first word), m (its words), window.
    """
    windows, prints = item_windows(benchmark, config).select("window", "m").distinct(), item_fingerprints(benchmark, config)
    sizes = windows.groupBy("m").agg(F.count("*").alias("count"), F.sum(F.octet_length("window")).alias("bytes")).collect()  # at most ``span`` rows
    n_windows, short = sum(r["count"] for r in sizes), sorted(r["m"] for r in sizes if r["m"] < config.span)
    n_short = sum(r["count"] for r in sizes if r["m"] < config.span)
    small = n_windows <= config.broadcast_rows and sum(r["bytes"] for r in sizes) <= config.broadcast_bytes
    prints, windows = (F.broadcast(prints), F.broadcast(windows)) if small else (prints, windows)
    screen = None
    if small:
        known = [r[0] for r in prints.limit(config.bitmap_prints + 1).collect()]  # bounded, and of the benchmark only
        if len(known) <= config.bitmap_prints:
            bitmap, top = bitmap_of(known)
            table = F.expr(f"array({','.join(f'{w}L' if w > -(1 << 63) else '-9223372036854775807L - 1L' for w in bitmap)})")
            screen = lambda x: let_bit(table, F.shiftright(x, 63 - top))
    words = documents.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("text_hash"), words_of(F.col("text")).alias("words"))
    place_mask = F.lit((1 << PLACE_BITS) - 1).cast("long")
    lead = config.span - config.k

    def around(words, x):
        place = x.bitwiseAND(place_mask).cast("int")
        start = F.greatest(place - lead, F.lit(0))
        return F.struct(
            F.shiftright(x, PLACE_BITS).alias("fp"), place.alias("place"), start.alias("first"), F.slice(words, start + 1, config.span + place - start).alias("near")
        )

    whole = F.struct(F.lit(None).cast("long").alias("fp"), F.lit(-1).alias("place"), F.lit(-1).alias("first"), F.lit(None).cast("array<string>").alias("near"))
    n_words = F.size("words").cast("long").alias("n_words")

    def candidates(words):
        kept = winnowed(words, config.span, config.k)
        kept = F.filter(kept, screen) if screen else kept
        return F.concat(F.array(whole), F.transform(kept, lambda x: around(words, x)))

    # The words are bound once; the explode emits small structs, never a document's words.
    found = words.select("doc_id", "text_hash", n_words, F.explode(let(F.col("words"), candidates)).alias("c")).select("doc_id", "text_hash", "n_words", "c.*")
    marked = prints.select("fp", F.lit(True).alias("known"))
    if small:
        kept = found.join(marked, "fp", "left").where("place < 0 OR known").drop("known")
    else:  # rows without a fingerprint stay out of the shuffle
        kept = found.where("place < 0").unionByName(found.where("place >= 0").join(marked, "fp", "left_semi"))
    starts = F.when(F.col("place") < 0, F.array(F.lit(-1))).otherwise(
        F.filter(F.sequence(F.col("first"), F.col("place")), lambda s: s + config.span <= F.col("n_words"))
    )
    tried = kept.select("doc_id", "text_hash", "n_words", "first", "near", F.explode(starts).alias("place")).select(
        "doc_id", "text_hash", "n_words", "place", F.when(F.col("place") >= 0, _joined(F.col("near"), F.col("place") - F.col("first"), config.span)).alias("window")
    )
    if short:
        tried = tried.unionByName(_short_candidates(words, windows, short, n_short, config))
    at = [F.col("doc_id"), F.col("text_hash"), F.col("n_words")]
    documents_rows = tried.where("place < 0").select(*at, F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("string").alias("window"))
    if small:
        return (
            tried.join(windows, "window", "left").where("place < 0 OR m IS NOT NULL")
            .select(*at, F.when(F.col("place") >= 0, F.col("place")).alias("place"), "m", "window")
        )
    return documents_rows.unionByName(tried.where("place >= 0").join(windows, "window").select(*at, "place", "m", "window"))


def _short_candidates(words: DataFrame, windows: DataFrame, lengths: list[int], n_short: int, config: Decontaminate) -> DataFrame:
    """Documents' windows of the short items' lengths; those in the literal set only, if it is small."""
    known = None
    if n_short <= config.literal_rows:
        known = [r[0] for r in windows.where(F.col("m") < config.span).select(F.xxhash64("window")).collect()]  # at most literal_rows

    def of_length(words, m):
        every = F.when(F.size(words) >= m, F.sequence(F.lit(0), F.size(words) - m)).otherwise(F.array().cast("array<int>"))
        if known is not None:
            every = F.filter(every, lambda i: F.xxhash64(_joined(words, i, m)).isin(known))
        return F.transform(every, lambda i: F.struct(i.alias("place"), _joined(words, i, m).alias("window")))

    def of(words):
        return F.concat(*[of_length(words, m) for m in lengths])

    n_words = F.size("words").cast("long").alias("n_words")
    return words.select("doc_id", "text_hash", n_words, F.explode(let(F.col("words"), of)).alias("c")).select("doc_id", "text_hash", "n_words", "c.*")


def covered(spans: Column) -> Column:
    """Words within (place, end) spans, sorted by place."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))

    def add(done, x):
        more = F.greatest(F.lit(0), x["end"] - F.greatest(x["place"], done["end"]))
        return F.struct(F.greatest(done["end"], x["end"]).alias("end"), (done["total"] + more).alias("total"))

    return F.aggregate(spans, start, add)["total"]


def apply(documents: DataFrame, benchmark: DataFrame, config: Decontaminate = Decontaminate()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, text_hash) of every row.

    spans: sorted (place, end) word ranges of the windows found, of which n_hit counts the words.
    """
    span = F.when(F.col("place").isNotNull(), F.struct("place", (F.col("place") + F.col("m")).alias("end")))
    at = ["doc_id", "text_hash", "n_words"]
    found = stored(hits(documents, benchmark, config), "decontaminate")  # a row a document and the hits: read twice
    items = item_windows(benchmark, config).select("window", F.col("item_id").cast("string").alias("item")).where("item IS NOT NULL").distinct()
    held = found.where("place IS NOT NULL").select(*at, "window").distinct().join(items, "window").select(*at, "item").distinct()
    rows = found.select(*at, span.alias("span"), F.when(F.col("place").isNull(), 1).alias("own"), F.lit(None).cast("string").alias("item"))
    rows = rows.unionByName(held.select(*at, F.lit(None).cast("struct<place:int,end:int>").alias("span"), F.lit(None).cast("int").alias("own"), "item"))
    return (
        rows.groupBy(*at)
        .agg(F.count("own").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("ids"))
        .withColumn("n_hit", covered(F.col("spans")))
        .select(
            "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"), "spans", "text_hash", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )
