"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct word shingles (of ``shingle`` words; with
fewer words the whole sequence is one shingle). Two collections of ``tables``
bands, each of ``rows`` minhashes, are computed; every pair of a band of the
first and a band of the second is a table key, so 2 * tables * rows minhashes
serve tables**2 tables. Documents that share a key are candidates, and a link
is confirmed on the full sets of shingles, words compared as words.

1. Documents with equal sets form a class; its smallest doc_id stands for it.
   A class of any size is one row from here on.
2. Each key has a centre: the representative whose keys hold most rows in all,
   so one in the middle of its group. Each representative is compared with the
   one centre that it shares most tables with.
3. The links found give components. A key that still holds several, with more
   than ``crowd`` rows outside the largest, has a pivot: the centre that most of
   its rows were compared with. Its rows are compared with the pivot too, one
   comparison a row and pivot, and those links join components as well.
4. In keys that still hold several components, rows outside the key's largest
   component are held against the rows of the other components, so no pair that
   shares a key stays unconfirmed unless the two are in one component already.
   Left out are pairs that cannot be similar: by their sets' sizes, or by what
   is known of both against the key's pivot (how many of its shingles each
   lacks, how many each has besides, and bitmaps of both: common bits bound from
   above what the two lack in common and have in common besides, so their
   intersection is bounded too), which loses nothing; or by their sketches (a
   byte of each minhash) agreeing in fewer places than 5.5 standard deviations
   below what the similarity gives, which loses a pair of just that similarity
   with probability 0.00000002. All of this is the join's condition, so heavily
   edited copies of one text never become pairs.
5. Components of all links, by alternating large-star and small-star steps.

A key held by a large group costs a row a member in 2 and 3, and in 4 only the
few rows that are no part of the group are held against it. Joins are plain
equi-joins, which AQE splits where a key is hot. With the default numbers a
pair of similarity 0.8 shares a key with probability 0.9993, of 0.85 with 0.99995.

Null texts and those without words have an empty set and are linked with
nothing. doc_id names a document: rows that repeat one are each returned, and
where it stands for a class they count as one node. Null doc_ids are returned
as their own components. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footgrid.llm.common import Scratch, slices, stored
from footgrid.shipping import map_arrow

#: Shingles hashed at once.
CHUNK = 400_000
#: Hashes a 64-bit word of a sketch holds, a byte each.
LANES = 8
#: Bits of a bitmap of what a row lacks of, or has besides, a centre's set.
BITS = 512
BIT_COLUMNS = [f"b{i}" for i in range(2 * BITS // 64)]


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    percent: int = 80
    tables: int = 11
    rows: int = 3
    #: Rows outside its largest component from which a key gets a pivot; decides what is compared first, not what is found.
    crowd: int = 16
    seed: int = 20240229

    @property
    def sketch(self) -> list[str]:
        """The columns of a sketch."""
        return [f"s{i}" for i in range(-(-2 * self.tables * self.rows // LANES))]


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], k: int) -> set:
    """The set itself, of tuples of words."""
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(k))))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def hashed_set(words: list[bytes], k: int, known: _WordHashes) -> np.ndarray:
    """The set's 64-bit hashes, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def bands(sets: list[np.ndarray], config: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Both collections' band values of each set (sets x 2 * tables) and the sketches (sets x words)."""
    rng = np.random.Generator(np.random.PCG64(config.seed))
    n = 2 * config.tables * config.rows
    xor, mul = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) | np.uint64(1)
    out, sketch = np.zeros((len(sets), 2 * config.tables), np.uint64), np.zeros((len(sets), len(config.sketch)), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):
        end, size = start, 0
        while end < len(full) and (end == start or size + len(sets[full[end]]) <= CHUNK):
            size += len(sets[full[end]])
            end += 1
        part = [sets[i] for i in full[start:end]]
        data, edges = np.concatenate(part), np.cumsum([0, *map(len, part)])[:-1]
        least = np.stack([np.minimum.reduceat(((data ^ xor[f]) * mul[f]) >> np.uint64(24), edges) for f in range(n)], axis=1)
        value = np.zeros((len(part), 2 * config.tables), np.uint64)
        for r in range(config.rows):
            value = (value ^ (value >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F) + least[:, r :: config.rows]
        out[full[start:end]] = value
        few = np.zeros((len(part), sketch.shape[1] * LANES), np.uint8)
        few[:, :n] = least & np.uint64(255)
        sketch[full[start:end]] = few.view(np.uint64)
        start = end
    return out, sketch


def signatures(documents: DataFrame, config: NearDup) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, first, second, sketch): digest of the set in two halves, bands of both collections."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            for part in slices(batch, 8 << 20):
                sets = [hashed_set(words_of(t), config.shingle, known) for t in part.column(1).to_pylist()]
                if len(known) > 100_000:
                    known.clear()
                digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
                value, sketch = (v.view(np.int64) for v in bands(sets, config))
                lists = [
                    pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(v).ravel()), v.shape[1]).cast(pa.list_(pa.int64()))
                    for v in (value[:, : config.tables], value[:, config.tables :], sketch)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), *lists],
                    ["doc_id", "n_shingles", "set_a", "set_b", "first", "second", "sketch"],
                )

    return map_arrow(rows, run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, first array<long>, second array<long>, sketch array<long>")


def table_keys(classes: DataFrame, config: NearDup) -> DataFrame:
    """(key, rep, n): one row for each table of each class."""
    pairs = F.flatten(F.transform("first", lambda a, i: F.transform("second", lambda b, j: F.xxhash64(i * config.tables + j, a, b))))
    return classes.select(F.explode(pairs).alias("key"), "rep", F.col("n_shingles").alias("n"))


def _bits(some: set) -> list[int]:
    """A bitmap of BITS bits over hashed shingles, as signed 64-bit words."""
    found = 0
    for x in some:
        found |= 1 << (xxhash.xxh3_64_intdigest(b" ".join(x)) % BITS)
    return np.frombuffer(found.to_bytes(BITS // 8, "little"), "<i8").tolist()


def compared(pairs: DataFrame, documents: DataFrame, config: NearDup) -> DataFrame:
    """(a, b, linked, centre_n, lacks, besides, bits) of every pair: whether their texts' sets are similar enough.

    Seen from b: the size of its set, how many of it a lacks, how many a has
    besides, and both bitmaps.
    """
    texts = documents.select("doc_id", "text")
    both = (
        pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
        .select("a", "b", "text_a", "text_b")
    )
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches):
        last, centre = None, set()  # the join leaves rows of one b together
        for batch in batches:
            for part in slices(batch, 8 << 20):
                found = []
                for text_a, text_b in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if text_b != last:
                        last, centre = text_b, shingles(words_of(text_b), config.shingle)
                    own = shingles(words_of(text_a), config.shingle)
                    lacks, besides = centre - own, own - centre
                    common = len(centre) - len(lacks)
                    linked = common > 0 and 100 * common >= config.percent * (len(own) + len(lacks))
                    found.append((linked, len(centre), len(lacks), len(besides), _bits(lacks) + _bits(besides)))
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                columns = [pa.array(x, k) for x, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["a", "b", "linked", "centre_n", "lacks", "besides", "bits"])

    return map_arrow(both, run, f"a {kind}, b {kind}, linked boolean, centre_n long, lacks long, besides long, bits array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected links (a, b); root: the component's least node."""
    scratch = Scratch(links.sparkSession, "links")
    edges = scratch.stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Done when every edge runs from a node of that one edge to a node that starts none.
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("starts")), F.struct(F.col("v").alias("node"), F.lit(0).alias("starts")))).alias("e"))
        roles = ends.groupBy("e.node").agg(F.sum("e.starts").alias("starts"), F.count("*").alias("n"))
        if roles.where("starts > 1 OR (starts = 1 AND n > 1)").isEmpty():
            found = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
            scratch.clear()
            return found
        every = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = every.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = scratch.stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())


def _possible(a: str, b: str, config: NearDup):
    """Whether two set sizes allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * config.percent) & (F.col(b) * 100 >= F.col(a) * config.percent)


def _alike(config: NearDup):
    """Whether the sketches x_s* and y_s* agree in enough places."""
    n = 2 * config.tables * config.rows
    p = config.percent / 100 + (1 - config.percent / 100) / 256
    most_apart = n - int(n * p - 5.5 * (n * p * (1 - p)) ** 0.5)
    apart = None
    for c in config.sketch:
        d = F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))
        for bits in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, bits))
        d = F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101).cast("long")))
        apart = d if apart is None else apart + d
    return apart <= most_apart


def known(comparisons: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, pivot, centre_n, lacks, besides, hidden_l, hidden_b, bitmaps) of each row compared with a centre, and of centres themselves.

    hidden: shingles that share a bit with another one of the same bitmap.
    """
    rows = comparisons.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), "centre_n", "lacks", "besides", "bits")
    none = F.array_repeat(F.lit(0).cast("long"), len(BIT_COLUMNS))
    zero = F.lit(0).cast("long")
    own = classes.join(rows.select(F.col("pivot").alias("rep")).distinct(), "rep", "left_semi").select(
        "rep", F.col("rep").alias("pivot"), F.col("n_shingles").alias("centre_n"), zero.alias("lacks"), zero.alias("besides"), none.alias("bits"))
    # Rows that repeat a doc_id can give one representative several comparisons: no bound holds for those.
    once = (
        rows.unionByName(own).groupBy("rep", "pivot").agg(F.count("*").alias("k"), F.first(F.struct("centre_n", "lacks", "besides", "bits")).alias("p"))
        .where("k = 1").select("rep", "pivot", "p.*")
    )
    half = len(BIT_COLUMNS) // 2

    def ones(first: int):
        parts = [F.bit_count(F.col("bits")[first + i]) for i in range(half)]
        return sum(parts[1:], parts[0])

    return once.select(
        "rep", "pivot", "centre_n", "lacks", "besides", (F.col("lacks") - ones(0)).alias("hidden_l"), (F.col("besides") - ones(half)).alias("hidden_b"),
        *[F.col("bits")[i].alias(c) for i, c in enumerate(BIT_COLUMNS)],
    )


KNOWN = ("centre_n", "lacks", "besides", "hidden_l", "hidden_b", *BIT_COLUMNS)


def _excluded(config: NearDup):
    """Whether what is known of x and y against one pivot excludes the similarity; the least cost comes first."""

    def common(columns, hidden):
        parts = [F.bit_count(F.col(f"x_{c}").bitwiseAND(F.col(f"y_{c}"))) for c in columns]
        return sum(parts[1:], parts[0]) + F.least(f"x_{hidden}", f"y_{hidden}")

    half = len(BIT_COLUMNS) // 2

    def apart(most):
        return 100 * most < config.percent * (F.col("x_n") + F.col("y_n") - most)

    # x and y hold at most what the one that lacks more has left of the pivot, and what the one that has less besides has.
    coarse = F.col("x_centre_n") - F.greatest("x_lacks", "y_lacks") + F.least("x_besides", "y_besides")
    fine = F.col("x_centre_n") - F.col("x_lacks") - F.col("y_lacks") + common(BIT_COLUMNS[:half], "hidden_l") + common(BIT_COLUMNS[half:], "hidden_b")
    return F.coalesce(apart(coarse) | apart(fine), F.lit(False))


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, rep, n, root, main, outside) of rows (key, rep, n) in keys that hold several components; main: the key's largest; outside: rows outside it."""
    roots = components(found)
    labelled = rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    parts = labelled.groupBy("key", "root").agg(F.count("*").alias("size"))
    keys = parts.groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts"), (F.sum("size") - F.max("size")).alias("outside")).where("parts > 1")
    return labelled.join(keys.select("key", "main", "outside"), "key")


def links(documents: DataFrame, classes: DataFrame, config: NearDup) -> DataFrame:
    """Confirmed links (a, b) between class representatives, enough to give every component."""
    scratch = Scratch(classes.sparkSession, "near-dup")
    keys = table_keys(classes, config)
    shared = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).where("low < high")
    # Rows of keys that several classes share, used in all rounds.
    held = scratch.stored(keys.join(shared.select("key", "size"), "key"))
    weights = held.groupBy("rep").agg(F.sum("size").alias("weight"))
    centres = held.join(weights, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("least"), "n")).alias("c")).select("key", (-F.col("c.least")).alias("centre"), F.col("c.n").alias("centre_n"))
    star = held.join(centres, "key").where("rep <> centre").where(_possible("n", "centre_n", config)).groupBy("rep", "centre").agg(F.count("*").alias("tables"))
    best = star.groupBy("rep").agg(F.max_by("centre", F.struct("tables", -F.col("centre"))).alias("centre"))
    first = scratch.stored(compared(best.select(F.col("rep").alias("a"), F.col("centre").alias("b")), documents, config))
    asked = first.select("a", "b")

    rest = scratch.stored(_open(held.select("key", "rep", "n"), first.where("linked")))
    of = asked.select(F.col("a").alias("rep"), F.col("b").alias("pivot"))
    crowded = rest.where(F.col("outside") > config.crowd)
    votes = crowded.join(of.unionByName(of.select(F.col("pivot").alias("rep"), "pivot").distinct()), "rep").groupBy("key", "pivot").agg(F.count("*").alias("votes"))
    chosen = scratch.stored(votes.groupBy("key").agg(F.max_by("pivot", F.struct("votes", -F.col("pivot"))).alias("pivot")))
    more = crowded.join(chosen, "key").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct().join(asked, ["a", "b"], "left_anti")
    second = scratch.stored(compared(more, documents, config))
    every = first.unionByName(second)

    facts = known(every, classes)
    last = _open(rest.select("key", "rep", "n"), every.where("linked")).join(chosen, "key", "left")
    sketches = classes.select("rep", *[F.col("sketch")[i].alias(c) for i, c in enumerate(config.sketch)])
    last = scratch.stored(last.join(facts, ["rep", "pivot"], "left").join(sketches, "rep"))

    def side(t):
        return [F.col("rep").alias(t), *[F.col(c).alias(f"{t}_{c}") for c in ("n", "root", *KNOWN, *config.sketch)]]

    pairs = (
        last.where("root <> main").select("key", *side("x")).join(last.select("key", *side("y"), "main"), "key")
        .where("x_root <> y_root AND (y_root = main OR x < y)")
        .where(_possible("x_n", "y_n", config) & _alike(config) & ~_excluded(config))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
        .join(_unordered(every), ["a", "b"], "left_anti")
    )
    third = compared(pairs, documents, config)
    linked = stored(every.unionByName(third).where("linked").select("a", "b").distinct(), "near-dup-links")
    scratch.clear()
    return linked


def apply(documents: DataFrame, config: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    found = stored(signatures(documents, config), "near-dup-signatures")
    usable = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    classes = stored(
        usable.groupBy(*same).agg(F.min(F.struct("doc_id", "first", "second", "sketch")).alias("r")).select(*same, F.col("r.doc_id").alias("rep"), "r.first", "r.second", "r.sketch"),
        "near-dup-classes",
    )
    roots = components(links(documents, classes.select("rep", "n_shingles", "first", "second", "sketch"), config))
    labelled = classes.select(*same, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("root"))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return (
        found.select("doc_id", *same).join(labelled, same, "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
