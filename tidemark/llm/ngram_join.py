"""N-gram Jaccard join by vertical partitioning.

The shingles of the corpus (runs of SIZE words, or of another number) have one global order: estimated frequency first (from counts of words and of frequent
shingles over the whole corpus, in sketches of fixed size; any order gives the same result), then a hash. A shingle's key is its place in that order, so sorting keys sorts by
rarity. The order is cut into SLICES fragments. Documents of equal sets form a class and take part once, by a
representative. Candidates share a key among the rarest of both sets (prefix filter) and pass the length and position
filters; for each candidate pair the overlap is counted fragment by fragment, and the parts are summed.

More filters before any set is fetched: keys in no other prefix bound the overlap, and of two prefixes all such keys of the one
that ends first; of that one's keys, taken by how many prefixes hold them, one of the first must be shared; and the counts of
keys in BINS hash bins, compared bin by bin, bound the overlap as well. For components every set is first compared with one central set in each of its buckets. Then
only pairs in different components are left, as a pair within one can't change it: buckets of one component are left out
before the join, keys shared within a component alone count as keys in no other prefix, and a bucket's largest component
is joined with the rest alone. So no link between components is lost, and a large group of near copies costs about its
size, not its square. Keys with the same rows, as those of a passage that two texts share, are joined once, by the first of
them, which counts for all. Both steps are the same for buckets of any size; the rows of a bucket are dealt in blocks.

Keys are 63 bits: two different shingles of one pair of documents share a key with a chance of about n^2 / 2^56.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, free_name, id_and_text, keeps, pieces, raw_texts, spans_of, stored, tidy, word_lists
from .graph import connected_components

SIZE = 3
COUNTERS = 1 << 15
SHINGLE_COUNTERS, CHUNK = 1 << 20, 1 << 16
SLICES = 8
MEMO = 200_000
DEALT = 4096  # rows of a bucket in one block
BINS = 256
BITS = 1 << 21  # of the filter of wanted documents, whatever their number
NUMERATOR, DENOMINATOR = 90, 100  # two documents link when 100 * intersection >= 90 * union
_ODD = 0x9E3779B185EBCA87
_LAST = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()  # of a worker process, bounded by MEMO between texts
keeps(__name__, _hashes.clear)


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of every word of a text, in order."""
    if len(_hashes) > MEMO:
        _hashes.clear()
    parts = [np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)) for words in word_lists(raw)]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def _mixed(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every run of `size` words."""
    out = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        out += words[k : len(out) + k] * np.uint64(pow(_ODD, 2 * k + 1, 1 << 64))
    out ^= out >> np.uint64(32)
    out *= _LAST
    out ^= out >> np.uint64(29)
    return out


class Order:
    """The estimated frequencies behind the global order: words by hash, and frequent shingles by hash."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray, size: int = SIZE):
        self.words, self.shingles, self.size = words, shingles, size  # log2 of counts; 0 for shingles that aren't frequent

    def keys(self, words: np.ndarray) -> np.ndarray:
        """Distinct keys of a document, in the global order. Fewer words than a shingle has are one; no words, none.

        A frequent shingle ranks behind all others, by its own count; others by the counts of their words.
        """
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        size = min(self.size, n)
        common = self.words[(words & np.uint64(COUNTERS - 1)).astype(np.int64)]
        mixed, frequency = _mixed(words, size), np.zeros(n - size + 1, np.float32)
        for k in range(size):
            frequency += common[k : n - size + 1 + k]
        rank = np.minimum(frequency * (3 / size), 69).astype(np.uint64)
        own = self.shingles[(mixed & np.uint64(len(self.shingles) - 1)).astype(np.int64)]
        rank = np.where(own > 0, np.minimum(70 + 2 * own, 127), rank).astype(np.uint64)
        return np.unique((rank << np.uint64(56) | mixed >> np.uint64(8)).astype(np.int64))


def estimate_order(docs: DataFrame, size: int = SIZE) -> Order:
    """Counts of words, and of shingles, by hash over all whole texts, in counters of a fixed number. Every task passes on
    its counters, those of shingles as chunks of bytes (a task's count of 255 stands for more); they are summed chunk by
    chunk, and the logarithms, a few MB, come to the driver. A shingle is frequent if its counter is six standard errors
    above the mean, as others share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shingles = np.zeros(COUNTERS, np.int64), np.zeros(SHINGLE_COUNTERS, np.int32)
        for batch in batches:
            held, runs, n = [], [], 0
            for raw in [*raw_texts(batch.column(0)), None]:
                if raw is not None:
                    held.append(word_hashes(raw))
                    n += len(held[-1])
                    if len(held[-1]) >= size:
                        runs.append(_mixed(held[-1], size) & np.uint64(SHINGLE_COUNTERS - 1))
                if held and (n > 1 << 19 or raw is None):
                    words += np.bincount((np.concatenate(held) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                    if runs:
                        places, times = np.unique(np.concatenate(runs).astype(np.int64), return_counts=True)
                        shingles[places] += times.astype(np.int32)
                    held, runs, n = [], [], 0
        if words.any():
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["chunk", "counts"])
        for chunk, own in enumerate(np.minimum(shingles, 255).astype(np.uint8).reshape(-1, CHUNK)):
            if own.any():
                yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["chunk", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), np.int64 if chunk < 0 else np.uint8)
                sums[chunk] = own.astype(np.int64) if chunk not in sums else sums[chunk] + own
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.uint32 if c >= 0 else np.int64).tobytes() for c, x in sums.items()], pa.binary())], ["chunk", "counts"])

    parts = docs.select("text").mapInArrow(tidy(run), "chunk int, counts binary")
    rows = parts.repartition(SHINGLE_COUNTERS // CHUNK, "chunk").mapInArrow(tidy(summed), "chunk int, counts binary").toArrow()
    words, shingles = np.zeros(COUNTERS, np.int64), np.zeros((SHINGLE_COUNTERS // CHUNK, CHUNK), np.int64)
    for chunk, counts in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        (words if chunk < 0 else shingles[chunk])[:] = np.frombuffer(counts, np.int64 if chunk < 0 else np.uint32)
    mean = shingles.mean()
    frequent = np.where(shingles > mean + 6 * math.sqrt(mean) + 8, shingles - mean, 0).ravel()
    return Order(np.log2(1 + words).astype(np.float32), np.ceil(np.log2(1 + frequent)).astype(np.uint8), size)


def prefix_size(n: int, num: int = NUMERATOR, den: int = DENOMINATOR) -> int:
    """Keys of a set of n of which a set with at least num/den Jaccard similarity must hold one, among its own first."""
    return n - -(-num * n // den) + 1


def shingled(docs: DataFrame, order: Broadcast, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n, sig, bins, prefix) of every document: set size, digest of the set, keys in each hash bin, rarest
    keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                sets = [order.value.keys(word_hashes(raw)) for raw in raw_texts(part.column(1))]
                heads = [s[: prefix_size(len(s), num, den)] if len(s) else s for s in sets]
                lists = pa.ListArray.from_arrays(pa.array(spans_of(np.array([len(h) for h in heads], int)), pa.int32()), pa.array(np.concatenate(heads), pa.int64()))
                sigs = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                counts = np.concatenate([np.minimum(np.bincount(s & (BINS - 1), minlength=BINS), 32767).astype(np.int16) for s in sets])
                bins = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BINS, pa.int32()), pa.array(counts))
                yield pa.record_batch([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), sigs, bins, lists], ["doc_id", "text_hash", "n", "sig", "bins", "prefix"])

    rows = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    return rows.mapInArrow(tidy(run), "doc_id long, text_hash long, n long, sig binary, bins array<short>, prefix array<long>")


def text_hash() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _fragments(docs: DataFrame, wanted: DataFrame, order: Broadcast) -> DataFrame:
    """(rid, slice, keys) of the representatives in wanted (rid, doc_id, sig): the keys of each fragment of the order.

    A filter of BITS bits of the wanted ids goes to all workers, so only documents that pass it are read into sets.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("int")
    maps = wanted.groupBy(F.bitmap_bucket_number(place + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    packed = np.zeros(BITS // 8, np.uint8)
    for m in maps:  # a row for each 32,768 bits, numbered from 1, the lowest bit of a byte first
        packed[(m.part - 1) * 4096 : m.part * 4096] = np.frombuffer(m.bits, np.uint8)
    packed = docs.sparkSession.sparkContext.broadcast(packed)
    cuts = np.append(np.arange(SLICES, dtype=np.int64) * ((1 << 63) // SLICES), np.iinfo(np.int64).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.value, bitorder="little").astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column(2).to_numpy()]))
            for part in pieces(batch, 4 << 20):
                doc_id, sigs, piece, sizes, keys = [], [], [], [], []
                for d, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1)), strict=True):
                    own = order.value.keys(word_hashes(raw))
                    sig = xxhash.xxh3_128_digest(own.tobytes())
                    bounds = np.searchsorted(own, cuts)
                    for s in np.flatnonzero(np.diff(bounds)).tolist():
                        doc_id.append(d)
                        sigs.append(sig)
                        piece.append(s)
                        sizes.append(int(bounds[s + 1] - bounds[s]))
                    keys.append(own)
                flat = np.concatenate([np.zeros(0, np.int64), *keys])
                lists = pa.ListArray.from_arrays(pa.array(spans_of(np.array(sizes, int)), pa.int32()), pa.array(flat, pa.int64()))
                yield pa.record_batch([pa.array(doc_id, pa.int64()), pa.array(sigs, pa.binary()), pa.array(piece, pa.int32()), lists], ["doc_id", "sig", "slice", "keys"])

    rows = docs.filter("doc_id is not null").select("doc_id", "text", place.alias("k")).mapInArrow(tidy(run), "doc_id long, sig binary, slice int, keys array<long>")
    return rows.join(wanted, ["doc_id", "sig"]).select("rid", "slice", "keys").dropDuplicates(["rid", "slice"])


def _links(pairs: DataFrame, fragments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, na, nb) that link: overlaps of each fragment, summed."""
    parts = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    parts = parts.join(fragments.select(F.col("rid").alias("a"), "slice", F.col("keys").alias("ka")), ["a", "slice"])
    parts = parts.join(fragments.select(F.col("rid").alias("b"), "slice", F.col("keys").alias("kb")), ["b", "slice"])
    summed = parts.groupBy("a", "b", "na", "nb").agg(F.sum(F.size(F.array_intersect("ka", "kb")).cast("long")).alias("overlap"))
    return summed.filter(F.col("overlap") * den >= num * (F.col("na") + F.col("nb") - F.col("overlap")))


def _may_link(nx: Column, ny: Column, px: Column, py: Column, dx: Column, dy: Column, num: int, den: int) -> Column:
    """Length filter, and position filters: of the overlap, what stands before a shared key and from it on is a bound, and
    so is a set's size less its d keys before the shared key that are in no other prefix, hence in no partner's set."""
    most = F.least(F.least(px, py) + F.least(nx - px, ny - py), nx - dx, ny - dy)
    return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (most * (den + num) >= (nx + ny) * num)


class Join:
    """The steps of the join over one table of documents; everything large is a table in the shared folder, which goes as soon
    as its successor stands."""

    def __init__(self, docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, size: int = SIZE):
        self.num, self.den = num, den
        self.docs = id_and_text(docs)
        self.order = docs.sparkSession.sparkContext.broadcast(estimate_order(self.docs, size))  # of a fixed size
        self.rows = stored(shingled(self.docs, self.order, num, den).withColumn("rid", F.monotonically_increasing_id()), "shingled")
        linked = self.rows.filter("n > 0 and doc_id is not null")
        self.classes = stored(linked.groupBy("sig").agg(F.min(F.struct("doc_id", "rid")).alias("first")).select("sig", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("rep")), "classes")
        heads = self.rows.join(self.classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
        spread = heads.select("rid", F.posexplode("prefix").alias("pos", "key"))
        shared = spread.join(spread.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "key")
        ends = self.rows.select("rid", "n", F.size("prefix").alias("k"), F.try_element_at("prefix", F.lit(-1)).alias("last"))
        self.buckets = stored(self._placed(shared.join(ends, "rid")), "buckets")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """(key, rid, n, k, pos, last, …) with d, the keys of the prefix before pos that have no row, as no partner's prefix holds
        them, and u, all such keys."""
        own = Window.partitionBy("rid")
        rows = rows.withColumn("d", F.col("pos") - F.row_number().over(own.orderBy("pos")) + 1).withColumn("u", F.col("k") - F.count("*").over(own))
        return rows.withColumn("free", (F.col("n") - F.col("d")) * (self.den + self.num) >= F.col("n") * 2 * self.num)

    def _fit(self, raw: DataFrame) -> DataFrame:
        """Pairs that pass the filters. Of two prefixes the one that ends first lies within the stretch that both cover."""
        first = lambda a, b: (F.col(f"last_{a}") > F.col(f"last_{b}")) | ((F.col(f"n{a}") - F.col(f"u_{a}")) * (self.den + self.num) >= (F.col("nx") + F.col("ny")) * self.num)
        return raw.filter(_may_link(*map(F.col, ("nx", "ny", "px", "py", "dx", "dy")), self.num, self.den) & first("x", "y") & first("y", "x"))

    @staticmethod
    def _ends(pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb) with a < b from (x, nx, y, ny)."""
        low = F.col("x") < F.col("y")
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(low, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(low, F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()

    @staticmethod
    def _side(name: str, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("key", F.col("rid").alias(name), F.col("n").alias(f"n{name}"), F.col("pos").alias(f"p{name}"), F.col("d").alias(f"d{name}"), *(F.col(c).alias(f"{c}_{name}") for c in ("last", "u", *more)))

    @staticmethod
    def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two sides of a self-join by key: one dealt over blocks, the other in every block of its key."""
        held = rows.groupBy("key").agg(F.ceil(F.count("*") / DEALT).alias("blocks"))
        rows = rows.join(held, "key")
        return rows.withColumn("block", F.pmod(F.xxhash64("rid"), "blocks")), rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def _cross(self, rows: DataFrame) -> DataFrame:
        """Pairs of a bucket's rows that may link, in different components where rows have one. One of two sets is no larger than
        the other, so one is free."""
        parted = "comp" in rows.columns
        more = ("free", "rank", *(("comp", "top") if parted else ()))
        dealt, whole = self._blocks(rows)
        x = self._side("x", dealt.filter("not top" if parted else "free"), *more, "block").withColumnRenamed("block_x", "block")
        y = self._side("y", whole, *more, "block").withColumnRenamed("block_y", "block")
        once = "comp_x <> comp_y and (top_y or x < y) and (free_x or free_y)" if parted else "x <> y and (x < y or not free_y)"
        return self._fit(x.join(y, ["key", "block"]).filter(once).filter(self._early("x", "y") & self._early("y", "x")))

    def _early(self, a: str, b: str) -> Column:
        """Of two prefixes the one that ends first (a) lies within the stretch of the order that both cover, so its keys that are
        missing from the other prefix are missing from the other set, which lacks n - need of them at most. In whatever order
        they are taken, one of the first n - need + 1 is therefore shared: taken by rank, few rows hold it."""
        need = F.ceil((F.col("nx") + F.col("ny")) * self.num / (self.den + self.num))
        return (F.col(f"last_{a}") > F.col(f"last_{b}")) | (F.col(f"rank_{a}") <= F.col(f"n{a}") - need)

    @staticmethod
    def _digested(rows: DataFrame) -> DataFrame:
        """rows with the digests of their ids, which bit_xor joins into those of a bucket whatever the order."""
        return rows.withColumn("one", F.xxhash64("rid")).withColumn("two", F.xxhash64("rid", F.lit(1)))

    @staticmethod
    def _weighed(keys: DataFrame) -> DataFrame:
        """keys (key, one, two, …) with weight: for the first of those with the same rows how many they are, null for the others.
        The first in the global order stands first in each of the rows, so every filter passes there if it does at another."""
        firsts = keys.groupBy("one", "two").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
        return keys.drop("one", "two").join(firsts.select("key", "weight"), "key", "left")

    @staticmethod
    def _ranked(rows: DataFrame) -> DataFrame:
        """The rows that have a weight, with rank: the keys of the row's prefix that fewer rows hold, those that no other holds first."""
        before = Window.partitionBy("rid").orderBy("members", "key").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.filter("weight is not null")
        return rows.withColumn("rank", F.col("u") + F.coalesce(F.sum("weight").over(before), F.lit(0))).drop("members")

    def _whole(self) -> DataFrame:
        """Rows of all buckets, of those with the same rows the first with its weight."""
        keys = self._digested(self.buckets).groupBy("key").agg(F.count("*").alias("members"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
        return self._ranked(self.buckets.join(self._weighed(keys), "key"))

    def _apart(self, rows: DataFrame) -> DataFrame:
        """Rows of buckets with more than one component, with whether they are of the largest: those meet the others' only. Of
        buckets with the same rows the first stays, with its weight; what a row has before a key is counted before that."""
        sizes = self._digested(rows).groupBy("key", "comp").agg(F.count("*").alias("held"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two")).groupBy("key")
        largest = sizes.agg(F.max_by("comp", F.struct("held", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("held").alias("members"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
        largest = self._weighed(largest.filter("comps > 1").drop("comps"))
        rows = rows.join(largest, "key").withColumn("top", F.col("comp") == F.col("most")).drop("most", "d", "u", "free")
        return self._ranked(self._placed(rows))

    def _binned(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose overlap, bounded by the smaller count of each bin, may be enough."""
        ends = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
        bins = self.rows.select("rid", "bins").join(ends, "rid")
        both = pairs.join(bins.select(F.col("rid").alias("a"), F.col("bins").alias("x")), "a").join(bins.select(F.col("rid").alias("b"), F.col("bins").alias("y")), "b")
        most = F.aggregate(F.zip_with("x", "y", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, v: s + v)
        full = F.exists("x", lambda v: v == 32767)  # a count that didn't fit bounds nothing
        return both.filter(full | (most * (self.den + self.num) >= (F.col("na") + F.col("nb")) * self.num)).select("a", "b", "na", "nb")

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, overlap) of the pairs (a, b, na, nb) that link. Sets are read again for those in a pair, and go when done."""
        pairs = stored(self._binned(pairs), "pairs")
        rids = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
        wanted = self.classes.withColumnRenamed("rep", "rid").join(rids, "rid").select("rid", F.col("first_id").alias("doc_id"), "sig")
        fragments = stored(_fragments(self.docs, wanted, self.order), "fragments")
        found = stored(_links(pairs, fragments, self.num, self.den).select("a", "b", "overlap"), "links")
        discard(pairs, fragments)
        return found

    def _stars(self) -> DataFrame:
        """(a, b, na, nb): each row with its bucket's central row, that with the fewest keys that nobody else has before it."""
        best = F.struct(-F.col("d"), -F.col("pos"), F.xxhash64("rid"))
        central = self.buckets.groupBy("key").agg(F.max_by(F.struct("rid", "n", "pos", "d", "last", "u"), best).alias("c"))
        names = zip(("rid", "n", "pos", "d", "last", "u"), ("y", "ny", "py", "dy", "last_y", "u_y"), strict=True)
        central = central.select("key", *(F.col(f"c.{c}").alias(a) for c, a in names))
        return self._ends(self._fit(self._side("x", self.buckets).join(central, "key").filter("x <> y")))

    @staticmethod
    def _components(edges: DataFrame) -> DataFrame:
        found = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return found.select(F.col("node").alias("rid"), F.col("component").alias("comp"))

    def links(self, every: bool) -> tuple[DataFrame, DataFrame | None]:
        """(a, b, overlap) of linked representatives: every link, or enough of them to make the same components. With
        them the components (rid, comp), where they are known already."""
        if every:
            return self._linked(self._ends(self._cross(self._whole()))), None
        edges = self._linked(self._stars())
        found = stored(self._components(edges), "components")
        named = self.buckets.join(found, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        rows = stored(self._apart(named), "apart")
        more = self._linked(self._ends(self._cross(rows)))
        discard(rows, self.buckets)
        return (edges, found) if more.isEmpty() else (edges.unionByName(more), None)

    def components(self) -> DataFrame:
        """(rep, component) of the representatives that link with another."""
        edges, found = self.links(False)
        found = self._components(edges) if found is None else found
        return found.select(F.col("rid").alias("rep"), F.col("comp").alias("component"))

    def all_links(self) -> DataFrame:
        """(doc_a, doc_b, overlap) of every link of class representatives, by their first doc_id."""
        name = self.classes.select("rep", "first_id")
        found = self.links(True)[0].join(name.select(F.col("rep").alias("a"), F.col("first_id").alias("doc_a")), "a").join(name.select(F.col("rep").alias("b"), F.col("first_id").alias("doc_b")), "b")
        return found.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "overlap")


def jaccard_components(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id of an equal set) of every document.

    A text that is null or without words has no shingle and is its own component. A row without doc_id links with
    nothing and has a null component. Repeated rows are copies of each other. An empty table gives no rows.
    """
    join = Join(docs, num, den, size)
    first = join.classes.join(join.components(), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = first.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = first.join(least, "component").select("sig", F.col("first_id").alias("class_id"), "component_id")
    rows = join.rows.filter("n > 0 and doc_id is not null").join(named, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    alone = join.rows.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return rows.unionByName(alone)


def keep_one(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, size: int = SIZE) -> DataFrame:
    """docs with one row of each component: of those with the smallest doc_id, that of the least hash of its text, and of equal
    texts the one of the least hash over all columns. So a text that links with nothing stays whatever its doc_id, and each
    text without words stays once for each doc_id. Rows without doc_id all stay; an empty table stays empty. Columns of any
    name stay as they are."""
    join = Join(docs, num, den, size)
    rows = join.rows.filter("doc_id is not null").select("doc_id", "text_hash", "n", "sig")
    named = join.classes.join(join.components(), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    least = rows.filter("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    least = least.join(named, "sig").groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    key, text, held = (free_name(c, docs.columns) for c in ("doc_id_", "text_hash_", "held"))
    counts = rows.groupBy("doc_id", "text_hash").agg((F.count("*") > 1).alias(held), F.max("n").alias("n"))
    kept = counts.join(least.withColumn("chosen", F.lit(True)), ["doc_id", "text_hash"], "left").filter("n = 0 or chosen")
    kept = kept.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text), held)
    found = docs.join(kept, (F.col("doc_id").cast("long") == F.col(key)) & (text_hash() == F.col(text)))
    # Rows that share doc_id and text are reduced by an aggregation, of which each task passes on one row a key.
    once = found.filter(f"not {held}").select(*docs.columns)
    again = found.filter(held).groupBy(key, text).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(held)).select(f"{held}.*")
    return once.unionByName(again).unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def similar_pairs(docs: DataFrame, num: int = NUMERATOR, den: int = DENOMINATOR, size: int = SIZE) -> DataFrame:
    """The join itself: doc_a, doc_b, overlap of every linked pair of different sets, each named by its smallest doc_id."""
    return Join(docs, num, den, size).all_links()
