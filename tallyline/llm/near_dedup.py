"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

1. Every text becomes a sorted multiset of 32-bit hashes of its five-word shingles (words split at ASCII white space,
   lower-cased; a text of fewer words is one shingle) and a 128-bit key of its words. The table is stored.
2. A shingle weighs its frequency in the text times ``1 + ln(documents / max(df, least))``. Document frequencies above
   ``least`` are counted exactly over all documents; there are at most ``TABLE`` such shingles, since ``least`` is the
   number of (text, shingle) pairs over ``TABLE`` (1 at least): at 300 shingles a text, 0.05 % of the texts. Below it the
   IDF saturates. Up to some 2,000 texts of 300 shingles every frequency is exact.
3. Consistent weighted sampling: for each sample k, a shingle's gamma variates r and c and its uniform beta come from its
   hash; with ``t = floor(ln w / r + beta)`` the sample is the (shingle, t) of the least ``c / exp(r (t - beta) + r)``.
   Two texts agree on a sample with the probability of their weighted Jaccard similarity.
4. Samples are banded. Texts with equal keys are one representative; representatives that share a band's bucket are
   candidates. A bucket of at most ``SMALL`` is compared in full. In a larger one all are compared with its most
   central text. After each round all links so far are joined into classes, and only pairs of different classes
   are tried further: those that share a finer bucket (of three further samples). Small finer buckets are compared in
   full; in larger ones a text meets the most central one, then growing parts of the bucket until it has met every
   member that is not in its class, but for those whose total weights differ too much or that agree on too few of 1,024
   further samples. So texts of one class are not paired again, whatever hubs joined them; other members of a large
   bucket go unpaired only if they agree on none of nine triples of samples, which at the threshold happens to
   0.2 % of pairs, for each of the bands.
5. Candidates are verified by the exact weighted Jaccard similarity of the stored multisets; verified links
   are joined into classes by label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import attach, fresh, lean, materialize, remove, slices, small_batches, sweep, texts_of
from tallyline.llm.encoders import _Cache

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 4
TABLE = 600_000
SMALL = 12
#: Of 64 parts of a bucket by hash, the hubs of the rounds after the central text's: 4, then all others. Classes are joined, and all
#: members labelled anew, between rounds; a sixteenth of a class is enough to join nearly all of it.
HUB_PARTS = (4, 64)
#: Samples j, j + TRIPLES and j + 2 * TRIPLES form the key j of a finer bucket; those of the bucket's own band are left out.
TRIPLES = BANDS * ROWS // 3
#: Of the 40 samples, so many must agree before a pair of a large bucket is verified: four standard deviations under the
#: mean at the threshold, so that 1 in 10,000 pairs at the threshold is missed here.
AGREEING = 22
#: In finer buckets, two bits of each of so many further samples, and how many must agree: at the threshold 85 % do, so the
#: bound is four standard deviations lower: 1 in 30,000 pairs at the threshold is missed here, hardly any above it.
FURTHER, FURTHER_AGREEING = 1024, 824
BROADCAST_IDS = 1_000_000
CHUNK_SHINGLES = 250_000
#: Counters of all shingles, and the rows that carry them.
SLOTS, SLOT_BLOCKS = 1 << 22, 64
_U = np.uint64
#: Odd multipliers of a multiplicative hash, by a fixed generator.
_MULTIPLIERS = np.random.default_rng(20200101).integers(1 << 62, 1 << 63, 4096, dtype=np.uint64) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middle of 65,536 equal steps (its distribution is 1 - (1 + x) exp(-x))."""
    p = (np.arange(65536) + 0.5) / 65536
    x = np.linspace(0, 30, 300_001)
    return np.interp(p, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    def __init__(self, samples: int, first: int = 0):
        g = _gamma_quantiles()
        self.r, self.log_c = g.astype(np.float32), np.log(g).astype(np.float32)
        self.samples, self.first = samples, first

    def __call__(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of sample hashes (uint64) for each text; text i has ``shingles[starts[i]:starts[i + 1]]``, never empty."""
        base = _mix(shingles.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
        log_w = np.log(weights).astype(np.float32)
        index = np.arange(len(shingles), dtype=np.int64)
        out = np.empty((len(starts), self.samples), np.uint64)
        for k in range(self.samples):
            z = base * _MULTIPLIERS[self.first + k]
            r = self.r[z >> _U(48)]
            beta = ((z >> _U(32)) & _U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w / r + beta)
            a = self.log_c[(z >> _U(16)) & _U(0xFFFF)] - r * (t - beta) - r
            bits = a.view(np.int32)
            order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) << 32 | index
            at = np.minimum.reduceat(order, starts) & 0xFFFFFFFF
            out[:, k] = _mix(base[at] + t[at].astype(np.int64).view(np.uint64) * _U(0xD6E8FEB86659FD93))
        return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each text and band."""
    out = np.empty((len(samples), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(samples), b + 1, np.uint64)
        for j in range(rows):
            key = _mix(key * _U(0x2545F4914F6CDD1D) + samples[:, b * rows + j])
        out[:, b] = key
    return out.view(np.int64)


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words = words
        self.cache = _Cache(xxhash.xxh64_intdigest, 50_000)

    def __call__(self, text: str) -> tuple[int, int, np.ndarray]:
        """Two halves of the content key, and the sorted multiset of shingle hashes."""
        words = text.lower().encode("utf-8", "surrogatepass").split()
        key = xxhash.xxh3_128_digest(b" ".join(words))
        halves = np.frombuffer(key, np.int64)
        if not words:
            return int(halves[0]), int(halves[1]), np.empty(0, np.int32)
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - self.words + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(self.words, len(words))):
            total = (total + h[j : j + n]) * _U(0x9E3779B97F4A7C15)
            total ^= total >> _U(29)
        found = (_mix(total) >> _U(32)).astype(np.uint32).view(np.int32)
        found.sort()
        return int(halves[0]), int(halves[1]), found


def shingle_table(docs: DataFrame, id_col: str, text_col: str, rid: Column | None = None) -> DataFrame:
    rows = docs.select((F.monotonically_increasing_id() if rid is None else rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in slices(batch, 2):
                k1, k2, found = zip(*map(shingler, texts_of(part, 2)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], ["rid", "doc_id", "k1", "k2", "shingles"])

    return rows.mapInArrow(lean(run), "rid long, doc_id long, k1 long, k2 long, shingles array<int>")


def _parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` values in a list column (or one row): first and last row, values, offsets."""
    lists = batch.column(column)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _first_in_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each value of sorted multisets is the first of its kind in its text."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    starts = offsets[:-1]
    new[starts[starts < len(values)]] = True
    return new


def _slot(values: np.ndarray) -> np.ndarray:
    return _mix(values.view(np.uint32).astype(np.uint64) + _U(0x6A09E667F3BCC909)) & _U(SLOTS - 1)


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    """The sum of the counters (binary, little-endian unsigned) of each key; sorted rows are added one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_narrow(total)], pa.binary())], ["block", "counts"])
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(counts, f"<u{len(counts) * SLOT_BLOCKS // SLOTS}").astype(np.uint64)
                if block == at:
                    total += counts
                    continue
                if total is not None:
                    yield done()
                at, total = block, counts
        if total is not None:
            yield done()

    return rows.repartition(*keys).sortWithinPartitions(*keys).select("block", "counts").mapInArrow(lean(run), "block int, counts binary")


def _narrow(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def frequent_shingles(table: DataFrame, least: float) -> dict[int, int]:
    """Exact document frequencies of the shingles in more than ``least`` documents.

    Shingles hash into ``SLOTS`` counters, which are added up over all documents; a slot's sum is an upper bound for each of its
    shingles, so only those in slots above ``least`` are counted by themselves. The counters' size doesn't depend on the
    corpus; with ``least`` = total / TABLE an average slot has a seventh of ``least``.
    """
    size = SLOTS // SLOT_BLOCKS

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Each text's different shingles, for many texts at a time."""
        for batch in batches:
            for _, _, values, offsets in _parts(batch, 0, CHUNK_SHINGLES):
                yield values[_first_in_text(values, offsets)]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint32)
        for values in runs(batches):
            at, n = np.unique(_slot(values), return_counts=True)
            total[at] += n.astype(np.uint32)
        salt = pa.array([TaskContext.get().partitionId()], pa.int32())
        for block in range(SLOT_BLOCKS):
            counts = total[block * size : (block + 1) * size]
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_narrow(counts)], pa.binary()), salt], ["block", "counts", "task"])

    lists = table.select("shingles")
    # Two steps, so that a task adds up the counters of a few hundred others.
    parts = lists.mapInArrow(lean(slots), "block int, counts binary, task int").select("block", "counts", F.floor(F.col("task") / 64).alias("part"))
    high = np.zeros(SLOTS, bool)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(c, f"<u{len(c) // size}") > least).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["block", "bits"])

    for r in _added(_added(parts, "block", "part"), "block").mapInArrow(lean(above), "block int, bits binary").collect():
        high[r["block"] * size : (r["block"] + 1) * size] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    if not high.any():
        return {}
    packed = np.packbits(high)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        for values in runs(batches):
            found, n = np.unique(values[wanted[_slot(values)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["shingle", "df"])

    counts = lists.mapInArrow(lean(count), "shingle int, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
    return {r["shingle"]: r["df"] for r in counts.where(F.col("df") > least).collect()}


class Weights:
    """TF-IDF weights of sorted multisets."""

    def __init__(self, frequent: dict[int, int], documents: int, least: float):
        self.keys = np.array(sorted(frequent), np.int32)
        self.rare = 1 + np.log(max(documents, 1) / max(least, 1))
        self.common = (1 + np.log(documents / np.array([frequent[int(k)] for k in self.keys], float))).astype(np.float32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.rare)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
            hit = self.keys[at] == shingles
            out[hit] = self.common[at[hit]]
        return out

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two sorted multisets."""
        (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        if not len(ua) or not len(ub):
            return float(len(ua) == len(ub))
        wa, wb = self(ua), self(ub)
        at = np.minimum(np.searchsorted(ub, ua), len(ub) - 1)
        hit = ub[at] == ua
        shared = float((wa[hit] * np.minimum(ca[hit], cb[at[hit]])).sum())
        return shared / (float((wa * ca).sum() + (wb * cb).sum()) - shared)


def triple_keys(samples: np.ndarray) -> np.ndarray:
    n = samples.shape[1] // 3
    return _mix(_mix(samples[:, :n] + samples[:, n : 2 * n] * _U(3)) + samples[:, 2 * n : 3 * n]).view(np.int64)


def signature_table(table: DataFrame, weights: Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(rid, buckets, triples, weight, sketch) of every text that has shingles; the sketch is a byte of each sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        for batch in batches:
            for i, j, values, offsets in _parts(batch, 1, 16384):
                if not len(values):
                    continue
                some = np.flatnonzero(np.diff(offsets))
                new = np.flatnonzero(_first_in_text(values, offsets))
                tf = np.diff(np.append(new, len(values)))
                shingles = values[new]
                starts = np.searchsorted(new, offsets[some])
                each = weights(shingles) * tf
                samples = sampler(shingles.view(np.uint32), each, starts)
                sketch = (samples >> _U(40)).astype(np.uint8).view(np.int8)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.reshape(-1)))
                    for k in (band_keys(samples, bands, rows), triple_keys(samples), sketch)
                ]
                rids, total = pa.array(batch.column(0).to_numpy()[i:j][some]), pa.array(np.add.reduceat(each, starts))
                yield pa.RecordBatch.from_arrays([rids, *lists, total], ["rid", "buckets", "triples", "sketch", "weight"])

    return table.select("rid", "shingles").mapInArrow(lean(run), "rid long, buckets array<long>, triples array<long>, sketch array<tinyint>, weight double")


def bit_sketches(table: DataFrame, rids: DataFrame, weights: Weights) -> DataFrame:
    """(rid, bits): two bits of each of ``FURTHER`` further samples, for the texts of large buckets alone."""
    few = rids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = table.select("rid", "shingles").join(F.broadcast(rids) if few else rids, "rid", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(FURTHER, BANDS * ROWS)
        for batch in batches:
            for i, j, values, offsets in _parts(batch, 1, 16384):
                new = np.flatnonzero(_first_in_text(values, offsets))
                tf = np.diff(np.append(new, len(values)))
                shingles = values[new]
                samples = sampler(shingles.view(np.uint32), weights(shingles) * tf, np.searchsorted(new, offsets[:-1])) >> _U(62)
                packed = np.zeros((j - i, FURTHER // 32), np.uint64)
                for k in range(FURTHER):
                    packed[:, k // 32] |= samples[:, k] << _U(2 * (k % 32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * packed.shape[1]), pa.array(packed.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["rid", "bits"])

    return chosen.mapInArrow(lean(run), "rid long, bits array<long>")


#: The (band, triple) of every finer bucket, as ``band * TRIPLES + triple``: the triple's samples lie outside the band.
_PLACES = [b * TRIPLES + j for b in range(BANDS) for j in range(TRIPLES) if b not in {(j + i * TRIPLES) // ROWS for i in range(3)}]


def _first_met() -> Column:
    """Whether a pair meets in the first of the finer buckets that it shares.

    Of two texts of different classes every shared finer bucket either stays until their classes are one, or is small
    and was compared in full, so that one bucket is enough.
    """
    same = lambda kind, i: F.get(F.col(kind), i) == F.get(F.col(f"h_{kind}"), i)
    places = F.array(*map(F.lit, _PLACES))
    return ~F.exists(places, lambda p: (p < F.col("at")) & same("buckets", F.floor(p / TRIPLES).cast("int")) & same("triples", p % TRIPLES))


def _bits_agree(a: str, b: str) -> Column:
    """How many of the two-bit samples of two texts are equal."""
    low, out = F.lit(0x5555555555555555), F.lit(FURTHER)
    for k in range(FURTHER // 32):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        out = out - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low))
    return out


def verify(pairs: DataFrame, table: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of row ids that reach the threshold. The texts move by their multisets."""
    needed = materialize(pairs.select(F.col("a").alias("rid")).distinct().unionByName(pairs.select(F.col("b").alias("rid")).distinct()).distinct(), "needed")
    few = needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sets = table.select("rid", "shingles").join(F.broadcast(needed) if few else needed, "rid", "left_semi")
    of_b = pairs.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = of_b.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xo, xv, yo, yv = x.offsets.to_numpy(), x.values.to_numpy(), y.offsets.to_numpy(), y.values.to_numpy()
            s = np.array([weights.similarity(xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]) for i in range(batch.num_rows)])
            keep = np.flatnonzero(s >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(s[keep])], ["a", "b", "similarity"])

    return both.mapInArrow(lean(run), "a long, b long, similarity double")


def links(members: DataFrame, signed: DataFrame, table: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a < b) among the members (bucket, band, rid) of buckets; ``signed`` is the signature table."""
    return _search(members, signed, table, weights, threshold).edges


def _search(members: DataFrame, signed: DataFrame, table: DataFrame, weights: Weights, threshold: float) -> _Search:
    """The links of all buckets, and the classes that they make."""
    spark = table.sparkSession
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    active = attach(members, ["bucket"], materialize(buckets, "buckets"), "n", F.col("rid")).where(F.col("n").isNotNull())
    active = materialize(active, "active")
    search = _Search(table, weights, threshold)
    few = active.where(F.col("n") <= SMALL).select("bucket", "rid", F.col("rid").alias("label"))
    search.try_pairs(_all_pairs(few))
    # In a large bucket, a text in many and large buckets lies in the middle of its likes: it is the first hub.
    central = active.groupBy("rid").agg(F.sum("n").alias("central"))
    info = signed.select("rid", "weight", "sketch")
    pool = materialize(active.where(F.col("n") > SMALL).join(central, "rid").join(info, "rid").select("bucket", "band", "rid", "central", "weight", "sketch"), "pool")
    if not pool.limit(1).count():
        return search
    hubs = materialize(_central(pool), "central")
    search.meet_hubs(hubs, pool, fine=False)
    # What is not in the hub's class shares less with it; finer buckets within the bucket part such texts further.
    waiting = search.apart(pool.join(hubs.select("bucket", F.col("rid").alias("home")), "bucket"))
    remove(spark, active, pool, hubs)
    apart = F.filter(
        F.sequence(F.lit(0), F.lit(TRIPLES - 1)),
        lambda j: (F.floor(j / ROWS) != F.col("band")) & (F.floor((j + TRIPLES) / ROWS) != F.col("band")) & (F.floor((j + 2 * TRIPLES) / ROWS) != F.col("band")),
    )
    keys = F.transform(apart, lambda j: F.struct((F.col("band") * TRIPLES + j).cast("int").alias("at"), F.xxhash64(F.col("bucket"), j, F.element_at("triples", j + 1)).alias("bucket")))
    finer = waiting.join(signed.select("rid", "triples"), "rid").select(F.explode(keys).alias("k"), "rid", "central", "weight", "label")
    finer = finer.select("k.bucket", "k.at", "rid", "central", "weight", "label")
    sizes = finer.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("one"))
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "label", "one"))["one"].alias("home"))
    sizes = materialize(sizes.where(F.col("classes") > 1).drop("classes"), "buckets")
    finer = materialize(attach(finer, ["bucket"], sizes, "n", F.col("rid")).where(F.col("n").isNotNull()), "finer")
    search.try_pairs(_all_pairs(finer.where(F.col("n") <= SMALL)))
    large = finer.where(F.col("n") > SMALL).select("bucket", "at", "rid", "central", "weight", "home")
    bits = bit_sketches(table, materialize(large.select("rid").distinct(), "large"), weights)
    part = F.pmod(F.xxhash64("rid"), F.lit(HUB_PARTS[-1])).alias("part")
    bits = materialize(bits.join(signed.select("rid", "buckets", "triples"), "rid"), "bits")
    large = materialize(large.join(bits, "rid").select("bucket", "at", "rid", "central", "weight", F.col("bits").alias("sketch"), "home", part, "buckets", "triples"), "large")
    remove(spark, waiting, finer)
    left = search.apart(large)
    remove(spark, large)
    search.meet_hubs(_central(left), left.where("open"))
    for low, high in zip((0, *HUB_PARTS), HUB_PARTS):
        left = search.apart(left)
        if not left.limit(1).count():
            break
        # Pairs of open texts were tried, or in one class, when the earlier of them was a hub: what is open once was open before.
        first = ~F.col("h_open") | (F.col("part") >= high) | ((F.col("part") >= low) & (F.col("rid") < F.col("hub")))
        search.meet_hubs(left.where((F.col("part") >= low) & (F.col("part") < high)), left.where("open"), first)
    remove(spark, left)
    return search


def _central(pool: DataFrame) -> DataFrame:
    """The most central text of each bucket, with the pool's columns."""
    rest = [c for c in pool.columns if c not in ("bucket", "central", "rid")]
    best = pool.groupBy("bucket").agg(F.max(F.struct("central", "rid", *rest)).alias("h"))
    return best.select("bucket", *(F.col(f"h.{c}").alias(c) for c in ("central", "rid", *rest)))


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs a < b of different labels within buckets of at most SMALL members."""
    left = members.select("bucket", F.col("rid").alias("a"), F.col("label").alias("l"))
    right = members.select("bucket", F.col("rid").alias("b"), F.col("label").alias("m"))
    return left.join(right, "bucket").where((F.col("a") < F.col("b")) & (F.col("l") != F.col("m"))).select("a", "b")


class _Search:
    """Pairs tried and links found so far, and the classes (rid, label) of what they link."""

    def __init__(self, table: DataFrame, weights: Weights, threshold: float):
        self.table, self.weights, self.threshold, self.tried, self.edges, self.labels = table, weights, threshold, None, None, None
        #: What ``apart`` returned since the classes last changed.
        self.settled: DataFrame | None = None

    def try_pairs(self, pairs: DataFrame) -> None:
        pairs = pairs.distinct()
        pairs = materialize(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"), "pairs")
        if self.tried is not None and not pairs.limit(1).count():
            return
        found = materialize(verify(pairs, self.table, self.weights, self.threshold), "links")
        # Stored tables, one for each of the few rounds.
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        self.edges = found if self.edges is None else self.edges.unionByName(found)
        self.join_classes(found)
        sweep(pairs.sparkSession)

    def join_classes(self, found: DataFrame) -> None:
        """The classes after new links: only classes that a link joins are looked at."""
        if self.labels is None:
            self.labels = components(found)
            return
        labels = self.labels
        ends = found.select("a", "b")
        for end in ("a", "b"):
            ends = ends.join(labels.select(F.col("rid").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
        between = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()
        between = materialize(between, "between")
        if between.limit(1).count():
            merged = components(between)
            moved = labels.join(merged.select(F.col("rid").alias("label"), F.col("label").alias("least")), "label", "left")
            new = merged.join(labels, "rid", "left_anti").select("rid", "label")
            self.labels = materialize(moved.select("rid", F.coalesce("least", "label").alias("label")).unionByName(new), "classes")
            self.settled = None
            remove(found.sparkSession, merged, labels)
        remove(found.sparkSession, between)

    def apart(self, members: DataFrame) -> DataFrame:
        """The members of buckets that hold texts of different classes, by the links so far.

        ``label`` is a text's class; a text is ``open`` while it is not in the class of the text ``home``, a member for each bucket.
        """
        if self.settled is not None and members is self.settled:
            return members
        labels, spark = self.labels, self.table.sparkSession
        plain = members.select(*(c for c in members.columns if c not in ("label", "open")))
        plain = materialize(plain.join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "labelled")
        home = F.max(F.when(F.col("rid") == F.col("home"), F.col("label"))).alias("home_label")
        mixed = plain.groupBy("bucket").agg(home, F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi"))
        open_ = plain.join(mixed.select("bucket", "home_label"), "bucket").withColumn("open", F.col("label") != F.col("home_label"))
        self.settled = materialize(open_.drop("home_label"), "apart")
        remove(spark, plain)
        return self.settled

    def meet_hubs(self, hubs: DataFrame, left: DataFrame, first: Column | None = None, fine: bool = True) -> None:
        """Compare what is left in each bucket with the bucket's hubs, but for those of its class."""
        taken = ("bucket", "rid", "weight", "sketch", "label", "open", "buckets", "triples")
        hubs = hubs.join(left.select("bucket").distinct(), "bucket", "left_semi")
        hubs = hubs.select(*(F.col(c).alias("hub" if c == "rid" else f"h_{c}") for c in taken if c in hubs.columns))
        hubs = materialize(hubs, "hubs")
        # A similarity is at most the lighter text's weight over the heavier's, and shows in the samples' agreement.
        alike = F.least("weight", "h_weight") >= self.threshold * F.greatest("weight", "h_weight") * 0.999999
        if fine:
            agree = (F.col("label") != F.col("h_label")) & (_bits_agree("sketch", "h_sketch") >= FURTHER_AGREEING) & _first_met()
        else:
            agree = F.size(F.filter(F.zip_with("sketch", "h_sketch", lambda x, y: x == y), lambda x: x)) >= AGREEING
        fits = alike & agree if first is None else first & alike & agree
        pairs = left.join(hubs, (F.col("bucket") == F.col("h_bucket")) & (F.col("rid") != F.col("hub")) & fits)
        self.try_pairs(pairs.select(F.least("rid", "hub").alias("a"), F.greatest("rid", "hub").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(rid, label) of every linked row: the least row id of its component."""
    spark = edges.sparkSession
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both-ways")
    labels = materialize(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("rid").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("l"))
        # Read twice below; Spark reuses the exchange of its aggregation.
        better = labels.join(near, F.col("rid") == F.col("v"), "left").select("rid", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = better.join(better.select(F.col("rid").alias("t"), F.col("label").alias("further")), F.col("label") == F.col("t"), "left")
        jumped = materialize(jump.select("rid", "old", F.least("label", "further").alias("label")), "labels")
        remove(spark, labels)
        labels = jumped.select("rid", "label")
        labels.scratch = jumped.scratch
        if not jumped.where(F.col("old") != F.col("label")).limit(1).count():
            remove(spark, both)
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, table: int = TABLE) -> DataFrame:
    """(rid, doc_id, class_id, class_size, kept, n_links) of every row.

    A class holds the texts that links of weighted Jaccard similarity at or above the threshold connect, and their
    copies (equal words). ``class_id`` is the smallest doc_id in it, ``kept`` marks one row, that of the smallest id
    (null ids last; of equal ids the first row read); ``n_links`` counts the verified links of the row's text to
    different texts, which is a lower bound of its similar texts: pairs that a class joins already are not all tried. Texts without words (null, empty) are copies of each other. Repeated rows are copies; an empty
    table gives an empty one; other columns are not read. The rows are numbered once, in the stored table of shingles.
    """
    return _near_duplicates(docs, id_col, text_col, threshold, table)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, size: int = TABLE, rid: Column | None = None) -> DataFrame:
    small_batches(docs.sparkSession)
    table = materialize(shingle_table(docs, id_col, text_col, rid), "shingles")
    documents, pairs = table.agg(F.count(F.lit(1)), F.sum(F.size("shingles"))).first()
    least = max(1.0, (pairs or 0) / size)
    weights = Weights(frequent_shingles(table, least) if pairs else {}, documents, least)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    copies = table.groupBy("k1", "k2").agg(F.min("rid").alias("text"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    copies = materialize(copies, "copies")
    rows = attach(table.select("rid", "doc_id", "k1", "k2"), ["k1", "k2"], copies, "copies", F.col("rid"))
    rows = materialize(rows.select("rid", "doc_id", F.coalesce("text", "rid").alias("text")), "rows")
    signed = signature_table(table, weights)
    single = rows.where(F.col("rid") == F.col("text")).select("rid")
    signed = materialize(signed.join(single, "rid"), "signed")
    members = signed.select("rid", F.posexplode("buckets").alias("band", "bucket"))
    search = _search(members, signed, table, weights, threshold)
    edges, labels = search.edges, search.labels
    degree = edges.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = rows.groupBy(F.col("text").alias("rid")).agg(F.count(F.lit(1)).alias("n"))
    linked = materialize(labels.join(degree, "rid").join(sizes, "rid").select(F.col("rid").alias("text"), "label", "n_links", "n"), "linked")
    rows = attach(rows, ["text"], linked, "n", F.col("rid")).select("rid", "doc_id", F.coalesce("label", "text").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    rows = materialize(rows, "labelled")
    remove(docs.sparkSession, table, signed, copies, linked, labels)
    sweep(docs.sparkSession)
    classes = rows.groupBy("label").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("class_size")).where(F.col("class_size") > 1)
    out = attach(rows, ["label"], materialize(classes, "classes"), "class_size", F.col("rid"))
    first = F.coalesce("first", own)
    return out.select("rid", "doc_id", first["doc_id"].alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (first["rid"] == F.col("rid")).alias("kept"), "n_links")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class (``near_duplicates``: that of the smallest id, null ids last); columns as they were.

    Of the rows without words (null, empty) one stays; repeated rows are copies; an empty table gives an empty one.
    """
    rid = fresh(docs.columns, "rid")
    numbered = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    gone = _near_duplicates(numbered, id_col, text_col, rid=F.col(rid)).where(~F.col("kept")).select(F.col("rid").alias("gone"))
    return numbered.join(gone, numbered[rid] == gone["gone"], "left_anti").drop(rid)
