"""Similarity self-join of documents on word n-grams, by Jaccard similarity, with token-combination prefixes.

A document's set holds its distinct word shingles, as 64-bit hashes. Documents
of equal sets form one class. Two sets that link miss at most ``tau`` of each
other's tokens, which gives the filters, none of which loses a link:

1. Under the order of hash values, the first ``tau + l`` tokens of either set
   share at least ``l``. Only these tokens are counted over the corpus, and a
   class with too few repeated ones is out.
2. A class's repeated tokens are ordered from rare to frequent, and its prefix is
   extended until destroying all its signatures would take more tokens than a
   linked set can lack: a rare token is a signature by itself, frequent ones only
   in combinations of two, very frequent ones of three. Combinations are made
   within groups of tokens, by a hash; the number of groups goes by the size of
   the set, so the signatures stay in proportion to the set: at most about two
   for each of its tokens with combinations of two, ten with those of three.
   Linked sets therefore share a signature. The limits of frequent and very frequent do not
   move with the corpus, so that a single token's bucket stays bounded.
3. The parity bits of two sets bound their difference from below.

The classes that share a signature form a bucket. First each class is compared
with its bucket's smallest one, which joins groups of near copies in proportion
to their size. Buckets that still hold several components follow: small ones
give every pair of different components that the bounds allow, large ones the
edges of a least spanning forest and then, for what verified edges have not
connected, every such pair. Very large ones are processed in blocks.

Defined results: a text without words has an empty set and links with nothing;
fewer words than a shingle has form one token; rows that repeat a key are in the
class of their own text; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.batches import sliced
from lodestack.llm.graphs import components
from lodestack.llm.names import fresh
from lodestack.runtime import drop_table, materialize

#: Tokens in the prefixes of more classes than this count as frequent, and as very frequent.
FREQUENT, VERY_FREQUENT = 128, 65_536
WORDS = 8  # 64-bit words of a parity sketch
#: Buckets up to SMALL give all pairs at once; those beyond BLOCK are cut.
SMALL, BLOCK = 64, 1024
#: The filter of classes whose sets are read again has so many bits at most (2 MiB); beyond that more sets are read than needed.
MAX_BITS = 1 << 24
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles; ASCII letters count in lower case, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = _mixed(total * _MULTIPLIERS[i % 8] + h[i : i + n])
    return np.unique(total)


class Bounds:
    """What a similarity of ``percent`` per cent implies for sets of n tokens."""

    def __init__(self, percent: int):
        if not 80 <= percent <= 100:
            raise ValueError("the similarity is 80 to 100 per cent")
        self.percent = percent

    def tau(self, n):
        """Tokens of a set of n that a linked set can lack."""
        return (100 - self.percent) * n // 100

    def extra(self, n):
        return max(8, self.tau(n) // 2)

    def prefix(self, n: int) -> int:
        return min(n, self.tau(n) + self.extra(n))

    def need(self, n: int) -> int:
        """Tokens that the prefixes of a set of n and of any linked set share at least."""
        least = -(-self.percent * n // 100)
        return min(least - self.tau(least), self.extra(least))

    def smallest(self) -> int:
        """The least size of a set that can link with another set."""
        if self.percent == 100:
            return 1 << 40
        return -(-self.percent // (100 - self.percent))

    def levels(self, n: int) -> range:
        """The size classes in which a set of n makes combinations: its own, and those of larger sets that can link with it."""
        return range(n.bit_length() - 1, (100 * n // self.percent).bit_length())

    def groups(self, level: int) -> int:
        """The groups of tokens that combine. Up to three tokens of each are of no use, which the prefix makes up for."""
        least = max(self.smallest(), -(-self.percent * (1 << level) // 100))
        return max(1, (self.need(least) - 1) // 3)

    def linked(self, a: int, b: int, both: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def may_differ(self, a, b):
        """The most tokens in only one of two linked sets of a and b tokens."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _key(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _sketch(tokens: np.ndarray) -> bytes:
    return np.packbits((np.bincount((tokens >> np.uint64(55)).astype(np.int64), minlength=64 * WORDS) & 1).astype(np.uint8)).tobytes()


SEEN = "doc_id long, digest long, n long, key binary, tokens binary, sketch binary"


def _sketched(size: int, bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingle_set(t, size) for t in _binary(batch, "text")]
            can = [len(s) >= bounds.smallest() for s in sets]
            first = [s[: bounds.prefix(len(s))].tobytes() if ok else b"" for s, ok in zip(sets, can)]
            sketches = [_sketch(s) if ok else b"" for s, ok in zip(sets, can)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in ([_key(s) for s in sets], first, sketches))], ["doc_id", "digest", "n", "key", "tokens", "sketch"]
            )

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, token) of each hash in the binary column ``tokens``."""
    for batch in sliced(batches, "tokens"):
        data = _binary(batch, "tokens")
        sizes = [len(x) // 8 for x in data]
        ids = np.repeat(batch.column(batch.schema.get_field_index("nid")).to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(b"".join(data), np.int64))], ["nid", "token"])


def _spots(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each id."""
    h = _mixed(ids.view(np.uint64))
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _marks(bits: int):
    """(word, mask) of the filter's 64-bit words, of a batch's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.concatenate(_spots(batch.column(0).to_numpy(), bits))
            masks = (np.uint64(1) << (spots & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spots >> 6), pa.array(masks)], ["word", "mask"])

    return run


def _whole_sets(size: int, shared):
    """(key, n, tokens) of the documents that the filter of ids lets through, and of a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = shared.value
        for batch in sliced(batches, "text"):
            a, b = _spots(batch.column(0).to_numpy(), len(filter_) * 64)
            hit = np.flatnonzero((filter_[a >> 6] >> (a & 63).astype(np.uint64) & filter_[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)) == 1)
            sets = [shingle_set(t, size) for t in _binary(batch.take(pa.array(hit)), "text")]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "n", "tokens"])

    return run


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, bounds: Bounds, frequent: tuple[int, int] = (FREQUENT, VERY_FREQUENT)) -> list[tuple[int, ...]]:
    """The signatures of a set of n tokens, of whose prefix ``tokens`` are those in at least two classes.

    (0, token): a single one; (level, 1 or 2, ...): combinations of frequent and very frequent tokens.
    """
    spare = len(tokens) - bounds.need(n)
    if spare < 0:
        return []
    order = np.lexsort((tokens, df))
    kinds = ((df > frequent[0]).astype(int) + (df > frequent[1]))[order].tolist()
    tokens = tokens[order].tolist()
    if not kinds[spare]:
        return [(0, t) for t in tokens[: spare + 1]]
    out: dict[tuple[int, ...], None] = {}
    for level in bounds.levels(n):
        groups = bounds.groups(level)
        held: dict[tuple[int, int], list[int]] = {}
        cost = 0
        for t, kind in zip(tokens, kinds):
            if kind:
                own = held.setdefault((kind, t % groups), [])
                own.append(t)
                cost += len(own) > kind
            else:
                out[(0, t)] = None
                cost += 1
            if cost > spare:  # comes before the tokens end, see ``Bounds.groups``
                break
        for (kind, _), own in held.items():
            out |= dict.fromkeys((level, kind, *c) for c in combinations(sorted(own), kind + 1))
    return list(out)


def _signed(bounds: Bounds, frequent: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[list[int], int]] = []
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ends = np.cumsum(at["pairs"].value_lengths().to_numpy(zero_copy_only=False)).tolist()
            flat = at["pairs"].flatten()
            tokens, df = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for nid, n, x, y in zip(at["nid"].to_pylist(), at["n"].to_pylist(), [0, *ends], ends):
                own = signatures(tokens[x:y], df[x:y], n, bounds, frequent)
                if own:
                    rows.append(([xxhash.xxh3_64_intdigest(np.array(s, np.int64).tobytes()) - 2**63 for s in own], nid))
            cols = list(zip(*rows)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.int64()), pa.int64()))], ["sigs", "nid"])

    return run


def _sketches(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), np.uint64).reshape(-1, WORDS)


def _close(bounds: Bounds, n, m, x, y):
    """Whether sets of n and m tokens with sketches x and y may link, and the least that they differ by."""
    far = np.bitwise_count(x ^ y).sum(axis=-1).astype(np.int64)
    return (far <= bounds.may_differ(n, m)) & (100 * np.minimum(n, m) >= bounds.percent * np.maximum(n, m)), far


def _near(bounds: Bounds):
    """Of pairs with their sizes and sketches, those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", "m"))
            good, _ = _close(bounds, n, m, _sketches(batch, "x"), _sketches(batch, "y"))
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(good)))

    return run


class _Bucket:
    """The rows of one large bucket, or of two blocks of a very large one."""

    def __init__(self, nid, n, sketch, block, label, bounds: Bounds):
        self.nid, self.n, self.sketch, self.block, self.label, self.bounds = nid, n, sketch, block, label, bounds
        self.two = block.min() != block.max()

    def gaps(self, i: int) -> np.ndarray:
        """The least possible difference of set i to every set; a huge number where they can't link, -1 within a component."""
        good, far = _close(self.bounds, self.n, self.n[i], self.sketch, self.sketch[i])
        if self.two:
            good &= self.block != self.block[i]
        far = np.where(good, far, 1 << 40)
        far[self.label == self.label[i]] = -1
        return far

    def forest(self) -> list[tuple[int, int]]:
        m = len(self.nid)
        best, source = np.full(m, 1 << 40), np.full(m, -1)
        out, open_ = [], np.ones(m, bool)
        now = 0
        for _ in range(m):
            open_[now] = False
            gap = self.gaps(now)
            closer = (gap < best) & open_
            best[closer], source[closer] = gap[closer], now
            left = np.where(open_, best, 1 << 41)
            now = int(left.argmin())
            if open_[now] and 0 <= best[now] < 1 << 40:
                out.append((self.nid[source[now]], self.nid[now]))
        return out

    def apart(self) -> list[tuple[int, int]]:
        """All pairs of different components that may link."""
        out = []
        for i in range(len(self.nid)):
            gap = self.gaps(i)
            out += [(self.nid[i], self.nid[j]) for j in np.flatnonzero((gap >= 0) & (gap < 1 << 40)) if j > i]
        return out


def _pairs(bounds: Bounds, small: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(rows: list[np.ndarray]) -> pa.RecordBatch:
            sig, lo, hi, nid, n, sketch, block, label, m = rows
            new = np.r_[True, (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            bucket = np.cumsum(new)
            found = []
            few = np.flatnonzero(m <= small)
            for d in range(1, small):
                i, j = few[:-d], few[d:]
                same = bucket[i] == bucket[j]
                if not same.any():
                    break
                same &= label[i] != label[j]
                i, j = i[same], j[same]
                good, _ = _close(bounds, n[i], n[j], sketch[i], sketch[j])
                found.append(np.stack([nid[i[good]], nid[j[good]]], 1))
            starts = np.flatnonzero(new)
            for a, b in zip(starts, np.r_[starts[1:], len(sig)]):
                if m[a] > small and (label[a:b] != label[a]).any():
                    own = _Bucket(nid[a:b], n[a:b], sketch[a:b], block[a:b], label[a:b], bounds)
                    found.append(np.array(own.apart() if last else own.forest(), np.int64).reshape(-1, 2))
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        names = ("sig", "lo", "hi", "nid", "n", "sketch", "block", "label", "m")
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [_sketches(batch, c) if c == "sketch" else batch.column(batch.schema.get_field_index(c)).to_numpy() for c in names]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            if not len(rows[0]):
                continue
            # The last bucket may go on in the next batch.
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            held = [r[cut:] for r in rows]
            if cut:
                yield pairs_of([r[:cut] for r in rows])
        if held is not None and len(held[0]):
            yield pairs_of(held)

    return run


def _verified(bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _binary(batch, "left"), _binary(batch, "right")
            good = []
            for i, (x, y) in enumerate(zip(left, right)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
                if bounds.linked(len(a), len(b), both):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    left = sets.select(F.col("nid").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("nid").alias("b"), F.col("tokens").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verified(bounds), "a long, b long")


def _need(bounds: Bounds, n: Column) -> Column:
    """``Bounds.need`` as a column."""
    least = F.ceil(F.lit(bounds.percent) * n / 100)
    lacks = F.floor((100 - bounds.percent) * least / 100)
    return F.least(least - lacks, F.greatest(F.lit(8), F.floor(lacks / 2)))


def _classed(docs: DataFrame, size: int, bounds: Bounds, frequent: tuple[int, int], small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, digest, n, key) of ``docs`` (doc_id, digest, text), and of each class (key): component_id, and the key of the component's first class."""
    spark = docs.sparkSession
    seen = materialize(docs.mapInArrow(_sketched(size, bounds), SEEN), "sketches")
    classes = seen.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "tokens", "sketch")))
    classes = materialize(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")
    members = materialize(seen.select("doc_id", "digest", "n", "key"), "members")
    drop_table(spark, seen)

    can = classes.where(F.col("n") >= bounds.smallest())
    first = can.select("nid", "tokens").mapInArrow(_tokens, "nid long, token long")
    again = first.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = first.join(again, "token").groupBy("nid").agg(F.collect_list(F.struct("token", "df")).alias("pairs"))
    enough = lists.join(can.select("nid", "n"), "nid").where(F.size("pairs") >= _need(bounds, F.col("n")))
    signed = materialize(enough.mapInArrow(_signed(bounds, frequent), "sigs array<long>, nid long"), "signatures")
    heads = materialize(classes.drop("tokens"), "heads")
    drop_table(spark, classes)

    # Each class with the smallest one of its buckets.
    rows = signed.select(F.explode("sigs").alias("sig"), "nid")
    hubs = rows.groupBy("sig").agg(F.min("nid").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("sig", "hub")
    paired = materialize(rows.join(hubs, "sig").select("nid", "hub").distinct(), "hubs")

    # The whole sets of classes that have company.
    wanted = materialize(paired.select("nid").distinct().join(heads, "nid").select("nid", "key", F.coalesce("rep", F.lit(-(2**63))).alias("id")), "wanted")
    bits = min(MAX_BITS, max(1 << 16, 1 << (16 * wanted.count()).bit_length()))
    filter_ = np.zeros(bits // 64, np.uint64)
    marks = wanted.select("id").mapInArrow(_marks(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    filter_[marks["word"].to_numpy(np.int64)] = marks["mask"].to_numpy(np.int64).view(np.uint64)
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "text")
    whole = texts.mapInArrow(_whole_sets(size, spark.sparkContext.broadcast(filter_)), "key binary, n long, tokens binary")
    whole = whole.groupBy("key").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = materialize(whole.join(wanted.select("key", "nid"), "key").select("nid", "n", "tokens"), "sets")

    x = heads.select(F.col("nid").alias("a"), "n", F.col("sketch").alias("x"))
    y = heads.select(F.col("nid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    stars = paired.where("nid <> hub").select(F.col("hub").alias("a"), F.col("nid").alias("b"))
    near = stars.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_near(bounds), "a long, b long")
    edges = materialize(_verify(near, sets, bounds), "links")
    labels = components(edges)

    # Buckets of several components; after the first turn only large ones can hold further links.
    several: DataFrame | None = None
    for last in (False, True):
        named = labels.withColumnRenamed("node", "nid")
        own = signed.join(named, "nid", "left").select(F.explode("sigs").alias("sig"), "nid", F.coalesce("label", "nid").alias("label"))
        if several is None:
            sizes = own.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("_a"), F.max("label").alias("_b"))
            several = materialize(sizes.where("_a <> _b").select("sig", "m"), "several")
        elif not (several := several.where(F.col("m") > small)).take(1):
            break
        mixed = own.join(several, "sig").join(heads.select("nid", "n", "sketch"), "nid")
        cut = mixed.withColumn("_cuts", F.ceil(F.col("m") / block).cast("int"))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("nid"), F.col("_cuts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)))
        dealt = cut.select("sig", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "nid", "n", "sketch", "block", "label", "m")
        dealt = dealt.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
        pairs = dealt.mapInArrow(_pairs(bounds, small, last), "a long, b long").distinct()
        more = materialize(_verify(pairs, sets, bounds), "links")
        if more.take(1):
            edges = edges.union(more)
            labels = components(edges)

    named = heads.select("nid", "key", "rep").join(labels.withColumnRenamed("node", "nid"), "nid")
    firsts = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("first"))
    moved = named.join(firsts, "label").select("nid", "first.rep", F.col("first.key").alias("first_key"))
    of_class = heads.select("nid", "key", F.col("rep").alias("_rep")).join(moved, "nid", "left")
    of_class = materialize(of_class.select("key", F.coalesce("rep", "_rep").alias("component_id"), F.coalesce("first_key", "key").alias("first_key")), "components")
    for done in (signed, paired, wanted, sets, heads):
        drop_table(spark, done)
    return members, of_class


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), F.col(text).alias("text"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", frequent: tuple[int, int] = (FREQUENT, VERY_FREQUENT), small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest key reachable by links) of every row."""
    members, of_class = _classed(_rows(docs, key, text), size, Bounds(percent), frequent, small, block)
    return members.join(of_class, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that a document with a smaller key reaches by links.

    Rows that share a key are told apart by their text: those with equal sets
    count as one, others stay unless links join them.
    """
    members, of_class = _classed(_rows(docs, key, text), size, Bounds(percent), (FREQUENT, VERY_FREQUENT), SMALL, BLOCK)
    alone = members.where(F.col("key").isNull()).select("doc_id", "digest").distinct()
    first = members.join(of_class, "key").where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("first_key")))
    stays = alone.union(first.groupBy("doc_id", "key").agg(F.min("digest").alias("digest")).select("doc_id", "digest")).select(F.col("doc_id").alias("_stays"), F.col("digest").alias("_digest"))
    mine = fresh(docs, "_own_digest")
    rows = docs.withColumn(mine, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).dropDuplicates([key, mine])
    return rows.join(stays, rows[key].cast("long").eqNullSafe(stays["_stays"]) & (rows[mine] == stays["_digest"]), "left_semi").drop(mine)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
