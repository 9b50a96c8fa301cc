"""Similarity classes of texts by the Jaccard similarity of their word n-grams, with prefix filters under several token orders.

Equal sets are one class from the start. Two sets of similarity t or more share a token among their first n - ceil(t * n) + 1 ones
under any global order of tokens, and more tokens among longer prefixes. Two kinds of orders are used:

1. Orders by a hash, for which nothing has to be known about the tokens. A document whose prefix shares too few tokens with other
   prefixes has no partner; only documents that pass under each of these orders go on, with whole sets.
2. The order by frequency, rarest tokens first, counted exactly over all documents that are left. Documents that share a prefix token
   of this order, at places that leave room for a large enough intersection, become pairs.

A pair then has to pass the prefixes of all orders before it is verified with the whole sets.

A group of thousands of near copies would make millions of pairs. So links from each document to a few pivots of its buckets are
verified first, and documents that are connected by them get one label. Only buckets in which labels meet go on, and the last,
complete pass makes only pairs of different labels; a pair of one label can't change the result. Documents at the rim of a
group, just below the similarity, share most tokens with all of it: these pairs are told apart in the join, by parities of the sets.
Each token flips one of PARITIES bits of its set, so two sets differ in at least as many tokens as bits. Large buckets are dealt in
blocks to several tasks.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize, ship_code
from dimstar.llm.components import connected_components
from dimstar.llm.skew import attach_groups, keep_ids, small_batches, split_join
from dimstar.llm.wordhash import groups, mix, word_hashes

#: Pivots per document and round, and rounds at most; the complete pass that follows doesn't depend on them.
PIVOTS, ROUNDS = 8, 3

#: Prefixes under the orders by a hash are longer by this share, so that more than one token has to be shared.
LONGER = 0.5

#: Bits of a set's parities, in words of 64; and members of a bucket that meet in one block.
PARITIES, BLOCK = 512, 512
_WORDS = PARITIES // 64

_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)

def _fold() -> np.ndarray:
    """Bytes of words: all but space and tab to carriage return, A-Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[0x20, *range(0x09, 0x0E)]] = 0
    # the zero byte is part of words: 255 isn't in UTF-8
    table[0] = 255
    return table


_FOLD = _fold()


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: of all its words at once if it has fewer than n, none without words."""
    for _, raw in groups(texts):
        words, first = word_hashes(raw, _FOLD)
        grams = np.zeros(len(words), np.uint64)
        for k in range(n):
            part = words[k:] if k == 0 else np.concatenate([words[k:], np.zeros(min(k, len(words)), np.uint64)])
            grams = mix(grams * np.uint64(0x9FB21C651E98DF25) + part)
        for a, b in zip(first, first[1:]):
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + w)
                yield whole
            else:
                yield words[:0]


def _up(share: int, n):
    """ceil(share * n / 100) in integers."""
    return -(-share * n // 100)


def prefix_length(n: int, per_hundred: int) -> int:
    """Sets of n tokens share a token of their first ones with each set that is near enough."""
    return n - _up(per_hundred, n) + 1


def longer_prefix(n: int, per_hundred: int) -> int:
    short = prefix_length(n, per_hundred)
    return min(n, short + int(LONGER * short))


@functools.lru_cache(100_000)
def least_shared(n: int, per_hundred: int) -> int:
    """At least so many tokens of a set's longer prefix are in that of each set which is near enough.

    If the first x tokens of one set hold all but a - k of its n tokens (a: the least intersection), at least k of them are common;
    two prefixes share the smaller of both numbers, and the least over all sizes that go with n counts.
    """
    others = np.arange(_up(per_hundred, n), 100 * n // per_hundred + 1)
    most = -(-per_hundred * (n + others) // (100 + per_hundred))
    own = longer_prefix(n, per_hundred) - n + most
    shorts = others + per_hundred * others // -100 + 1
    theirs = np.minimum(others, shorts + (LONGER * shorts).astype(np.int64)) - others + most
    return max(1, int(np.minimum(own, theirs).min()))


def bound(kx: np.ndarray, nx: int, ky: np.ndarray, ny: int) -> int:
    """At most this intersection, from the ascending keys of two prefixes under one order."""
    # up to the earlier of the last keys, both prefixes hold all keys of their sets
    last = min(kx[-1], ky[-1])
    x, y = kx[: np.searchsorted(kx, last, "right")], ky[: np.searchsorted(ky, last, "right")]
    common = _shared(x, y)
    return min(nx - (len(x) - common), ny - (len(y) - common))


def parities(s: np.ndarray) -> np.ndarray:
    """PARITIES bits as longs: for each cell of tokens, whether the set s has an odd number of them."""
    cells = (mix(s ^ _SEEDS[2]) & np.uint64(PARITIES - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=PARITIES).astype(np.uint8) & 1).view(np.int64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _longs(array: pa.Array, i: int) -> np.ndarray:
    return np.asarray(array[i].values).view(np.uint64)


class NgramJoin:
    """The join over one table; `per_hundred` is the similarity in hundredths, `orders` the number of orders, frequency among them.

    Sets are word n-grams, or what `make` makes of a list of texts (sorted distinct 64-bit numbers of each). With `ranges`, buckets are
    divided by the lengths of the sets: a set is in its own range of lengths and in the next, and sets two ranges apart never meet.
    """

    def __init__(
        self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, per_hundred: int = 80, orders: int = 2,
        make: Callable[[list[str | None]], Iterator[np.ndarray]] | None = None, ranges: bool = False,
    ):
        self.spark = docs.sparkSession
        ship_code(self.spark)
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self.kind = self.docs.schema["id"].dataType.simpleString()
        self.make = make or functools.partial(shingle_sets, n=n)
        self.per_hundred, self.hashed, self.ranges = per_hundred, orders - 1, ranges
        self.sets = materialize(self._measured(), "ngram-prefixes")

    def _measured(self) -> DataFrame:
        """(id, n, digest, least, prefixes) of each row; prefixes are empty where no other set can be near enough.

        digest is BLAKE2b over the whole sorted set, so that equal digests mean equal sets. Keys of a hash order are the tokens'
        hashes: a bijection, so they stand for the tokens.
        """
        make, per_hundred, hashed = self.make, self.per_hundred, self.hashed

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                sizes, digests, least, prefixes = [], [], [], []
                for s in make(batch.column(1).to_pylist()):
                    size = len(s)
                    sizes.append(size)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    # a smaller set has no other set near enough: one token more or less is too much
                    if not size or 100 * size < per_hundred * (size + 1):
                        least.append(0)
                        prefixes.append([])
                        continue
                    least.append(least_shared(size, per_hundred))
                    length = longer_prefix(size, per_hundred)
                    keys = [mix(s ^ _SEEDS[0] ^ np.uint64(k)) for k in range(hashed)]
                    prefixes.append([np.sort(np.partition(k, length - 1)[:length]).view(np.int64) for k in keys])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(least, pa.int64()), pa.array(prefixes, pa.list_(pa.list_(pa.int64())))],
                    ["id", "n", "digest", "least", "prefixes"],
                )

        return self.docs.mapInArrow(measure, f"id {self.kind}, n long, digest binary, least long, prefixes array<array<long>>")

    def _classes(self) -> DataFrame:
        """(id, n, first): first is the smallest id with an equal set; null for rows without words or id."""
        rows = self.sets.select("id", "n", "digest").filter("n > 0 and id is not null")
        found = materialize(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "ngram-classes")
        total = found.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return attach_groups(rows, found, "digest", "rows", total).select("id", "n", "first")

    def _passing(self, firsts: DataFrame) -> DataFrame:
        """(id) of the documents that share enough tokens of their prefixes with others under each of the hash orders."""
        if not self.hashed:
            return firsts.select("id")
        kinds = firsts.select("id", F.posexplode("prefixes").alias("nth", "keys"))
        rows = kinds.select("id", "nth", F.explode("keys").alias("key"))
        # keys of two orders are told apart by the seed, so the key alone is counted; equal ones of two orders only let more pass
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        counts = materialize(counts, "ngram-shared")
        total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        shared = attach_groups(rows, counts, "key", "rows", total).groupBy("id", "nth").agg(F.count(F.lit(1)).alias("shared"))
        passed = shared.join(firsts.select("id", "least"), "id").filter("shared >= least").groupBy("id").agg(F.countDistinct("nth").alias("orders"))
        return passed.filter(F.col("orders") == self.hashed).select("id")

    def _whole(self, texts: DataFrame) -> DataFrame:
        """(id, n, tokens, w0, ...): whole sets and their parities."""
        make = self.make

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, 200):
                sets = list(make(batch.column(1).to_pylist()))
                bits = np.array([parities(s) for s in sets]).reshape(-1, _WORDS)
                words = [pa.array(bits[:, k], pa.int64()) for k in range(_WORDS)]
                tokens = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), tokens, *words], names)

        names = ["id", "n", "tokens", *(f"w{k}" for k in range(_WORDS))]
        return texts.mapInArrow(whole, f"id {self.kind}, n long, tokens array<long>, {', '.join(f'w{k} long' for k in range(_WORDS))}")

    def _buckets(self, whole: DataFrame) -> DataFrame:
        """(token, node, n, rare, place): the shared tokens of each document's prefix under the order by frequency, and their places.

        rare is the number of the document's tokens that no other one has.
        """
        rows = whole.select("id", F.explode("tokens").alias("token"))
        counts = materialize(rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "ngram-counts")
        total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        # the order: by the count, then by the token, which is a hash; tokens of one document come first. Sets, as rows may be repeated
        ordered = F.array_sort(F.collect_set(F.struct("rows", "token")))
        shared = attach_groups(rows, counts, "token", "rows", total).groupBy("id").agg(ordered.alias("ordered"))
        placed = shared.join(whole.select("id", "n").distinct(), "id").select("id", "n", F.posexplode("ordered").alias("nth", "of"), F.size("ordered").alias("all"))
        rare = F.col("n") - F.col("all")
        place = rare + F.col("nth")
        length = F.col("n") - F.expr(f"({self.per_hundred} * n + 99) div 100") + 1
        found = placed.select(F.col("of.token").alias("token"), F.col("id").alias("node"), "n", rare.alias("rare"), place.alias("place")).filter(F.col("place") < length)
        if not self.ranges:
            return found
        # lengths of one range differ by less than two linked sets may; the last place of a quotient is rounded off
        own = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / self.per_hundred) + 1e-9) if self.per_hundred < 100 else F.col("n")
        return found.withColumn("range", F.explode(F.array(own, own + 1))).withColumn("token", F.xxhash64("token", "range")).drop("range")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of ids whose sets are near enough."""
        per_hundred = self.per_hundred
        pairs = materialize(pairs, "ngram-pairs")
        ends = lambda p: p.select(F.col("a").alias("id")).union(p.select(F.col("b"))).distinct()
        side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}" if c != "id" else s) for c in df.columns))

        @F.arrow_udf("boolean")
        def possible(na: pa.Array, pa_: pa.Array, nb: pa.Array, pb: pa.Array) -> pa.Array:
            out = []
            for i, (x, y) in enumerate(zip(na.to_pylist(), nb.to_pylist())):
                fine = 100 * min(x, y) >= per_hundred * max(x, y)
                for k in range(len(pa_[i]) if fine else 0):
                    most = bound(_longs(pa_[i].values, k), x, _longs(pb[i].values, k), y)
                    if 100 * most < per_hundred * (x + y - most):
                        fine = False
                        break
                out.append(fine)
            return pa.array(out, pa.bool_())

        if self.hashed:
            small = keep_ids(self.nodes.select("id", "n", "prefixes"), ends(pairs), "id", "left_semi")
            near = split_join(split_join(pairs, side(small, "a"), "a"), side(small, "b"), "b", counted=pairs)
            pairs = materialize(near.filter(possible("n_a", "prefixes_a", "n_b", "prefixes_b")).select("a", "b"), "ngram-candidates")

        @F.arrow_udf("boolean")
        def linked(a: pa.Array, b: pa.Array) -> pa.Array:
            out = []
            for i in range(len(a)):
                x, y = _longs(a, i), _longs(b, i)
                both = _shared(x, y)
                out.append(100 * both >= per_hundred * (len(x) + len(y) - both))
            return pa.array(out, pa.bool_())

        sets = keep_ids(self.whole.select("id", "tokens"), ends(pairs), "id", "left_semi")
        full = split_join(split_join(pairs, side(sets, "a"), "a"), side(sets, "b"), "b", counted=pairs)
        return materialize(full.filter(linked("tokens_a", "tokens_b")).select("a", "b").distinct(), "ngram-links")

    def _plausible(self, na, nb, shared):
        """Can sets of na and nb tokens be near enough if their prefixes share `shared` tokens?

        The prefix that ends first in the order has all its unshared tokens outside the other set.
        """
        t = self.per_hundred
        behind = lambda n: F.expr(f"({t} * {n} + 99) div 100") - 1  # noqa: E731  tokens after the prefix
        most = F.least(F.greatest(behind(na), behind(nb)) + shared, F.col(na), F.col(nb))
        return 100 * most >= t * (F.col(na) + F.col(nb) - most)

    def _round(self, grouped: DataFrame, nth: int) -> DataFrame:
        """Links of documents b to pivots a of another label.

        A pivot is, of each bucket, the member with the fewest tokens of its own in rounds 1 and 3, as in a group of near copies it is
        near to the original; else, and among equals, the one with the smallest hash of the round.
        """
        first = F.col("rare") if nth % 2 else F.lit(0)
        entry = F.struct(first.alias("rare"), F.xxhash64(F.lit(nth), "node").alias("hash"), "node", "n", "c")
        pivots = grouped.groupBy("token").agg(F.min(entry).alias("p"))
        pivots = pivots.select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.c").alias("pivot_c"))
        votes = split_join(grouped.select("token", "node", "n", "c"), pivots, "token").filter("c != pivot_c")
        votes = votes.groupBy("node", "n", "pivot", "pivot_n").agg(F.count(F.lit(1)).alias("votes"))
        # a pivot isn't drawn in every shared bucket: half of the needed tokens are enough here
        likely = votes.filter(self._plausible("n", "pivot_n", 2 * F.col("votes")))
        best = Window.partitionBy("node").orderBy(F.desc("votes"), "pivot")
        likely = likely.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= PIVOTS)
        return self._verified(likely.select(F.col("pivot").alias("a"), F.col("node").alias("b")))

    def _met(self, grouped: DataFrame) -> DataFrame:
        """(a, b): pairs of different labels that meet in a bucket, and that sizes, places and parities let be near enough.

        Rows of a bucket of m members are dealt to m / BLOCK blocks, and blocks meet in pairs; a pair of members meets once.
        """
        t, words = self.per_hundred, [f"w{k}" for k in range(_WORDS)]
        sizes = grouped.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
        total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        dealt = attach_groups(grouped, sizes, "token", "rows", total).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
        dealt = dealt.join(self.whole.select(F.col("id").alias("node"), *words), "node")
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("token", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node", "n", "place", "c", *words)
        side = lambda s: dealt.select("token", "lo", "hi", *(F.col(x).alias(f"{x}_{s}") for x in ("own", "node", "n", "place", "c", *words)))
        differ = " + ".join(f"bit_count({w}_a ^ {w}_b)" for w in words)
        could = (
            f"c_a < c_b and (lo = hi) = (own_a = own_b) and 100 * least(n_a, n_b) >= {t} * greatest(n_a, n_b) "
            f"and {100 + t} * least(n_a - place_a, n_b - place_b) >= {t} * (n_a + n_b) and {100 + t} * ({differ}) <= {100 - t} * (n_a + n_b)"
        )
        pairs = side("a").join(side("b"), ["token", "lo", "hi"]).filter(could)
        return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()

    def components(self) -> DataFrame:
        """(id, n, component) of each row of the table; component is null for rows without an id."""
        classes = materialize(self._classes(), "ngram-members")
        copies = classes.filter("id != first").select("id").distinct()
        firsts = keep_ids(self.sets.filter("least > 0 and id is not null").drop("digest"), copies, "id", "left_anti")
        passing = materialize(self._passing(firsts), "ngram-passing")
        self.nodes = materialize(keep_ids(firsts, passing, "id", "left_semi"), "ngram-nodes")
        self.whole = materialize(self._whole(keep_ids(self.docs, passing, "id", "left_semi")), "ngram-sets")
        members = materialize(self._buckets(self.whole), "ngram-buckets")

        links, labels, before = [], materialize(members.select("node").distinct().withColumn("c", F.col("node")), "ngram-labels"), None
        for nth in range(1, ROUNDS + 2):
            grouped = members.join(labels, "node")
            parts = grouped.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("token")
            parts = parts.agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count(F.lit(1)).alias("labels"))
            meet = materialize(parts.filter("labels > 1").select("token", "s", "q"), "ngram-meetings")
            members = materialize(split_join(members, meet.select("token"), "token"), "ngram-mixed")
            grouped = materialize(members.join(labels, "node"), "ngram-labelled")
            # pairs of different labels that the complete pass would look at, and rows that they come from
            pairs, rows = meet.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2.0), F.lit(0.0)), F.coalesce(F.sum("s"), F.lit(0))).first()
            if nth > ROUNDS or pairs <= rows or (nth > 2 and pairs > 0.9 * before):
                break
            before = pairs
            links.append(self._round(grouped, nth))
            known = connected_components(functools.reduce(DataFrame.unionByName, links)).select("node", "component")
            labels = materialize(labels.select("node").join(known, "node", "left").select("node", F.coalesce("component", "node").alias("c")), "ngram-labels")
        links.append(self._verified(self._met(grouped)))

        final = connected_components(functools.reduce(DataFrame.unionByName, links)).select(F.col("node").alias("first"), "component")
        placed = split_join(classes, final, "first", "left").select("id", "n", F.coalesce("component", "first").alias("component"))
        bare = self.sets.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
        return placed.unionByName(bare)


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, per_hundred: int = 80, orders: int = 2) -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id (the smallest id reachable by links).

    Words are runs of bytes other than space and tab to carriage return, A-Z in lower case; a text's set are its distinct n-grams,
    or all its words as one if it has fewer. Texts are linked if 100 * intersection >= per_hundred * union; equal sets are linked.
    Null, empty and blank texts have no set and no links. Ids are taken as unique but for repeated rows, which share a component; a
    row with a null id has component_id null. Other columns aren't read, and an empty table gives no rows.
    """
    found = NgramJoin(docs, id_col=id_col, text_col=text_col, n=n, per_hundred=per_hundred, orders=orders).components()
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, per_hundred: int = 80) -> DataFrame:
    """`docs` with only the row of the smallest id of each component; columns as they were.

    Null, empty and blank texts have no set, so all their rows stay. A row with a null id stays only if no row of its component has
    an id, and of repeated rows one stays: a table that has such rows is written to the shared folder with numbers of its own as ids.
    An empty table gives no rows.
    """
    sizes = docs.agg(F.count(F.lit(1)), F.count(id_col)).first()
    regular = sizes[0] == sizes[1] and not docs.groupBy(id_col).count().filter("count > 1").limit(1).count()
    if regular:
        found = ngram_components(docs, id_col=id_col, text_col=text_col, n=n, per_hundred=per_hundred)
        gone = materialize(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "ngram-dropped")
        return keep_ids(docs, gone, id_col, "left_anti")
    own = "_row_of_ngram_join"
    numbered = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "ngram-numbered")
    found = ngram_components(numbered.select(own, text_col), id_col=own, text_col=text_col, n=n, per_hundred=per_hundred)
    found = materialize(found.filter("n_shingles > 0").select(own, "component_id"), "ngram-numbers")
    rows = split_join(numbered.select(own, F.col(id_col).alias("id")), found, own)
    # null ids last, as a struct orders nulls first
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", own)).alias("first"))
    kept = materialize(first.select(F.col(f"first.{own}").alias(own)), "ngram-firsts")
    gone = materialize(found.select(own).join(kept, own, "left_anti"), "ngram-dropped")
    return keep_ids(numbered, gone, own, "left_anti").drop(own)
