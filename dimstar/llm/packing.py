"""Best-fit packing of tokenised documents by fitting few-document patterns to the histogram of lengths.

Documents longer than a sequence are cut; the pieces' lengths are counted (at most `size` different ones). Patterns of one to three
lengths that fill a sequence are enumerated, non-negative least squares fits how often to repeat each so that together they use up
the histogram, repeats are rounded down, and what is left is packed best-fit decreasing, by counts, into free places and new
sequences. The plan depends on the histogram alone. Each piece then takes the place of its rank among the pieces of its length;
ranks come from counts per (length, block), so that a length with a third of all pieces is spread over many tasks.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize, ship_code
from dimstar.llm.bpe import SPLIT, Vocabulary, vocabulary
from dimstar.llm.skew import small_batches

#: Second lengths tried with each first length; bounds the patterns at size * PARTNERS.
PARTNERS = 12
#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.75, 0.5, 0.25)
#: Pieces of one length are ranked in at least this many blocks, and about BLOCK_ROWS pieces of all lengths per block and length.
BLOCKS, BLOCK_ROWS = 64, 1_000_000


@functools.lru_cache(maxsize=2)
def _library_encoder(path: str):
    """tiktoken over the vocabulary's own ranks: the same ids as the tokenizers library gives, several times as fast."""
    import tiktoken

    v = Vocabulary(path)  # not kept: a worker would hold it beside the library's own
    ranks = {v.bytes_of[i]: i for i in range(v.size) if v.bytes_of[i] and i not in v.special.values()}
    made = np.flatnonzero(v.turn >= 0)
    if not (np.diff(v.turn[made]) > 0).all() or (len(made) and made[0] < 256):
        return lambda text: next(vocabulary(path).encode_batch([text]))  # ids aren't in the order of merges
    encoding = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=v.special)

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:  # its regular expressions give up on a million blanks in a row
            return next(vocabulary(path).encode_batch([text]))

    return encode


def token_pieces(docs: DataFrame, vocabulary_path: str, *, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece: ids of the text, then end_id, cut to `size` with the short piece first.

    Null counts as empty: one piece of one id. Rows with a null id and repeated rows are cut like any other; other columns aren't read;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_code(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _library_encoder(vocabulary_path)
        for batch in small_batches(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                first = len(ids) % size or min(size, len(ids))
                edges = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def patterns_for(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to three lengths (0: none), largest first, whose sum is `size` or as near below it as the lengths allow."""
    have = np.flatnonzero(counts)
    found: set[tuple[int, int, int]] = set()
    fit = lambda room: int(have[i - 1]) if room > 0 and (i := np.searchsorted(have, room, "right")) else 0
    for a in have[::-1].tolist():
        b = fit(size - a)
        found.add((a, b, fit(size - a - b)))
        room = have[have <= size - a]
        for b in room[np.argsort(-counts[room], kind="stable")[:PARTNERS]].tolist():
            found.add((*sorted((a, b, fit(size - a - b)), reverse=True),))
    return np.array(sorted((tuple(sorted(p, reverse=True)) for p in found), reverse=True), np.int64).reshape(-1, 3)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeats x >= 0 with sum of patterns * x near the histogram."""
    scale = max(float(counts.max(initial=1)), 1.0)
    target = counts / scale
    target[0] = 0

    def used(x):
        out = np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=len(counts))
        out[0] = 0
        return out

    def back(r):
        return np.where(patterns > 0, r[patterns], 0).sum(1)

    v = np.ones(len(patterns))
    for _ in range(15):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1 / max(top * 1.05, 1e-12)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(used(y) - target), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


@dataclass
class _Group:
    """`count` sequences with the same contents."""

    contents: tuple[int, ...]
    count: int


@dataclass
class Plan:
    """Places by length: ranks from `first` on go to sequences from `base` on, `each` to one sequence, side by side from `at` on."""

    sequences: int = 0
    places: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=lambda: defaultdict(list))

    def arrays(self) -> dict[int, np.ndarray]:
        return {length: np.array(rows, np.int64) for length, rows in self.places.items()}


def _packed(counts: np.ndarray, size: int, patterns: np.ndarray, repeats: np.ndarray) -> list[_Group]:
    """Groups of sequences: each pattern as often as `repeats` says, then best fit decreasing of what is left, by counts."""
    left = counts.copy()
    done: list[_Group] = []
    free: dict[int, list[_Group]] = defaultdict(list)  # by free room

    def keep(contents: tuple[int, ...], count: int) -> None:
        room = size - sum(contents)
        (free[room] if room else done).append(_Group(contents, count))

    for p in np.argsort(-repeats, kind="stable"):
        lengths, need = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
        times = int(min(repeats[p], (left[lengths] // need).min()))
        if times:
            left[lengths] -= times * need
            keep(tuple(sorted(patterns[p][patterns[p] > 0].tolist(), reverse=True)), times)
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, size) if free.get(r)), None)
            if room is None:
                fill = size // length
                if n >= fill:
                    keep((length,) * fill, n // fill)
                if n % fill:
                    keep((length,) * (n % fill), 1)
                break
            group = free[room].pop()
            times = min(n, group.count)
            if group.count > times:
                free[room].append(_Group(group.contents, group.count - times))
            keep((*group.contents, length), times)
            n -= times
    return [*done, *(g for room in sorted(free) for g in free[room])]


def make_plan(histogram: dict[int, int], size: int) -> Plan:
    """Pattern repeats, then best fit decreasing of what is left.

    Only patterns that fill a sequence are certain to cost nothing; but all repeats of them may use up the short pieces that the rest
    needs. So the rest is packed after each of SHARES of their repeats, after those of all patterns, and after none, and the fewest
    sequences count: the plan never has more than best fit decreasing alone.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns = patterns_for(counts, size)
    full = patterns[patterns.sum(1) == size]
    fits = [(some, fit_repeats(some, counts.astype(float)) if len(some) else np.zeros(0)) for some in (full, patterns)]
    tries = [(full, share * fits[0][1]) for share in SHARES] + [fits[1], (patterns[:0], np.zeros(0))]
    tried = [_packed(counts, size, some, np.floor(x + 1e-6).astype(np.int64)) for some, x in tries]
    best = min(tried, key=lambda groups: sum(g.count for g in groups))
    plan, next_rank = Plan(), defaultdict(int)
    for group in best:
        at = 0
        for length in sorted(set(group.contents), reverse=True):
            each = group.contents.count(length)
            plan.places[length].append((next_rank[length], plan.sequences, each, at))
            next_rank[length] += each * group.count
            at += each * length
        plan.sequences += group.count
    return plan


def pack_documents(docs: DataFrame, vocabulary_path: str, *, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with end_id alone. Repeated rows and rows with a null id are packed like any other; an
    empty table gives no rows. Pieces of one sequence lie side by side from offset 0 on.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, vocabulary_path, size=size, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    counted = pieces.groupBy("length").count().collect()  # at most `size` rows
    places = make_plan({r["length"]: r["count"] for r in counted}, size).arrays()
    total = sum(r["count"] for r in counted)

    block = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(max(BLOCKS, total // BLOCK_ROWS))).alias("block")
    keyed = pieces.select("*", block)
    by_block = keyed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "block").orderBy("id", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(starts, ["length", "block"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size_ in np.unique(length):
                rows = np.flatnonzero(length == size_)
                table = places[int(size_)]
                first, base, each, at = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1].T
                nth = rank[rows] - first
                sequence[rows], offset[rows] = base + nth // each, at + nth % each * size_
            kept = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*("id", "piece", "start", "length", "ids_crc32"), "sequence_id", "offset"])

    rows = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
