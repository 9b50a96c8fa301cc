"""Document fingerprints by spot signatures.

A signature is an anchor (a common word) with the next CHAIN content words after it, in a text's whole sequence of words. A
fingerprint is the sorted set of a text's signatures, ten characters each. Likeness is the Jaccard similarity of two sets; pairs
are told apart by the lengths of their sets first, and counting stops once a wanted likeness is out of reach.

`near_classes` searches for near texts: sets are divided by ranges of their lengths and meet only sets of lengths near enough, by their
rarest signatures first, at places that leave room for a large enough intersection. `fingerprint_documents` compares given pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimstar.functions.runtime import ship_code
from dimstar.llm.ngram_join import NgramJoin
from dimstar.llm.skew import small_batches
from dimstar.llm.wordhash import groups, mix, word_hashes

# Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and a to in is it that for as with on are be this was by at from or an have not but which you were all their "
    "de la le et les des en un une du est que dans qui par pour au sur pas plus avec se ce il elle ne sont aux son "
    "der die und den von das mit sich dem nicht ein eine auf ist im zu für als auch es werden aus hat nach bei wird "
    "el y los las del con una por su para es al lo como más o pero sus ha me si sin sobre este"
).split()
CHAIN = 2
#: Bits of a signature in a fingerprint, and the characters that write six of them each.
BITS, DIGITS = 60, "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
_CHARS = BITS // 6


def _fold() -> np.ndarray:
    """Bytes of words: ASCII letters in lower case, digits, and all bytes beyond ASCII."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        table[c] = c
    table[65:91] = np.arange(97, 123)
    return table


_FOLD = _fold()
_ANCHOR_HASHES = np.sort(word_hashes([w.encode() for w in ANCHORS], _FOLD)[0])
_DIGITS = np.frombuffer(DIGITS.encode(), np.uint8)
_VALUES = np.zeros(256, np.int64)
_VALUES[_DIGITS] = np.arange(64)


def signature_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct signatures of each text.

    A text with words but without a whole chain has one signature, of all its words; one without words but not empty has one of its
    bytes; an empty one has none. So equal texts have equal sets.
    """
    for _, raw in groups(texts):
        words, first = word_hashes(raw, _FOLD)
        at = np.minimum(np.searchsorted(_ANCHOR_HASHES, words), len(_ANCHOR_HASHES) - 1)
        anchor = _ANCHOR_HASHES[at] == words
        content, spots = np.flatnonzero(~anchor), np.flatnonzero(anchor)
        after = np.searchsorted(content, spots)
        fits = after + CHAIN <= len(content)
        spots, after = spots[fits], after[fits]
        text_of = np.searchsorted(first, spots, "right")
        fits = content[after + CHAIN - 1] < first[np.minimum(text_of, len(first) - 1)] if len(spots) else np.zeros(0, bool)
        spots, after = spots[fits], after[fits]
        signature = words[spots]
        for k in range(CHAIN):
            signature = mix(signature * np.uint64(0x9FB21C651E98DF25) + words[content[after + k]])
        signature = (signature >> np.uint64(64 - BITS)).astype(np.int64)
        edges = np.searchsorted(spots, first)
        for i, text in enumerate(raw):
            if edges[i + 1] > edges[i]:
                yield np.unique(signature[edges[i] : edges[i + 1]])
            elif text:
                whole = words[first[i] : first[i + 1]].tobytes() or text
                yield np.array([int.from_bytes(hashlib.sha256(whole).digest()[:8], "little") >> (64 - BITS)], np.int64)
            else:
                yield np.zeros(0, np.int64)


def fingerprint(signatures: np.ndarray) -> str:
    """The sorted signatures, most significant digit first."""
    digits = [(signatures >> (6 * (_CHARS - 1 - k))) & 63 for k in range(_CHARS)]
    return _DIGITS[np.stack(digits, 1).ravel()].tobytes().decode() if len(signatures) else ""


def signatures_of(written: str) -> np.ndarray:
    """The set that a fingerprint writes."""
    digits = _VALUES[np.frombuffer(written.encode(), np.uint8)].reshape(-1, _CHARS)
    return (digits << np.arange(6 * (_CHARS - 1), -1, -6)).sum(1)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0, block: int = 256) -> float:
    """Jaccard similarity of two sorted sets, exact if it is `least` or more, else 0; two empty sets are alike.

    Sets whose lengths alone rule it out aren't compared; others are merged in blocks until the rest can't reach `least`.
    """
    if not len(a) and not len(b):
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) < least * len(long):
        return 0.0
    common = 0
    for at in range(0, len(short), block):
        part = short[at : at + block]
        where = np.minimum(np.searchsorted(long, part), max(len(long) - 1, 0))
        common += int((long[where] == part).sum())
        most = common + len(short) - min(at + block, len(short))
        if most < least * (len(a) + len(b) - most):
            return 0.0
    value = common / (len(a) + len(b) - common)
    return value if value >= least else 0.0


def edited(text: str, following: str) -> str:
    """`text` with its last quarter (rounded down) replaced by the first as many code points, or all, of `following`."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, guest, id, text), each part sorted by id and followed by the first row of the next part (guest = 1).

    Parts are ranges of ids between approximate quantiles; a quantile is an id of the table, so its row is the first of its part and
    is sent to the part before as well. The first row of all follows the last part. Null ids come first.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select(key.alias("key")).agg(F.min("key"), F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 20_000)).first()
    bounds = np.array(sorted({cuts[0], *(cuts[1] or [])}) if cuts[0] is not None else [0], np.int64)  # one number per part

    @F.arrow_udf("array<int>")
    def parts(keys: pa.Array) -> pa.Array:
        values = keys.to_numpy()
        part = np.searchsorted(bounds, values, "right") - 1
        starts = bounds[part] == values
        return pa.array([[p, (p - 1) % len(bounds)] if s else [p] for p, s in zip(part.tolist(), starts.tolist())], pa.list_(pa.int32()))

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), parts(key).alias("parts"))
    dealt = rows.select("id", "text", F.posexplode("parts").alias("guest", "part"))
    return dealt.repartitionByRange(n, "part").sortWithinPartitions("part", "guest", "id", "text").select("part", "guest", "id", "text")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_at_once: int = 500_000) -> DataFrame:
    """One row per row of `docs`: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by (id, text), null ids first, and the first row after the last; a table of one row is followed
    by that row. The edited text is `edited(text, next text)`. near_edited and near_next are the likeness of the text's fingerprint
    to those of the edited text and of the next document. Null counts as empty. Other columns aren't read; an empty table gives no
    rows.
    """
    ship_code(docs.sparkSession)

    def measured(run: list[tuple[object, str, str]]) -> pa.RecordBatch:
        changed = [edited(t, f) for _, t, f in run]
        own = list(signature_sets([t for _, t, _ in run]))
        # the next document's set is the next row's own but at the end of a run
        follow = [own[i + 1] if i + 1 < len(run) and run[i + 1][1] is f else next(signature_sets([f])) for i, (_, _, f) in enumerate(run)]
        new = list(signature_sets(changed))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in run], pa.int64()), pa.array([len(r[1]) for r in run], pa.int64()),
                pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                pa.array(list(map(fingerprint, own)), pa.string()), pa.array(list(map(fingerprint, new)), pa.string()),
                pa.array(list(map(likeness, own, new)), pa.float64()), pa.array(list(map(likeness, own, follow)), pa.float64()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, size, before = [], 0, None
        for batch in small_batches(batches):
            for part, guest, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                if before is not None and before[0] == part:
                    run.append((before[1], before[2], text))
                    size += len(before[2])
                    before = None
                if not guest:
                    before = (part, id_, text)
                if size >= chars_at_once:
                    yield measured(run)
                    run, size = [], 0
        if run:
            yield measured(run)

    columns = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs, id_col, text_col).mapInArrow(walk, columns).withColumnRenamed("id", id_col)


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    return (s.view(np.uint64) for s in signature_sets(texts))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_hundred: int = 80) -> DataFrame:
    """One row per row of `docs`: id_col, n_signatures, component_id (the smallest id reachable by links, itself included).

    Two texts are linked if 100 * intersection >= per_hundred * union of their signatures. Null and empty texts have no signature and no
    links, a row with a null id has component_id null; repeated rows share a component. Other columns aren't read; an empty table gives
    no rows. Groups of thousands of near texts don't become all pairs: see `ngram_join`.
    """
    join = NgramJoin(docs, id_col=id_col, text_col=text_col, per_hundred=per_hundred, orders=1, make=_sets, ranges=True)
    return join.components().select(F.col("id").alias(id_col), F.col("n").alias("n_signatures"), F.col("component").alias("component_id"))
