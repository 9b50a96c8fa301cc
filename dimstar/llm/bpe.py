"""Byte-level BPE: a vocabulary, encoding by speculation and verification, and decoding.

Speculate: each distinct word (of the vocabulary's pre-tokenizer) is cut greedily into the longest known tokens. Verify: a cut is
the BPE result exactly if every two adjacent tokens, encoded alone, stay as they are; numpy tests all distinct adjacent pairs of
a batch at once. Only words with a failing pair are merged exactly, pair by pair. Results per word are kept in a bounded table.

Many texts are worked on together: words are runs of kinds of characters in their UTF-8 bytes, numbered by Arrow's dictionary; cuts
and merges of all new words go on side by side in numpy, and digests are taken over slices of Arrow buffers. Long words go one by one.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimstar.functions.runtime import ship_code
from dimstar.llm.skew import small_batches

# Fixed value: the split pattern of byte-level pre-tokenizers with use_regex.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose ids are kept per Python worker; the table starts anew when full.
WORDS_KEPT = 500_000
#: Texts are taken together up to this many characters; a longer one is taken alone.
CHARS_AT_ONCE = 500_000
#: New words are cut and merged side by side up to this many.
WORDS_AT_ONCE = 20_000
#: Words of more bytes are cut and merged one by one: side by side, each step would go over all of their bytes.
LONG_WORD = 128

#: Kinds of characters in SPLIT.
OTHER, LETTER, NUMBER, SPACE = range(4)
_NEVER = np.iinfo(np.int64).max


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point, as the regular expressions of SPLIT have it."""
    chars = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, chars):
            found[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    return found


def word_starts(data: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 `data`: does a word of SPLIT start there? A text of its own starts at 0 and at each of `segments`."""
    kinds, n = _kinds(), len(data)
    kind = kinds[:256][data]
    leads = np.flatnonzero(data >= 0xC0)
    for at in range(0, len(leads), CHARS_AT_ONCE):
        lead = leads[at : at + CHARS_AT_ONCE]
        first, point = data[lead].astype(np.int64), np.zeros(len(lead), np.int64)
        sizes = 2 + (first >= 0xE0) + (first >= 0xF0)
        for size, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            these = sizes == size
            point[these] = first[these] & mask
        for k in (1, 2, 3):
            these = sizes > k
            point[these] = point[these] << 6 | (data[lead[these] + k] & 0x3F)
        for k in (0, 1, 2, 3):
            these = sizes > k
            kind[lead[these] + k] = kinds[point[these]]
    own = np.zeros(n + 1, bool)
    own[0], own[segments] = True, True
    start = own[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # Of blanks before something else, the last one is a word, or begins the next one if it is a space.
    after = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & ~own[1:n]) + 1
    last = after - 1
    for _ in range(3):
        last -= data[last] & 0xC0 == 0x80
    start[last] = True
    start[after[data[last] == 0x20]] = False
    # 's 't 'm 'd 're 've 'll at the start of a word.
    padded, close = np.concatenate([data, np.zeros(2, np.uint8)]), np.concatenate([own, [True]])
    quote = np.flatnonzero((data == 0x27) & start & ~own[1:])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & ~close[quote + 2]
    start[quote[short | long] + 1] = False
    end = np.concatenate([quote[short] + 2, quote[long] + 3])
    start[end[end < n]] = True
    return start


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """`array`, or a longer one that begins with it, with room for `size` values."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each `begin` on, as many as `sizes` says, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """A tokenizers JSON file of a byte-level BPE model with use_regex and no normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        byte = _byte_of_char()
        raw = lambda token: bytes(byte[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # By token: when its merge happens (-1: a single byte) and what it is merged from.
        self.turn = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        merge: dict[tuple[int, int], tuple[int, int]] = {}
        for turn, (a, b) in enumerate(pairs):
            x, y = vocab[raw(a)], vocab[raw(b)]
            made = vocab[raw(a) + raw(b)]
            merge[x, y] = (turn, made)
            self.turn[made], self.left[made], self.right[made] = turn, x, y
        self.merge = merge
        keys = np.array([x * size + y for x, y in merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_turns = keys[order], np.array([t for t, _ in merge.values()], np.int64)[order]
        self.size = size
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.first_ids, self.made = np.array(self.byte_ids), np.array([m for _, m in merge.values()], np.int64)
        self.vocab = vocab
        self._forget()

    @functools.cached_property
    def known(self) -> dict[bytes, int]:
        """Tokens that can be part of a result: those that their own bytes merge to."""
        tokens = list(self.vocab)
        data, begin, end, cut = self._laid_out(tokens)
        short = end - begin <= LONG_WORD
        self._merge(data, begin[short], end[short], cut)
        alone = cut[begin] == np.fromiter(self.vocab.values(), np.int64, len(tokens))
        return {t: self.vocab[t] for t, same, few in zip(tokens, alone, short) if (same if few else self.merged(t) == (self.vocab[t],))}

    @functools.cached_property
    def lengths(self) -> dict[bytes, list[int]]:
        """By a word's next two bytes: the lengths of the tokens that begin with them, longest first."""
        lengths: dict[bytes, set[int]] = {}
        for token in self.known:
            lengths.setdefault(token[:2], set()).add(len(token))
        return {begin: sorted(there, reverse=True) for begin, there in lengths.items()}

    @functools.cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The beginnings of known tokens; nodes 0 to 255 are the single bytes. Steps (node * 256 + next byte, sorted), the nodes they
        lead to, and each node's token (-1: none)."""
        nodes = {bytes([b]): b for b in range(256)}
        steps = []
        for token in self.known:
            for k in range(2, len(token) + 1):
                if (begins := token[:k]) not in nodes:
                    nodes[begins] = len(nodes)
                    steps.append((nodes[token[: k - 1]] * 256 + token[k - 1], nodes[begins]))
        keys, to = np.array(sorted(steps), np.int64).reshape(-1, 2).T.copy()
        return keys, to, np.fromiter((self.known.get(n, -1) for n in nodes), np.int64, len(nodes))

    @functools.cached_property
    def decimals(self) -> pa.Array:
        return pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())

    @functools.cached_property
    def spelled(self) -> pa.Array:
        return pa.array(self.bytes_of, pa.large_binary())

    def _forget(self) -> None:
        """The table of words as it begins: special tokens only. Word k has the ids from first[k] to first[k + 1] of `flat`."""
        self.ids = {s.encode(): k for k, s in enumerate(self.special)}
        self.flat, self.first = np.array(list(self.special.values()), np.int32), np.arange(len(self.special) + 1)

    def merged(self, word: bytes) -> tuple[int, ...]:
        """Exact BPE of one word: the earliest merge first, leftmost among equals."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 200:
            return self._merged_long(ids)
        merge, never = self.merge, (1 << 60, -1)
        found = [merge.get(p, never) for p in zip(ids, ids[1:])]
        while found:
            first = min(found)
            if first is never:
                break
            at = found.index(first)
            ids[at : at + 2] = [first[1]]
            del found[at]
            if at:
                found[at - 1] = merge.get((ids[at - 1], ids[at]), never)
            if at < len(found):
                found[at] = merge.get((ids[at], ids[at + 1]), never)
        return tuple(ids)

    def _merged_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap of pairs over a linked list, for words where scanning all pairs each time would be slow."""
        merge, n = self.merge, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*merge[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in merge]
        heap = [(turn, i, made, p) for turn, made, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in merge:
                    turn, new = merge[p]
                    heapq.heappush(heap, (turn, x, new, p))
        return tuple(i for i in ids if i >= 0)

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n = [], 0, len(word)
        known, lengths = self.known, self.lengths
        while at < n:
            token = size = None
            for size in lengths.get(word[at : at + 2], ()):
                if at + size <= n and (token := known.get(word[at : at + size])) is not None:
                    break
            if token is None:
                token, size = known[word[at : at + 1]], 1
            out.append(token)
            at += size
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: does no merge ever join the end of token a to the start of token b?

        Going back in time, the last token at the end of a is a itself, then what a's last merge took on its right, and so on;
        likewise the start of b. Two such tokens that stood side by side would have merged if their merge's turn came before the
        merge that replaced one of them; at equal turns, the left one of two equal pairs goes first.
        """
        a, b = a.copy(), b.copy()
        fine = np.ones(len(a), bool)
        until = np.full(len(a), np.iinfo(np.int64).max)  # the pair stood until this turn; a merge of the pair has to be earlier
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            broken = (self.pair_keys[at] == key) & (self.pair_turns[at] < until[live])
            fine[live[broken]] = False
            live, x, y = live[~broken], x[~broken], y[~broken]
            back_a = self.turn[x] > self.turn[y]  # of two equal tokens, the right one is the later
            a[live[back_a]] = self.right[x[back_a]]
            b[live[~back_a]] = self.left[y[~back_a]]
            until[live] = np.where(back_a, self.turn[x], self.turn[y] + 1)
            live = live[np.maximum(self.turn[x], self.turn[y]) >= 0]
        return fine

    @staticmethod
    def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of the words, where each begins and ends, and a place per byte for the id of the token that begins there (-1: none)."""
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        data = np.frombuffer(b"".join(words), np.uint8)
        return data, np.concatenate([[0], end[:-1]]), end, np.full(len(data), -1, np.int64)

    def _propose(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, cut: np.ndarray) -> None:
        """Greedy longest match from the left in the words from `begin` to `end`: in each step, the next token of each word."""
        steps, step_to, token_at = self.tree
        at, stop = begin, end
        while len(at):
            best = self.first_ids[data[at]]
            live, node, depth = np.arange(len(at)), data[at].astype(np.int64), 1
            while len(live):
                inside = at[live] + depth < stop[live]
                live = live[inside]
                key = node[inside] * 256 + data[at[live] + depth]
                step = np.minimum(np.searchsorted(steps, key), len(steps) - 1)
                hit = steps[step] == key
                live, node = live[hit], step_to[step[hit]]
                token = token_at[node]
                best[live[token >= 0]] = token[token >= 0]
                depth += 1
            cut[at] = best
            at = at + self.sizes[best]
            at, stop = at[at < stop], stop[at < stop]

    def _merge(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, cut: np.ndarray) -> None:
        """Exact BPE of the words from `begin` to `end`: in each step, each word's earliest merge, leftmost among equals."""
        place = _ranges(begin, end - begin)
        word = np.repeat(np.arange(len(begin)), end - begin)
        cut[place] = -1
        ids = self.first_ids[data[place]]
        turn = self._turns(ids, word, np.arange(len(ids)))
        while len(ids):
            new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least, sizes = np.minimum.reduceat(turn, new), np.diff(new, append=len(ids))
            at = np.flatnonzero(turn == np.repeat(least, sizes))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            done = least == _NEVER
            over = np.repeat(done, sizes)
            cut[place[over]] = ids[over]
            keep, at = ~over, at[~done]
            ids[at] = self.made[turn[at]]
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            ids, word, place, turn = ids[keep], word[keep], place[keep], turn[keep]
            for changed in (at[at > 0] - 1, at):
                turn[changed] = self._turns(ids, word, changed)

    def _turns(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """When the tokens at `at` and after it in the same word merge."""
        after = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] * self.size + ids[after]
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[found] == key) & (word[at] == word[after]) & (after > at), self.pair_turns[found], _NEVER)

    def learn(self, words: list[bytes]) -> None:
        """Put the ids of `words`, none of which is there yet, into the table."""
        data, begin, end, cut = self._laid_out(words)
        short = end - begin <= LONG_WORD

        def put(i: int, tokens) -> None:
            cut[begin[i] : end[i]] = -1
            sizes = self.sizes[list(tokens)]
            cut[begin[i] + np.cumsum(sizes) - sizes] = tokens

        self._propose(data, begin[short], end[short], cut)
        for i in np.flatnonzero(~short).tolist():
            put(i, self.proposed(words[i]))
        at = np.flatnonzero(cut >= 0)
        flat, owner = cut[at], np.searchsorted(end, at, "right")
        inside = owner[1:] == owner[:-1]
        pairs = (flat[:-1] * self.size + flat[1:])[inside]
        distinct, which = np.unique(pairs, return_inverse=True)
        ok = self.compatible(distinct // self.size, distinct % self.size)
        failing = np.zeros(len(words), bool)
        failing[owner[1:][inside][~ok[which]]] = True
        self._merge(data, begin[failing & short], end[failing & short], cut)
        for i in np.flatnonzero(failing & ~short).tolist():
            put(i, self.merged(words[i]))
        at = np.flatnonzero(cut >= 0)
        have, used = len(self.ids), int(self.first[len(self.ids)])
        self.flat, self.first = _room(self.flat, used + len(at)), _room(self.first, have + len(words) + 1)
        self.flat[used : used + len(at)] = cut[at]
        self.first[have + 1 : have + len(words) + 1] = used + np.searchsorted(at, end)
        self.ids.update(zip(words, range(have, have + len(words))))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the strings of special tokens become these tokens, no other special tokens are added."""
        for ids, ends in self.encode_together(texts):
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                yield ids[a:b].tolist()

    def encode_together(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the next texts one after another, and where those of each of these texts end."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
                chars += len(texts[end])
                end += 1
            yield self._encode_some(texts[at:end])
            at = end

    def _encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._parts(t) for t in texts]
        raw = [p.encode() for text in parts for p in text]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        text_ends = ends[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) - 1]
        if not ends[-1]:
            return np.zeros(0, np.int32), text_ends
        data = b"".join(raw)
        start = word_starts(np.frombuffer(data, np.uint8), ends[:-1])
        if len(parts) < len(raw):
            for i, part in enumerate(p for text in parts for p in text):
                if part in self.special:
                    start[ends[i] - len(raw[i]) + 1 : ends[i]] = False
        begins = np.flatnonzero(start)
        places = np.append(begins, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.ids]
        if new:
            if len(self.ids) + len(new) > WORDS_KEPT:
                self._forget()
                new = [w for w in distinct if w not in self.ids]
            for k in range(0, len(new), WORDS_AT_ONCE):
                self.learn(new[k : k + WORDS_AT_ONCE])
        number = np.fromiter(map(self.ids.__getitem__, distinct), np.int64, len(distinct))[words.indices.to_numpy()]
        first = self.first[number]
        sizes = self.first[number + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[_ranges(first, sizes)], upto[np.searchsorted(begins, text_ends)]

    def _parts(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text]
        return regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text)

    def decode(self, ids: list[int]) -> str:
        """Text of the tokens' bytes, special tokens as their strings; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, ids array<int>. Null and empty texts have no ids; other columns aren't read."""
    return _per_text(docs, vocabulary_path, id_col, text_col, "ids array<int>", _lists)


def decode_ids(encoded: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the decoded text of each row of ids (null: none)."""
    spark = encoded.sparkSession
    ship_code(spark)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        table = vocabulary(vocabulary_path)
        return pa.array([table.decode(x or []) for x in ids.to_pylist()], pa.string())

    return encoded.select(id_col, decode(F.col(ids_col)).alias("text"))


def encoding_digests(docs: DataFrame, vocabulary_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_tokens, ids_sha256 and decoded_sha256, without moving ids out of the task.

    Null counts as empty: no tokens, and the digests of the empty string. Repeated rows and null ids are encoded like any other.
    """
    return _per_text(docs, vocabulary_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _lists(v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))]


def _digests(v: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Number of tokens, digest of the ids and of the decoded text; Arrow puts each token's digits and bytes one after another."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    edges = np.concatenate([[0], ends])

    def slices(of_token: pa.Array) -> Iterator[memoryview]:
        taken = of_token.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[edges + taken.offset].tolist() if len(ids) else [0] * len(edges)
        data = memoryview(data or b"")
        return (data[a:b] for a, b in zip(at, at[1:]))

    numbers = [sha(x[:-1]) for x in slices(v.decimals)]
    decoded = [sha(str(x, "utf-8", "replace").encode()) for x in slices(v.spelled)]
    return [pa.array(np.diff(edges), pa.int64()), pa.array(numbers, pa.string()), pa.array(decoded, pa.string())]


def _per_text(docs, path, id_col, text_col, columns, make) -> DataFrame:
    spark = docs.sparkSession
    ship_code(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        for batch in small_batches(batches):
            at = 0
            for ids, ends in table.encode_together([t or "" for t in batch.column(1).to_pylist()]):
                arrays = [batch.column(0).slice(at, len(ends)), *make(table, ids, ends)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", *(c.split()[0] for c in columns.split(", "))])
                at += len(ends)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, {columns}").withColumnRenamed("id", id_col)
