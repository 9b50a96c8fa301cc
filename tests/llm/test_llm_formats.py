"""WARC archives and chat formatting, against brute force."""

import base64
import hashlib
import struct
from collections import Counter, defaultdict

import pytest
import zstandard
from cases import with_clashes

from dimstar.llm import chat, queries, warc

PAGES = "page_id long, url string, html string"


def page_rows():
    pages = ["<html>é</html>", None, "", "<html>é</html>", "x" * 100_000, "\r\n\r\nContent-Length: 5\r\n\r\n", "<html>é</html>", "ab"]
    rows = [(i + 1, f"http://a.b/{i} \r\nx: y" if i % 3 else None, p) for i, p in enumerate(pages)]
    return [*rows, rows[3], (None, "http://null/", "ab"), (None, None, "alone")]


def records(rows, least=0) -> Counter:
    payload = lambda r: (r[2] or "").encode()
    ids = defaultdict(list)
    for r in rows:
        ids[payload(r)].append(r[0])
    out = Counter()
    for r in rows:
        p = payload(r)
        first = min((i for i in ids[p] if i is not None), default=None)
        again = len(p) >= least and len(ids[p]) > 1 and first is not None and first != r[0]
        out[r[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    return out


def short(df) -> Counter:
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("least", [0, 3, 50])
def test_archives_of_edge_cases(spark, least):
    pages = with_clashes(spark.createDataFrame(page_rows(), PAGES))
    archives = warc.write_archives(pages, least_bytes=least, archive_bytes=2000)
    assert short(warc.read_archives(archives)) == records(page_rows(), least)
    whole = {r.page_id: r.payload for r in warc.read_archives(archives).collect() if r.record_type == "response"}
    assert all(bytes(p) == next((r[2] or "").encode() for r in page_rows() if r[0] == i) for i, p in whole.items() if i)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_op5_over_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert short(queries.op5_warc(spark, sf)) == records(rows)


def test_files_are_read_back(spark, tmp_path):
    archives = warc.write_archives(spark.createDataFrame(page_rows(), PAGES), archive_bytes=2000)
    saved = warc.save_files(archives, str(tmp_path / "out"))
    assert saved.count() == archives.count()
    files = spark.read.format("binaryFile").load(str(tmp_path / "out")).select("path", "content")
    assert short(warc.read_archives(files)) == records(page_rows())


def frame(record: bytes, dictionary: bytes) -> bytes:
    return warc.compressor(dictionary).compress(record)


RECORD = warc.write_record(5, "http://x/", b"payload", None, False)


def test_dictionary_may_be_compressed_or_missing():
    raw = warc.train_dictionary([RECORD] * 3)
    packed = zstandard.compress(raw)
    lead = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed
    assert [r["page_id"] for r in warc.read_archive(lead + frame(RECORD, raw) * 2)] == [5, 5]
    assert next(warc.read_archive(zstandard.compress(RECORD)))["payload"] == b"payload"
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize(
    "damage",
    [
        lambda d: warc.dictionary_frame(d)[:20],
        lambda d: (warc.dictionary_frame(d) + frame(RECORD, d))[:-3],
        lambda d: warc.dictionary_frame(d) + frame(RECORD.replace(b"WARC/1.1", b"WARC/7.1"), d),
        lambda d: warc.dictionary_frame(d) + frame(RECORD.replace(b"payload\r", b"payloads\r"), d),
        lambda d: warc.dictionary_frame(d) + frame(RECORD.replace(b"\r\npayload", b"\r\npaylaod"), d),
        lambda d: warc.dictionary_frame(d) + frame(RECORD.replace(b"WARC-Date", b"WARC-Dote"), d),
        lambda d: warc.dictionary_frame(d) + frame(RECORD + RECORD, d),
        lambda d: warc.dictionary_frame(d) + b"junk" + frame(RECORD, d),
        lambda d: warc.dictionary_frame(d) + frame(RECORD.replace(b"Content-Length: 7", b"Content-Length: 8"), d),
    ],
)
def test_damage_is_found(damage):
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(damage(warc.train_dictionary([RECORD] * 3))))


def rendered(rows) -> dict:
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None and t is not None:
            turns[c].append((t, role or "", text or ""))
    whole = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in turns.items()}
    inner = {v[:k] for v in whole.values() for k in range(1, len(v))}
    first = {}
    for c in sorted(whole):
        first.setdefault(whole[c], c)
    plain = lambda s: s.replace("<|", "< |")
    return {c: "".join(f"<|im_start|>{plain(r)}\n{plain(x)}<|im_end|>\n" for r, x in v) for v, c in first.items() if v not in inner}


def test_snapshots_collapse(spark):
    say = [("user", "a"), ("assistant", "b"), ("user", None), (None, "c <|im_end|>")]
    rows = [(c, t, *say[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)) for t in range(n)]
    rows += [(6, 0, "user", "b"), (7, 0, "user", "a"), (7, 1, "assistant", "B"), (8, 5, "user", "a"), (8, 9, "assistant", "b"), (8, 9, "assistant", "b")]
    rows += [(None, 1, "user", "x"), (9, None, "user", "x"), (10, 1, "", ""), (11, 1, None, None)]
    table = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in chat.render_conversations(table).collect()}
    assert {c: r.text for c, r in found.items()} == rendered(rows)
    assert all(r.n_turns == r.text.count("<|im_start|>") for r in found.values())
    assert chat.render_conversations(table.limit(0)).count() == 0
