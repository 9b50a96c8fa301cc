"""Exact deduplication, the n-gram join and line deduplication, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from cases import DOC, edge_docs, edge_rows, no_docs, prose, with_clashes
from oracle import same
from pyspark.sql import functions as F

from dimstar.llm import components, exact_dedup, line_dedup, ngram_join, queries, skew, spotsigs


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(name, spark, sf):
    same(queries.QUERIES[name], queries.SQL[name], spark, sf)


def equal_texts(rows, pick) -> Counter:
    ids = defaultdict(list)
    for r in rows:
        ids[r[1] or ""].append(r[0])
    out = Counter()
    for r in rows:
        group = ids[r[1] or ""]
        keep = pick((i for i in group if i is not None), default=None)
        out[r[0], keep, len(group), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1), lambda t: F.lit("same")])
def test_exact_groups(spark, keep, digest):
    """Also with digests that many texts share: contents decide."""
    more = {"digest": digest} if digest else {}
    found = exact_dedup.exact_groups(edge_docs(spark), keep=keep, **more)
    assert rows_of(found) == equal_texts(edge_rows(), max if keep == "largest" else min)


def test_exact_groups_of_one_hot_text(spark):
    rows = [(i, "same" if i % 3 else f"t{i % 11}") for i in range(900)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), salts=4)
    assert rows_of(found) == equal_texts(rows, max)


def test_exact_dedup_keeps_columns_and_takes_empty_tables(spark):
    docs = edge_docs(spark)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    wanted = {k[0] for k in equal_texts(edge_rows(), max) if k[3]}
    assert sorted(r.doc_id for r in left.collect()) == sorted(wanted)
    assert exact_dedup.exact_groups(no_docs(spark)).count() == 0
    assert exact_dedup.drop_exact_copies(no_docs(spark)).count() == 0


def test_one_row_of_each_text_stays(spark):
    """Null ids, repeated rows, one id with several texts, and a hot repeated row."""
    rows = [(None, "a"), (None, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b"), (None, None), (3, ""), (2, "c"), (9, "c")] + [(7, "hot")] * 500
    docs = spark.createDataFrame([(*r, "s", None) for r in rows], DOC).repartition(5)
    left = exact_dedup.drop_exact_copies(docs)
    assert sorted((r.text or "", r.doc_id) for r in left.collect()) == [("", 3), ("a", 2), ("b", None), ("c", 9), ("hot", 7)]
    again = ngram_join.keep_one_per_component(docs.filter("text is not null"))
    assert sorted(((r.text, r.doc_id) for r in again.collect()), key=repr) == [("", 3), ("a", 1), ("b", None), ("c", 2), ("hot", 7)] and again.columns == docs.columns


def test_near_copies_without_ids(spark):
    base = prose(120, 3).split()
    near = [" ".join([*base[: len(base) - k], *["z"] * k]) for k in range(3)]
    rows = [(None, near[0]), (4, near[1]), (3, near[2]), (3, near[2]), (None, prose(50, 8)), (None, prose(50, 8)), (5, "")]
    left = ngram_join.keep_one_per_component(spark.createDataFrame([(*r, None, None) for r in rows], DOC)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted([(3, near[2]), (None, prose(50, 8)), (5, "")], key=repr)


def plain_near_classes(rows, per_hundred):
    sets = [(r[0], frozenset(s.tolist())) for r, s in zip(rows, spotsigs.signature_sets([r[1] for r in rows]))]
    return classes_of(sets, per_hundred)


@pytest.mark.parametrize("per_hundred", [80])
def test_near_classes_against_all_pairs(spark, per_hundred):
    """Groups of near copies of many lengths, so that linked sets are in one range of lengths and in neighbours."""
    rows, words = [], prose(900, 5).split()
    for k in range(60):
        part = words[k * 3 : k * 3 + 40 * (k % 20 + 1)]
        rows += [(10 * k + j, " ".join([*part[: len(part) - j * len(part) // 12], *(f"tail{k} the {j} more" for _ in range(j))]), None, None) for j in range(4)]
    rows += [(r[0] + 5000 if r[0] else None, *r[1:]) for r in edge_rows()]
    docs = with_clashes(spark.createDataFrame(rows, DOC))
    found = spotsigs.near_classes(docs, per_hundred=per_hundred)
    assert rows_of(found) == plain_near_classes(rows, per_hundred)
    assert spotsigs.near_classes(no_docs(spark)).count() == 0
    if per_hundred == 80:
        assert any(a != c for a, _, c in plain_near_classes(rows, 80))


def test_lengths_and_rare_signatures_leave_few_pairs(spark):
    """Sets of all lengths share one signature: pairs that are compared stay far below all."""
    rows = [(k, f"the shared words {prose(20 + 6 * k, 100 + k, 3000)}", None, None) for k in range(200)]
    join = ngram_join.NgramJoin(spark.createDataFrame(rows, DOC), orders=1, make=spotsigs._sets, ranges=True)
    compared = []
    verified = join._verified
    join._verified = lambda pairs: (compared.append(pairs.count()), verified(pairs))[1]
    assert join.components().count() == 200 and sum(compared) < 200


def shingles(text, n) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def linked_classes(rows, n, per_hundred) -> Counter:
    return classes_of([(r[0], shingles(r[1], n)) for r in rows], per_hundred)


def classes_of(sets, per_hundred) -> Counter:
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [(i, s) for i, s in sets if i is not None and s]
    for k, (a, x) in enumerate(ids):
        for b, y in ids[:k]:
            both = len(x & y)
            if 100 * both >= per_hundred * (len(x) + len(y) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("n,per_hundred", [(3, 90), (5, 80)])
def test_ngram_join_of_edge_cases(spark, n, per_hundred):
    assert rows_of(ngram_join.ngram_components(edge_docs(spark), n=n, per_hundred=per_hundred)) == linked_classes(edge_rows(), n, per_hundred)
    assert ngram_join.ngram_components(no_docs(spark), n=n, per_hundred=per_hundred).count() == 0


@pytest.mark.parametrize("n,per_hundred,orders", [(3, 90, 1), (3, 90, 3), (5, 80, 2)])
def test_ngram_join_of_groups_and_chains(spark, n, per_hundred, orders):
    """A group of near copies, chains whose ends are far apart, texts near the threshold and common passages."""
    import random

    rng, rows = random.Random(5), []
    common = prose(60, 99)
    for seed in range(12):
        words = prose(rng.choice([12, 40, 90, 200]), seed).split()
        for _ in range(14):
            rows.append(" ".join(words))
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"z{rng.randrange(1000)}"
    rows += [f"{common} {prose(30, 200 + i)}" for i in range(20)] + [f"{common} {prose(3, 300 + i)}" for i in range(20)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, per_hundred=per_hundred, orders=orders)
    assert rows_of(found) == linked_classes(rows, n, per_hundred)


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    """The Thue-Morse word and its complement collide in every polynomial hash modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    short = [("abcdefgh" * 3, "abcdefgh" * 4), ("abcdefghi", "abcdefgh i"), ("x" * 64, "x" * 65)]
    rows = list(enumerate(t for pair in [(f"{word} {word} {word}", f"{other} {other} {other}"), *short] for t in pair))
    assert rows_of(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, per_hundred=90)) == linked_classes(rows, 3, 90)


@pytest.mark.parametrize("per_hundred", [50, 80, 90, 97])
def test_longer_prefixes_share_enough(per_hundred):
    """Of near sets, each longer prefix holds at least least_shared tokens of the other's, under any order."""
    import random

    rng, met = random.Random(per_hundred), 0
    for _ in range(4000):
        n = rng.randrange(1, 60)
        a = set(rng.sample(range(70), n))
        b = set(a)
        for _ in range(rng.randrange(0, 2 + n * (100 - per_hundred) // 100)):
            (b.discard if rng.random() < 0.5 else b.add)(rng.randrange(70))
        if not b or 100 * len(a & b) < per_hundred * len(a | b):
            continue
        met += 1
        first = [set(sorted(s)[: ngram_join.longer_prefix(len(s), per_hundred)]) for s in (a, b)]
        assert len(first[0] & first[1]) >= max(ngram_join.least_shared(len(s), per_hundred) for s in (a, b))
    assert met > 500


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 4)
    rows = [(i, None if i % 50 == 0 else 7 if i % 3 else i) for i in range(200)]
    left = spark.createDataFrame(rows, "a long, key long")
    right = spark.createDataFrame([(k, f"v{k}") for k in (7, 9, 12, 500)], "key long, v string")
    for how in ("inner", "left"):
        joined = [(a, k, f"v{k}" if k in (7, 9, 12) else None) for a, k in rows]
        wanted = Counter(r for r in joined if how == "left" or r[2])
        assert rows_of(skew.split_join(left, right, "key", how).select("a", "key", "v")) == wanted
    groups = left.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = skew.attach_groups(left, groups, "key", "n", 200, hot=10)
    assert rows_of(found.select("a", "key")) == Counter(r for r in rows if r[1] is not None)


def test_blocks_of_large_buckets(spark, monkeypatch):
    """With blocks of three members, each pair still meets once."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    base = prose(60, 4).split()
    rows = [(i, " ".join([*base[: i % 30], f"new{i}", *base[i % 30 + 1 :]])) for i in range(40)]
    assert rows_of(ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=2, per_hundred=92)) == linked_classes(rows, 2, 92)


def test_op3_over_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op3_ngram_jaccard_join(spark, sf)) == linked_classes(rows, 3, 90)


def test_one_of_each_group_stays(spark):
    docs = edge_docs(spark)
    left = ngram_join.keep_one_per_component(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k[0] for k in linked_classes(edge_rows(), 5, 80) if k[0] == k[2]}
    assert ngram_join.keep_one_per_component(no_docs(spark)).count() == 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (7, 7), (None, 3)]
    found = rows_of(components.connected_components(spark.createDataFrame(links, "a long, b long")))
    assert found == Counter([(i, 0) for i in range(201)] + [(300, 300), (301, 300)])


def common_lines_gone(rows, least) -> Counter:
    sites = defaultdict(set)
    for _, text, source, _ in rows:
        for line in (text or "").split("\n"):
            if line.strip(" ") and source is not None:
                sites[line].add(source)
    out = Counter()
    for i, text, _, _ in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if len(sites[x]) < least]
        out[i, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def test_lines_of_many_sites(spark):
    assert rows_of(line_dedup.drop_common_lines(edge_docs(spark), least_sites=2)) == common_lines_gone(edge_rows(), 2)
    rows = [(i, f"all sites\nonly {i % 4}\n\nline {i % 60} of {i % 60 % 9}", f"site{i % 30}", None) for i in range(600)]
    for least in (2, 3, 10, 31):
        assert rows_of(line_dedup.drop_common_lines(spark.createDataFrame(rows, DOC), least_sites=least)) == common_lines_gone(rows, least)
    assert line_dedup.drop_common_lines(no_docs(spark)).count() == 0


def test_long_texts_of_common_lines(spark):
    """Six texts of 20,000 common lines each, some of them repeated, with lines of their own between."""
    shared = [f"shared line {k % 15_000}" for k in range(20_000)]
    rows = [(i, "\n".join(f"own {i} {k}" if k % 1000 == i else line for k, line in enumerate(shared)), f"s{i}", None) for i in range(6)]
    assert rows_of(line_dedup.drop_common_lines(spark.createDataFrame(rows, DOC), least_sites=3)) == common_lines_gone(rows, 3)


def test_lines_of_thousands_of_sites(spark):
    """On both sides of the least number of sites, within the band that is counted exactly and far from it."""
    sites = {"far below": 1500, "below": 1999, "at": 2000, "above": 2001, "far above": 3000, "one": 1}
    rows = [(i, "\n".join(x for x, n in sites.items() if i < n), f"site{i}", None) for i in range(3000)]
    found = rows_of(line_dedup.drop_common_lines(spark.createDataFrame(rows, DOC).repartition(6), least_sites=2000))
    assert found == common_lines_gone(rows, 2000)
