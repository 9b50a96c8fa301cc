"""Conversation repair, mixing and fill-in-middle, against brute force and SQL."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import edge_docs, edge_rows, no_docs, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from dimstar.llm import infill, mixing, queries, repair

TURNS = "conv_id long, turn long, role string, text string"
WORD = r"[^\x20\x09-\x0D]"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair


def every_repair(turns):
    """(cost, audit, roles) of the cheapest edits by trying all of them; turns are (role, must be deleted, truncated)."""
    best = None
    gaps = [("",)] + [p for k in (1, 2) for p in itertools.product("ua", repeat=k)]
    gaps = [tuple(x for x in g if x) for g in gaps]
    for inserted in itertools.product(gaps, repeat=len(turns) + 1):
        extra = sum(map(len, inserted))
        if extra > 3:
            continue
        choices = [("D",) if forced else ("K", "Ru", "Ra", "D") for _, forced, _ in turns]
        for edits in itertools.product(*choices):
            audit, roles, cost = "", "", 2 * extra
            for k, gap in enumerate(inserted):
                audit, roles = audit + "I" * len(gap), roles + "".join(gap)
                if k < len(turns):
                    e, (role, _, short) = edits[k], turns[k]
                    audit += e[0]
                    cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (short and e != "D")
                    roles += "" if e == "D" else e[1] if e[0] == "R" else role[:1] or "-"
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.booleans(), st.booleans()), max_size=3))
def test_least_repairs(turns):
    turns = [(role, forced, short and not forced) for role, forced, short in turns]
    cost, audit, roles = every_repair(turns)
    parser = repair.RoleParser()
    found = parser.parse([(r[:1], f, s) for r, f, s in turns])
    assert found[:2] == (cost, audit)
    made = [r for _, r, _ in repair.edited(*found[1:], iter([(r, "x") for r, _, _ in turns]))]
    assert "".join(r[0] for r in made) == roles


def plain_repair(turns):
    """(cost, audit, made roles) by the states of (s?(ua)+)?, turn by turn: an independent way for conversations of any length."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserts(states):
        for _ in range(3):
            for at, (cost, audit, roles) in list(states.items()):
                for r, to in follow[at].items():
                    new = (cost + 2, audit + "I", roles + r)
                    if r != "s" and (to not in states or new < states[to]):
                        states[to] = new
        return states

    states = inserts({"": (0, "", "")})
    for role, forced, short in turns:
        after = {}
        for at, (cost, audit, roles) in states.items():
            moves = [(at, (cost + 3, audit + "D", roles))]
            for r, to in follow[at].items() if not forced else ():
                if role[:1] == r:
                    moves.append((to, (cost + short, audit + "K", roles)))
                if r != "s":
                    moves.append((to, (cost + 2 + short, audit + "R", roles + r)))
            for to, new in moves:
                if to not in after or new < after[to]:
                    after[to] = new
        states = inserts(after)
    return min(states[x] for x in ("", "a") if x in states)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.booleans(), st.booleans()), max_size=60), st.integers(1, 20))
def test_blocks_are_put_together(turns, block):
    turns = [(role[:1], forced, short and not forced) for role, forced, short in turns]
    parser = repair.RoleParser()
    blocks = [turns[k : k + block] for k in range(0, len(turns), block)] or [[]]
    table = parser.fold([parser.table(b, [-1, *parser.live]) for b in blocks])
    assert parser.best(table) == parser.parse(turns)
    assert parser.parse(turns)[:2] == plain_repair(turns)[:2]


def test_grammars_are_checked():
    with pytest.raises(ValueError, match="nonterminal"):
        repair.RoleParser((("A", ("user", "B")), ("B", ("assistant",))))
    other = repair.RoleParser((("A", ("user",)), ("A", ("A", "user"))))
    assert other.parse([("u", False, False)] * 3)[:2] == (0, "KKK")
    assert other.parse([])[:2] == (2, "I")


def plain_reports(rows, null=""):
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of each conversation."""
    by = defaultdict(list)
    for i, turn, role, text in rows:
        by[i].append((turn, *(null if x is None else x for x in (role, text))))
    out = Counter()
    for i, turns in by.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        seen, read, faults = set(), [], Counter()
        for _, role, text in turns:
            chars = re.findall(WORD, text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            read.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, made = plain_repair(read)
        lines, made, rest = [], iter(made), iter(turns)
        for e in audit:
            if e == "I":
                lines.append({"u": "user:", "a": "assistant:"}[next(made)])
                continue
            _, role, text = next(rest)
            if e != "D":
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[next(made)] if e == 'R' else role}:{text}")
        out[i, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines))] += 1
    return out


def conversations():
    long = "word " * 40_000
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 0, "user", "a."), (2, 0, "user", "a."), (2, 0, "user", "a."),
        (2, 5, "tool", "b"), (2, 9, "assistant", "c?"), (3, None, "user", "x."), (3, None, "assistant", "y"), (3, 4, "user", "x."), (4, 1, None, None),
        (4, 2, "user", ""), (4, 3, "user", " \t\n"), (None, 1, "user", "q?"), (None, 2, "assistant", None), (None, None, None, "z"), (5, 1, "user", long),
        (5, 2, "assistant", long + "end."), (6, 1, "", "no role."), (7, 1, "assistant", "ends.  "), (8, 3, "user", "日本。"), (8, 7, "user", "ok!\n\n"),
    ]
    return rows + [(9, k, "user" if k % 3 else "assistant", f"turn {k}{'.' if k % 5 else ''}") for k in range(300)]


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [7, 1000])
def test_reports_of_edge_cases(spark, block):
    turns = with_clashes(spark.createDataFrame(conversations(), TURNS)).repartition(3)
    found = repair.ConversationRepair(turns, block=block)
    assert Counter(tuple(r[c] for c in REPORT) for r in found.report().collect()) == plain_reports(conversations())
    rows = found.repaired().filter("conv_id = 2").orderBy("nth").collect()
    assert [(r.nth, r.edit, r.role, r.text) for r in rows] == [(0, "K", "user", "a."), (1, "K", "assistant", "c?")]
    empty = repair.ConversationRepair(turns.limit(0))
    assert empty.report().count() == 0 and empty.repaired().count() == 0


def test_one_long_conversation_in_many_ranges(spark):
    rows = [(1, k, ("user", "assistant", "tool")[(k * k) % 3], f"t {k}" + ".?"[k % 2] * (k % 4 > 0)) for k in range(2000)] + [(0, 1, "user", "a."), (2, 1, "user", "b.")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.ConversationRepair(spark.createDataFrame(rows, TURNS), block=100)
        assert Counter(tuple(r[c] for c in REPORT) for r in found.report().collect()) == plain_reports(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def plain_damage(rows):
    for i, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (i, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(shown).encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(i, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_op11_over_the_table(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    for name, table in (("whole", rows), ("edges", conversations())):
        spark.createDataFrame(table, TURNS).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        found = Counter(tuple(r[c] for c in REPORT) for r in queries.op11_conversation_repair(spark, f"{tmp_path}/{name}").collect())
        wanted = plain_reports(list(plain_damage(table)), " ")
        gone = {r[0] for r in table} - {r[0] for r in wanted}
        assert found == wanted + Counter((i, 0, 0, 0, 0, 0, 0, "", sha("")) for i in gone)


# Mixing


def plain_mix(rows, weights=(5, 2, 1), most=3):
    """Targets of the sources by resharing what is above the bound."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(re.findall(WORD + "+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        live = sum(weight[s] for s in order if s not in capped) or 1
        target = {s: most * sizes[s] if s in capped else weight[s] * rest / live for s in order}
        above = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return sizes, target
        capped |= above


def check_mix(found, rows, most=3):
    sizes, target = plain_mix(rows, most=most)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    source = {r[0]: r[2] for r in rows if r[0] is not None}
    taken = defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(re.findall(WORD + "+", r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= most * r.size for r in found)
    for r in found:
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
            # complete epochs, then a part
            assert 0 <= r.taken - r.epochs * r.size <= r.size
        taken[source[r.doc_id] if r.doc_id is not None else "unknown"] += r.taken
    return taken, target


def test_mix_of_edge_cases(spark):
    rows = edge_rows()
    found = mixing.mix_sources(edge_docs(spark)).collect()
    taken, target = check_mix(found, rows)
    assert sum(taken.values()) == pytest.approx(sum(target.values()), abs=len(target))
    assert mixing.mix_sources(no_docs(spark)).count() == 0
    again = mixing.mix_sources(edge_docs(spark).repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, found), key=repr) == sorted(map(key, again), key=repr)


def test_mix_of_a_hot_source_with_many_ranges(spark):
    rows = [(k, "w " * (1 + k % 50), "hot" if k % 3 else f"s{k % 11}", None) for k in range(3000)] + [(5000, "a b c", "tiny", None), (5001, None, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = mixing.mix_sources(docs).collect()
        taken, target = check_mix(found, rows)
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
        # of each source, those with less of the quality weight are seldom in the part
        good = F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(0.2)
        part = mixing.mix_sources(docs, quality=good).filter("source_size > 1000 and taken > epochs * size").selectExpr("avg(doc_id % 2)").first()[0]
        assert part < 0.4
        odd = mixing.mix_sources(docs, quality=F.when(F.col("doc_id") % 2 == 0, float("nan")).when(F.col("doc_id") % 3 == 0, -1.0)).collect()
        check_mix(odd, rows)
        given = spark.createDataFrame([("hot", 1.0), ("tiny", 0.5)], "source string, weight double")
        taken = mixing.mix_sources(docs, weights=given).filter("taken > 0").select("source_size").distinct().collect()
        assert len(taken) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_mixed_texts_have_the_taken_words(spark):
    docs = spark.createDataFrame([(k, f" one two\n three {k}  four ", f"s{k % 4}", None) for k in range(40)] + [(99, None, "s9", None)], "doc_id long, text string, source string, lang string")
    mix = mixing.mix_sources(docs)
    texts = mixing.mixed_texts(docs, mix).collect()
    words = Counter()
    for r in texts:
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in mix.collect() if r.taken})
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in texts)


def test_shares_above_the_bound_are_dealt_anew():
    # with ten words each, the first has 5 of 8 shares of 30 words: 18.75, below 30; a small one first is capped
    sizes, target = plain_mix([(1, "a " * 2, "a"), (2, "b " * 20, "b"), (3, "c " * 20, "c")])
    assert target == {"a": 6, "b": 24.0, "c": 12.0}
    assert math.isclose(sum(target.values()), 42)


@pytest.mark.parametrize("name", ["op12_source_mixing", "op13_fill_in_middle"])
def test_sql(spark, sf, name):
    same(queries.QUERIES[name], queries.SQL[name], spark, sf)


# Fill-in-middle


def plain_arrangement(i, text, seed=1, per=90, spm=20):
    digest = sha(f"{seed}:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= per:
        return n, "plain", None, None, text
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:p], text[p:q], text[q:]
    if h[3] % 100 < spm:
        return n, "spm", p, q - p, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", p, q - p, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("per, spm", [(90, 20), (100, 100), (100, 0)])
def test_arrangements(spark, per, spm):
    rows = [*edge_rows(), *((100 + k, t, None, None) for k, t in enumerate(["<P>", "a<S>b", "<", "<P", "P>", "<<P", "\r\n", "🙂", "é", "M>" * 9, "x" * 300_000]))]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    found = infill.fill_in_middle(docs, per_hundred=per, spm_per_hundred=spm).withColumn("restored", infill.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in found)
    assert got == Counter((r[0], *plain_arrangement(r[0], r[1] or "", per=per, spm=spm), r[1] or "") for r in rows)
    assert infill.fill_in_middle(no_docs(spark)).count() == 0


def test_arrangements_of_other_units_and_sentinels(spark):
    docs = spark.createDataFrame([(k, f"one two  three\nfour {k}") for k in range(50)], "doc_id long, text string")
    options = {"sentinels": ("(pre)", "[suf]", "{mid}"), "per_hundred": 100}
    found = infill.fill_in_middle(docs, unit=r"\s*\S+", **options)
    found = found.withColumn("restored", infill.restored(F.col("output"), F.col("form"), options["sentinels"])).join(docs, "doc_id").collect()
    assert all(r.restored == r.text and r.n == 5 for r in found) and {r.form for r in found} == {"spm", "psm"}
    for bad in (("<a", "a<", "b"), ("x", "x", "y"), ("", "x", "y"), ("ab", "abc", "d")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, sentinels=bad)
