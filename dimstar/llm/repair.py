"""Repair of conversation structure by error-correcting Earley parsing over a weighted grammar of roles.

The grammar is left-linear: a rule's first symbol may be a nonterminal, all others are roles. So each chart item starts at the first
turn, a chart set has at most one entry for each dotted rule, and a conversation of n turns takes about n steps. Error productions are
part of the chart: a turn is kept (its role's initial is the wanted one), given another role, or deleted, and a role that no turn
has is inserted. An item keeps its least (cost, audit, made): the edits' initials in order, and which roles were made. Two items that
cover the same turns at equal cost never have audits of which one begins the other, as the longer one would have more insertions. So
the least audit of a whole is made of least audits of its parts, and blocks of turns can be parsed apart, from each dotted rule, and
put together afterwards: one very long conversation is many tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimstar.functions.runtime import materialize, ship_code
from dimstar.llm.skew import attach_groups

# The grammar of dialogues, (s?(ua)+)? by initials, and what edits cost.
DIALOGUE = (
    ("Dialogue", ()),
    ("Dialogue", ("Pairs",)),
    ("Pairs", ("Asked", "assistant")),
    ("Asked", ("user",)),
    ("Asked", ("Opened", "user")),
    ("Asked", ("Pairs", "user")),
    ("Opened", ("system",)),
)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: Turns that are parsed at once from one dotted rule.
BLOCK = 1000

#: Cost, audit and indices of made roles; and for each item a block is entered with, those of the items it is left with.
Value = tuple[int, str, str]
Table = dict[int, dict[int, Value]]


@dataclass(frozen=True)
class RoleParser:
    """`grammar` is rules of (left side, symbols), the first left side is the start; `makes` are the roles that edits may make."""

    grammar: tuple[tuple[str, tuple[str, ...]], ...] = DIALOGUE
    makes: tuple[str, ...] = ("user", "assistant")

    def __post_init__(self):
        left = {a for a, _ in self.grammar}
        if any(s in left for _, symbols in self.grammar for s in symbols[1:]):
            raise ValueError("only the first symbol of a rule may be a nonterminal")
        items = [(rule, dot) for rule, (_, symbols) in enumerate(self.grammar) for dot in range(len(symbols) + 1)]
        number = {item: i for i, item in enumerate(items)}
        wants, after, done, waiting = [], [], [], {}
        for rule, dot in items:
            a, symbols = self.grammar[rule]
            following = symbols[dot] if dot < len(symbols) else None
            if following in left:
                waiting.setdefault(following, []).append(number[rule, dot + 1])
            wants.append(following if following not in left else None)
            after.append(number.get((rule, dot + 1)))
            done.append(a if following is None else None)
        predicted, agenda = {self.grammar[0][0]}, [self.grammar[0][0]]
        while agenda:
            a = agenda.pop()
            for b, symbols in self.grammar:
                if b == a and symbols and symbols[0] in left and symbols[0] not in predicted:
                    predicted.add(symbols[0])
                    agenda.append(symbols[0])
        start = [number[rule, 0] for rule, (a, symbols) in enumerate(self.grammar) if a in predicted and not (symbols and symbols[0] in left)]
        final = [i for i, a in enumerate(done) if a == self.grammar[0][0]]
        for name, value in {
            "wants": wants, "after": after, "done": done, "waiting": waiting, "start": start, "final": final,
            "live": [i for i, w in enumerate(wants) if w is not None or i in final],
        }.items():
            object.__setattr__(self, name, value)

    def close(self, chart: dict[int, Value]) -> dict[int, Value]:
        """Complete rules and insert roles within one chart set, until no item gets a lesser value."""
        agenda = list(chart)
        while agenda:
            i = agenda.pop()
            cost, audit, made = value = chart[i]
            if self.done[i] is not None:
                found = [(j, value) for j in self.waiting.get(self.done[i], ())]
            elif self.wants[i] in self.makes:
                found = [(self.after[i], (cost + INSERT, audit + "I", made + str(self.makes.index(self.wants[i]))))]
            else:
                continue
            for j, new in found:
                if j not in chart or new < chart[j]:
                    chart[j] = new
                    agenda.append(j)
        return chart

    def step(self, chart: dict[int, Value], initial: str, forced: bool, truncated: bool) -> dict[int, Value]:
        """The chart set after one more turn, whose role begins with `initial`; `forced` turns have to be deleted."""
        following: dict[int, Value] = {}

        def put(i: int, value: Value) -> None:
            if i not in following or value < following[i]:
                following[i] = value

        more = TRUNCATED if truncated else 0
        for i in self.live:
            if i not in chart:
                continue
            cost, audit, made = chart[i]
            put(i, (cost + DELETE, audit + "D", made))
            wanted = self.wants[i]
            if forced or wanted is None:
                continue
            if initial and initial == wanted[0]:
                put(self.after[i], (cost + KEEP + more, audit + "K", made))
            if wanted in self.makes:
                put(self.after[i], (cost + REROLE + more, audit + "R", made + str(self.makes.index(wanted))))
        return self.close(following)

    def begin(self) -> dict[int, Value]:
        return self.close({i: (0, "", "") for i in self.start})

    def table(self, turns: list[tuple[str, bool, bool]], entries: list[int] | None = None) -> Table:
        """For each item that a block of turns is entered with, the least values of the items after it; -1 enters at the start."""
        out: Table = {}
        for e in [-1] if entries is None else entries:
            chart = self.begin() if e < 0 else self.close({e: (0, "", "")})
            for turn in turns:
                chart = self.step(chart, *turn)
            out[e] = {i: v for i, v in chart.items() if i in self.live}
        return out

    @staticmethod
    def join(first: Table, second: Table) -> Table:
        """The table of two blocks that follow each other."""
        out: Table = {}
        for e, middle in first.items():
            best = out[e] = {}
            for m, (cost, audit, made) in middle.items():
                for i, (more, then, also) in second.get(m, {}).items():
                    new = (cost + more, audit + then, made + also)
                    if i not in best or new < best[i]:
                        best[i] = new
        return out

    def fold(self, tables: list[Table]) -> Table:
        """All blocks in order put together, neighbours first."""
        while len(tables) > 1:
            tables = [self.join(*pair) if len(pair) > 1 else pair[0] for pair in (tables[k : k + 2] for k in range(0, len(tables), 2))]
        return tables[0]

    def best(self, table: Table) -> Value:
        """(cost, audit, made) of the whole conversation."""
        return min(table[-1][i] for i in self.final if i in table[-1])

    def parse(self, turns: list[tuple[str, bool, bool]]) -> Value:
        return self.best(self.table(turns))


def edited(audit: str, made: str, turns: Iterator[tuple[str, str]], makes: tuple[str, ...] = ("user", "assistant")) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what each edit leaves of a conversation's turns (role, text)."""
    roles = iter(made)
    for edit in audit:
        if edit == "I":
            yield edit, makes[int(next(roles))], ""
            continue
        role, text = next(turns)
        if edit != "D":
            yield edit, makes[int(next(roles))] if edit == "R" else role, text


# Spark part

_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
_ORDER = ["of", "turn", "role", "digest", "nth"]
_TABLE = "array<struct<enter: int, leave: int, cost: long, audit: string, made: string>>"


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from batch.slice(at, 1000).to_pylist()


def _listed(table: Table) -> list[dict]:
    return [{"enter": e, "leave": i, "cost": c, "audit": a, "made": m} for e, to in table.items() for i, (c, a, m) in to.items()]


def _table(listed: list[dict]) -> Table:
    out: Table = {}
    for r in listed:
        out.setdefault(r["enter"], {})[r["leave"]] = (r["cost"], r["audit"], r["made"])
    return out


class ConversationRepair:
    """Faults and least repairs of all conversations of a table of turns.

    Turns of a conversation are in order of (turn, role, SHA-256 of role and text), null turns first. A null role or text counts as
    empty; rows with a null id are one conversation, as are ids that are equal as text. A turn's first fault counts: blank (no word),
    duplicate (role and text seen earlier in the conversation), truncated (its last character that isn't blank isn't one of . ! ?).
    Blank and duplicate turns have to be deleted. Equal rows are turns of their own, of which all but the first are duplicates. Other
    columns aren't read; an empty table gives no rows. One conversation's turns are parsed in as many tasks as it has ranges; its audit
    is one string.
    """

    def __init__(
        self, conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
        grammar: tuple = DIALOGUE, makes: tuple[str, ...] = ("user", "assistant"), block: int = BLOCK,
    ):
        self.parser, self.block, self.id_col = RoleParser(grammar, makes), block, id_col
        self.spark = conversations.sparkSession
        ship_code(self.spark)
        self.kind = conversations.schema[id_col].dataType
        role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
        self.turns = conversations.select(
            F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1")).alias("of"),
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.unhex(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256)).alias("digest"),
        )
        self.faults = materialize(self._faults(), "repair-faults")
        self.parsed = materialize(self._parsed(), "repair-parsed")

    def _faults(self) -> DataFrame:
        """(of, turn, role, initial, digest, nth, blank, duplicate, truncated) of each turn, without texts."""
        blank = ~F.col("text").rlike(_BLANK)
        marked = self.turns.select(
            "of", "turn", "role", F.substring("role", 1, 1).alias("initial"), "digest", F.monotonically_increasing_id().alias("nth"),
            blank.alias("blank"), (~blank & ~F.col("text").rlike(_ENDED)).alias("truncated"), F.unhex(F.sha2(F.concat("of", F.hex("digest")), 256)).alias("same"),
        )
        marked = materialize(marked, "repair-turns")
        # the first of equal turns: null turns first, then by nth, as their role and digest are the same
        place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "nth")
        first = materialize(marked.groupBy("same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "repair-same")
        rows = first.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if not rows:
            return marked.drop("same").withColumn("duplicate", F.lit(False))
        again = attach_groups(marked, first, "same", "rows", rows).filter(F.col("first.nth") != F.col("nth")).select("nth").distinct()
        found = marked.join(again.withColumn("again", F.lit(True)), "nth", "left")
        duplicate = ~F.col("blank") & F.coalesce("again", F.lit(False))
        return found.select("of", "turn", "role", "initial", "digest", "nth", "blank", duplicate.alias("duplicate"), (F.col("truncated") & ~duplicate).alias("truncated"))

    def _parsed(self) -> DataFrame:
        """(of, cost, audit, made, illegal) of each conversation: blocks within ranges of turns, then the blocks put together."""
        parser, block = self.parser, self.block

        def summary(of: str, turns: Iterator[dict], begins: bool) -> dict:
            tables, illegal, first, before, part = [], 0, None, None, None
            while chunk := list(itertools.islice(turns, block)):
                for r in chunk:
                    illegal += before is not None and before + r["initial"] not in ("su", "ua", "au")
                    before = r["initial"]
                first = chunk[0]["initial"] if first is None else first
                part = chunk[0]["part"]
                read = [(r["initial"], r["blank"] or r["duplicate"], r["truncated"]) for r in chunk]
                tables.append(parser.table(read, [-1] if begins and not tables else [-1, *parser.live]))
            return {"of": of, "part": part, "illegal": illegal, "first": first, "last": before, "table": _listed(parser.fold(tables))}

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # only the first conversation of a range can have begun in an earlier one
            out: list[dict] = []
            for n, (of, turns) in enumerate(itertools.groupby(_rows_of(batches), key=lambda r: r["of"])):
                out.append(summary(of, turns, n > 0))
                if len(out) >= 500:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

        listed = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("made", pa.string())]))
        schema = pa.schema([("of", pa.string()), ("part", pa.int32()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("table", listed)])
        ranged = self.faults.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id())
        found = ranged.mapInArrow(blocks, f"of string, part int, illegal long, first string, last string, table {_TABLE}")
        whole = found.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("part", "illegal", "first", "last", "table"))).alias("blocks"))

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in _rows_of(iter([batch])):
                    parts = r["blocks"]
                    illegal = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in itertools.pairwise(parts))
                    cost, audit, made = parser.best(parser.fold([_table(p["table"]) for p in parts]))
                    out.append({"of": r["of"], "cost": cost, "audit": audit, "made": made, "illegal": illegal})
                yield pa.RecordBatch.from_pylist(out, final)

        final = pa.schema([("of", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("made", pa.string()), ("illegal", pa.int64())])
        return whole.mapInArrow(together, "of string, cost long, audit string, made string, illegal long")

    def _id(self):
        return F.when(F.col("of").startswith("0"), F.substr("of", F.lit(2))).cast(self.kind).alias(self.id_col)

    def _with_audits(self) -> DataFrame:
        """Each conversation's audit, then its turns in order, in one task; texts move once."""
        rows = self.turns.select("of", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("made"))
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "text")]
        audits = self.parsed.select("of", F.lit(0).alias("kind"), *none, "audit", "made")
        return audits.unionByName(rows).repartition("of").sortWithinPartitions("of", "kind", "turn", "role", "digest")

    def repaired(self) -> DataFrame:
        """(id_col, nth, edit, role, text): the turns after the repair, from nth 0 on; edit is K (kept), R (new role) or I (inserted)."""
        makes = self.parser.makes

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def lines():
                for of, rows in itertools.groupby(_rows_of(batches), key=lambda r: r["of"]):
                    head = next(rows)
                    kept = edited(head["audit"], head["made"], ((r["role"], r["text"]) for r in rows), makes)
                    for nth, (edit, role, text) in enumerate(kept):
                        yield {"of": of, "nth": nth, "edit": edit, "role": role, "text": text}

            found = lines()
            while out := list(itertools.islice(found, 1000)):
                yield pa.RecordBatch.from_pylist(out, schema)

        schema = pa.schema([("of", pa.string()), ("nth", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        rows = self._with_audits().mapInArrow(walk, "of string, nth long, edit string, role string, text string")
        return rows.select(self._id(), "nth", "edit", "role", "text")

    def digests(self) -> DataFrame:
        """(of, sha256) of each conversation's repaired turns, written role:text and joined by line feeds."""
        makes = self.parser.makes

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def hashes():
                for of, rows in itertools.groupby(_rows_of(batches), key=lambda r: r["of"]):
                    head, digest = next(rows), hashlib.sha256()
                    kept = edited(head["audit"], head["made"], ((r["role"], r["text"]) for r in rows), makes)
                    for nth, (_, role, text) in enumerate(kept):
                        digest.update(("\n" if nth else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))
                    yield {"of": of, "sha256": digest.hexdigest()}

            found = hashes()
            while out := list(itertools.islice(found, 1000)):
                yield pa.RecordBatch.from_pylist(out, schema)

        schema = pa.schema([("of", pa.string()), ("sha256", pa.string())])
        return self._with_audits().mapInArrow(walk, "of string, sha256 string")

    def report(self) -> DataFrame:
        """One row per conversation: id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

        gaps are the whole numbers that turns leave out between the least and the greatest one; illegal counts neighbours whose roles'
        initials aren't su, ua or au.
        """
        flags = [F.count_if(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")]
        span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        counts = self.faults.groupBy("of").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *flags)
        found = counts.join(self.parsed.select("of", "illegal", "cost", "audit"), "of").join(self.digests(), "of")
        return found.select(self._id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))


def repair_report(conversations: DataFrame, **options) -> DataFrame:
    """`ConversationRepair.report` of a table of turns."""
    return ConversationRepair(conversations, **options).report()


def repaired_turns(conversations: DataFrame, **options) -> DataFrame:
    """`ConversationRepair.repaired` of a table of turns."""
    return ConversationRepair(conversations, **options).repaired()
