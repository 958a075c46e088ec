"""Conversation structure repair: the cheapest edits that make the turns alternate, ASCII-least among equals.

Edits are (K)eep, (R)erole, (D)elete and (I)nsert; the repaired roles read ``(s?(ua)+)?``. The dynamic programme has
four states (nothing yet, after system, after user, after assistant). Vectors of the costs still to come are kept only
at checkpoints; between two of them they are computed again while walking forward, which emits, at every turn, the
least letter that still reaches the best cost. No letter leads to two states, so the walk never turns back.

Turns are sorted by range and cut into blocks of ``BLOCK`` turns (or the square root of the longest conversation, if
that is more), whatever conversations they belong to. A conversation inside one block is repaired there, with
checkpoints at the root of its length. Of one that reaches a border, each block gives the min-plus matrix of its part;
the matrices of a conversation are multiplied backwards, which gives the vectors at the borders (the checkpoints);
each part is walked from all four states, and the exits chain the parts. So a conversation of any length is spread over
tasks. Only the last step, whose SHA-256 runs over the whole repaired conversation by definition, streams one
conversation through one task, in batches and with a fixed state besides the audit itself.

Texts move once, to that step. Everything before works on narrow rows with SHA-256 keys of the texts.

Defined cases: nulls of any column count as one space where they are text, and as a null turn in the order and the
gaps; a null conv_id is a conversation; turns that share a number go by role, by the first ``HEAD`` characters of the
text, by its SHA-256; repeated rows are duplicates of the first; roles count by their first character, which is
none of an empty role; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sentinelweave.llm.common import small_batches, stored

#: Turns of a block at least.
BLOCK = 4096
#: Characters of a text that order turns of one number and role.
HEAD = 64
# Costs of the edits and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# White space, and the marks that end a sentence.
BLANKS = " \t\n\x0b\x0c\r"
MARKS = ".!?"

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The state after the turn that may follow.
NEXT = (2, 2, 3, 2)
#: The state after a kept turn of the initial s, u, a, other; -1: it may not stand there.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
INITIALS = {"s": 0, "u": 1, "a": 2}
ROLES = {2: "user", 3: "assistant"}
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Costs still to come at a conversation's end.
END = (0.0, 2.0 * INSERT, float(INSERT), 0.0)
UNITS = [tuple(0.0 if t == s else math.inf for t in range(4)) for s in range(4)]


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: every row by the remainder of its CRC-32, dropped ones gone."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return read.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` with what orders those of one number: the head and the SHA-256 of the text."""
    return turns.withColumns({"head": F.left("text", F.lit(HEAD)), "key": F.unhex(F.sha2("text", 256))})


def order(*last: str) -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("head"), F.asc("key"), *[F.asc(c) for c in last]]


def narrow_turns(turns: DataFrame) -> DataFrame:
    """Turns without their texts, in order: ``pos`` ascends over the whole table; faults but for duplicates."""
    tail = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(tail == "", BLANK).when(~F.right(tail, F.lit(1)).isin(*MARKS), CUT).otherwise(SOUND)
    rows = placed(turns).withColumns({"fault": fault, "copy": F.explode(F.sequence(F.lit(1), "copies")), "part": F.spark_partition_id()})
    rows = rows.select("conv_id", "turn", "role", "head", "key", "fault", "part")
    # The part is the last key, so that equal rows are dealt to many ranges.
    return rows.repartitionByRange(*order("part")).sortWithinPartitions(*order("part")).drop("part").withColumn("pos", F.monotonically_increasing_id())


def with_duplicates(turns: DataFrame) -> DataFrame:
    """``turns`` with the fault of a turn whose role and text its conversation had before; blank ones stay blank."""
    first = turns.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    met = turns.join(first.filter("n > 1"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    later = (F.col("pos") > F.col("first")) & (F.col("fault") != BLANK)
    return met.withColumn("fault", F.when(F.coalesce(later, F.lit(False)), DUPLICATE).otherwise(F.col("fault"))).drop("c", "r", "k", "first", "n")


def with_inserts(base: list[float]) -> tuple[float, ...]:
    return tuple(min(base[s], INSERT + base[NEXT[s]], 2 * INSERT + base[NEXT[NEXT[s]]]) for s in range(4))


class Steps:
    """Steps of the programme, remembered: costs relative to the least of a vector take few values."""

    def __init__(self) -> None:
        self.back: dict = {}
        self.forth: dict = {}

    def before(self, after: tuple[float, ...], code: int) -> tuple[tuple[float, ...], float]:
        """(relative costs before a turn, their least) from the relative costs after it; ``code``: 4 initial + fault."""
        got = self.back.get((after, code))
        if got is None:
            initial, fault = divmod(code, 4)
            base = [DELETE + c for c in after]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                for s in range(4):
                    base[s] = min(base[s], REROLE + more + after[NEXT[s]], more + after[KEPT[s][initial]] if KEPT[s][initial] >= 0 else math.inf)
            full = with_inserts(base)
            least = min(full)
            got = self.back[after, code] = tuple(c - least for c in full), least
        return got

    def walk(self, state: int, after: tuple[float, ...], code: int) -> tuple[str, int]:
        """(edits at a turn, state after it) on the ASCII-least cheapest way."""
        got = self.forth.get((state, after, code))
        if got is None:
            initial, fault = divmod(code, 4)
            vector, least = self.before(after, code)
            here = lambda s: vector[s] + least
            more = TRUNCATED if fault == CUT else 0
            edits, s = "", state
            while True:
                if DELETE + after[s] == here(s):
                    got = edits + "D", s
                elif INSERT + here(NEXT[s]) == here(s):
                    edits, s = edits + "I", NEXT[s]
                    continue
                elif KEPT[s][initial] >= 0 and more + after[KEPT[s][initial]] == here(s):
                    got = edits + "K", KEPT[s][initial]
                else:
                    got = edits + "R", NEXT[s]
                break
            self.forth[state, after, code] = got
        return got

    def through(self, codes: list[int], after: tuple[float, ...]) -> tuple[tuple[float, ...], float]:
        """Relative costs before all turns, and their least."""
        total = min(after)
        after = tuple(c - total for c in after)
        for code in reversed(codes):
            after, least = self.before(after, code)
            total += least
        return after, total

    def matrix(self, codes: list[int]) -> list[float]:
        """Least cost from every state before the turns to every state after them, row by row."""
        ways = []
        for unit in UNITS:
            vector, least = self.through(codes, unit)
            ways.append([c + least for c in vector])
        return [ways[t][s] for s in range(4) for t in range(4)]

    def edits(self, codes: list[int], state: int, after: tuple[float, ...]) -> tuple[list[str], int]:
        """Edits of every turn and the state behind them, from vectors at every root of the number of turns."""
        size = max(1, math.isqrt(len(codes)))
        starts = list(range(0, len(codes), size))
        least = min(after)
        point = tuple(c - least for c in after)
        points = {}
        for a in reversed(starts):
            points[a] = point
            point, _ = self.through(codes[a : a + size], point)
        out = []
        for a in starts:
            vectors, vector = [], points[a]
            for code in reversed(codes[a : a + size]):
                vectors.append(vector)
                vector, _ = self.before(vector, code)
            for code in codes[a : a + size]:
                letters, state = self.walk(state, vectors.pop(), code)
                out.append(letters)
        return out, state


def parts(table: pa.Table) -> Iterator[tuple[int, int, list[int]]]:
    """(first row, end, codes) of each conversation's part of a block in order of ``pos``."""
    ids, roles, faults = (table.column(c).to_pylist() for c in ("conv_id", "role", "fault"))
    codes = [4 * INITIALS.get(r[:1], 3) + f for r, f in zip(roles, faults)]
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[start]:
            yield start, i, codes[start:i]
            start = i


def chained(pieces: DataFrame, schema: str, work) -> DataFrame:
    """``work`` on the parts of every conversation that reaches a border, first to last."""
    return pieces.groupBy("conv_id").applyInArrow(lambda table: work(table.sort_by([("p", "ascending"), ("b", "ascending")])), schema)


def edited(turns: DataFrame, kind: str) -> DataFrame:
    """``turns`` with ``edits``, the letters at each turn; ``turns`` have ``p, b``, the block they lie in."""
    row = f"conv_id {kind}, turn long, role string, head string, key binary, fault int, pos long, p long, b long"
    names = ["conv_id", "turn", "role", "head", "key", "fault", "pos", "p", "b"]
    strings, doubles = pa.list_(pa.string()), pa.list_(pa.float64())

    def inside(table: pa.Table) -> pa.Table:
        table = table.select(names).sort_by("pos")
        steps, n = Steps(), len(table)
        letters, matrices, keep = [None] * n, [None] * n, []
        for a, z, codes in parts(table):
            if a == 0 or z == n:
                matrices[a] = steps.matrix(codes)
                keep.append(a)
            else:
                letters[a:z] = steps.edits(codes, 0, END)[0]
                keep += range(a, z)
        return table.append_column("edits", pa.array(letters, pa.string())).append_column("matrix", pa.array(matrices, doubles)).take(pa.array(keep, pa.int64()))

    done = stored(turns.groupBy("p", "b").applyInArrow(inside, f"{row}, edits string, matrix array<double>"), "inside")

    def backwards(table: pa.Table) -> pa.Table:
        after, vector = [], list(END)
        for m in reversed(table.column("matrix").to_pylist()):
            after.append(vector)
            vector = [min(m[4 * s + t] + vector[t] for t in range(4)) for s in range(4)]
        return table.select(["conv_id", "p", "b"]).append_column("after", pa.array(after[::-1], doubles))

    points = chained(done.filter("matrix is not null").select("conv_id", "p", "b", "matrix"), f"conv_id {kind}, p long, b long, after array<double>", backwards)
    at_border = lambda marks: (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("p") == F.col("q")) & (F.col("b") == F.col("d"))
    marks = points.select(F.col("conv_id").alias("c"), F.col("p").alias("q"), F.col("b").alias("d"), "after")

    def across(table: pa.Table) -> pa.Table:
        table = table.select([*names, "after"]).sort_by("pos")
        steps, n = Steps(), len(table)
        letters, exits = [None] * n, [None] * n
        for a, z, codes in parts(table):
            after = tuple(table.column("after")[a].as_py())
            ways = [steps.edits(codes, s, after) for s in range(4)]
            letters[a:z] = map(list, zip(*[w[0] for w in ways]))
            exits[a] = [w[1] for w in ways]
        return table.drop_columns(["after"]).append_column("ways", pa.array(letters, strings)).append_column("exits", pa.array(exits, pa.list_(pa.int32())))

    border = stored(turns.join(marks, at_border(marks)).groupBy("p", "b").applyInArrow(across, f"{row}, ways array<string>, exits array<int>"), "across")

    def forwards(table: pa.Table) -> pa.Table:
        entries, state = [], 0
        for exits in table.column("exits").to_pylist():
            entries.append(state)
            state = exits[state]
        return table.select(["conv_id", "p", "b"]).append_column("entry", pa.array(entries, pa.int32()))

    entries = chained(border.filter("exits is not null").select("conv_id", "p", "b", "exits"), f"conv_id {kind}, p long, b long, entry int", forwards)
    marks = entries.select(F.col("conv_id").alias("c"), F.col("p").alias("q"), F.col("b").alias("d"), "entry")
    met = border.join(marks, at_border(marks)).select(*names, F.element_at("ways", F.col("entry") + 1).alias("edits"))
    return done.filter("edits is not null").select(*names, "edits").unionByName(met)


class Conversation:
    """What a conversation's turns, in order, come to."""

    def __init__(self) -> None:
        self.hash, self.some, self.audit = hashlib.sha256(), False, []
        self.state = self.cost = self.illegal = self.turns = 0
        self.faults = [0, 0, 0, 0]
        self.low = self.high = self.initial = None

    def emit(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.some else b"") + role.encode() + b":" + text.encode())
        self.some = True

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.cost += INSERT
        self.audit.append("I")
        self.emit(ROLES[self.state], "")

    def turn(self, number: int | None, role: str, fault: int, text: str, edits: str) -> None:
        if number is not None and number != self.high:
            self.turns += 1
            self.low = number if self.low is None else self.low
            self.high = number
        initial = role[:1]
        self.illegal += self.initial is not None and (self.initial, initial) not in (("s", "u"), ("u", "a"), ("a", "u"))
        self.initial = initial
        self.faults[fault] += 1
        for letter in edits[:-1]:
            self.insert()
        self.audit.append(edits[-1])
        if edits[-1] == "D":
            self.cost += DELETE
            return
        self.cost += TRUNCATED * (fault == CUT) + REROLE * (edits[-1] == "R")
        self.state = NEXT[self.state] if edits[-1] == "R" else KEPT[self.state][INITIALS[initial]]
        self.emit(ROLES[self.state] if edits[-1] == "R" else role, text)

    def result(self) -> tuple:
        while self.state in (1, 2):
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def digested(rows: DataFrame, kind: str) -> DataFrame:
    """One row per conversation from its texts and its edits, which come in order within a partition."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, conversation, text, done = None, None, "", []
        id_type = None

        def out() -> pa.RecordBatch:
            arrays = [pa.array([r[0] for r in done], id_type), *[pa.array([r[1][i] for r in done], pa.int64()) for i in range(6)], *[pa.array([r[1][i] for r in done], pa.string()) for i in (6, 7)]]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *names])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, role, fault, edits, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "edits", "text"))):
                if conversation is None or conv != own:
                    if conversation is not None:
                        done.append((own, conversation.result()))
                    own, conversation = conv, Conversation()
                if edits is None:
                    text = words
                else:
                    conversation.turn(turn, role, fault, text, edits)
            if done:
                yield out()
                done.clear()
        if conversation is not None:
            done.append((own, conversation.result()))
            yield out()

    schema = f"conv_id {kind}, " + ", ".join(f"{n} long" for n in names[:6]) + ", audit string, repaired_sha256 string"
    return rows.mapInArrow(work, schema)


def repaired(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of the input: faults after the damage, cost and letters of the repair, its SHA-256."""
    spark = conversations.sparkSession
    small_batches(spark)
    rows = conversations.select("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = damaged(rows)
    turns = stored(narrow_turns(texts), "turns")
    longest = turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    size = max(block, math.isqrt(longest))
    place = {"p": F.shiftright("pos", 33), "b": F.floor(F.col("pos").bitwiseAND((1 << 33) - 1) / size)}
    edits = edited(stored(with_duplicates(turns).withColumns(place), "marked-turns"), kind)
    both = placed(texts).select("conv_id", "turn", "role", "head", "key", "text").withColumns(
        {"fault": F.lit(None).cast("int"), "edits": F.lit(None).cast("string"), "pos": F.lit(-1).cast("long")}
    ).unionByName(edits.select("conv_id", "turn", "role", "head", "key", "fault", "edits", "pos", F.lit(None).cast("string").alias("text")))
    ordered = both.repartition("conv_id").sortWithinPartitions(*order("pos")).select("conv_id", "turn", "role", "fault", "edits", "text")
    found = digested(ordered, kind).withColumnRenamed("conv_id", "found_id").withColumn("found", F.lit(True))
    all_ids = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    none = hashlib.sha256().hexdigest()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return all_ids.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
