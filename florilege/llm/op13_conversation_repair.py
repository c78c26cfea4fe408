"""Conversations are brought into a legal order of turns by the cheapest edits.

Method: a grammar of roles, ``(s?(ua)+)?`` over role initials (a system turn at the head at most, then user and
assistant in pairs), has four states. Backward dynamic programming over (turn, state) gives the cost to go; a forward walk then
takes, among the edits that lie on a cheapest way, the one whose initial is least in ASCII. The turns are rebuilt from
the walk.

* Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5; a
  truncated turn that isn't deleted adds 5. Blank and duplicate turns must be deleted.
* A turn's first fault counts: blank (only white space), duplicate (role and text stood earlier in the conversation), truncated
  (its last character that is not white space is none of ``.!?``).

Scale. A conversation may hold any share of all rows, so nothing but the last step sees one as a whole. Turns without their
texts are sorted by ranges, a long conversation in many tasks, and cut into segments of ``SEGMENT`` rows. A segment is a 4 x 4 matrix of costs
from state to state, min-plus products of which give the cost to go at each segment's end; each segment is then walked from
every state it may be entered in, and the walks are put together. Conversations meet as one short row a segment. Equal turns are one row with a count. In the last step the
texts stream by in order, one by one: only the hash of a whole conversation needs that.

Edge cases: nulls in role and text are one space (so such a text is blank, such a role has no place in the grammar); a null
turn comes first; a null conversation id is a conversation; turns of equal number (ties) stand by role, then by the MD5 of their text; repeated
rows are duplicates; texts of any length pass one at a time; an empty table gives no rows; other columns don't enter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm import core
from florilege.session import stage

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SEGMENT = 1 << 14  # turns of one conversation that are walked together
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

#: states: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
#: which state a role's initial leads to, from each state (-1: not allowed)
STEPS = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: the state after a user or assistant turn that is made to fit
FITS = (USER, USER, ASSISTANT, USER)
INITIALS = "sua"  # by number; every other role is number 3
OK, MUST_GO, TRUNCATED = range(3)
FAR = 1 << 60


def closed(v: list[int]) -> list[int]:
    """Costs to go where turns may be inserted first."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return [min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant]


#: cost to go behind the last turn: done in START and ASSISTANT
END = closed([0, FAR, FAR, 0])


def before(v: list[int], initial: int, fault: int) -> list[int]:
    """Costs to go before a turn, from those behind it."""
    if fault == MUST_GO:
        return [DELETE + c for c in v]
    extra = CUT_OFF if fault == TRUNCATED else 0
    out = []
    for state in range(4):
        best = min(DELETE + v[state], REROLE + extra + v[FITS[state]])
        if initial < 3 and (to := STEPS[INITIALS[initial]][state]) >= 0:
            best = min(best, KEEP + extra + v[to])
        out.append(best)
    return closed(out)


def costs(initials: list[int], faults: list[int], goal: list[int]) -> list[list[int]]:
    """Costs to go before each turn of a segment and behind its last."""
    out = [goal]
    for r, f in zip(reversed(initials), reversed(faults), strict=True):
        out.append(before(out[-1], r, f))
    return out[::-1]


def walk(initials: list[int], faults: list[int], togo: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The edits from a state on, ASCII-least of the cheapest, and the state behind them. ``last``: nothing follows."""
    out = []
    for i, (r, f) in enumerate(zip(initials, faults, strict=True)):
        here, then = togo[i], togo[i + 1]
        while True:
            if here[state] == DELETE + then[state]:
                out.append("D")
                break
            if here[state] == INSERT + here[FITS[state]]:
                out.append("I")
                state = FITS[state]
                continue
            extra = CUT_OFF if f == TRUNCATED else 0
            to = STEPS[INITIALS[r]][state] if r < 3 else -1
            if to >= 0 and here[state] == KEEP + extra + then[to]:
                out.append("K")
                state = to
            else:
                out.append("R")
                state = FITS[state]
            break
    while last and state not in (START, ASSISTANT):
        out.append("I")
        state = FITS[state]
    return "".join(out), state


def matrix(initials: list[int], faults: list[int]) -> list[int]:
    """Costs from each state before a segment to each behind it, row by row."""
    columns = [costs(initials, faults, closed([0 if s == t else FAR for s in range(4)]))[0] for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)]


def goals(matrices: list[list[int]]) -> tuple[list[list[int]], int]:
    """Costs to go behind each segment of a conversation, and before the first from START."""
    v, out = END, []
    for m in reversed(matrices):
        out.append(v)
        v = [min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4)]
    return out[::-1], v[START]


def entries(exits: list[list[int]]) -> list[int]:
    """The state each segment is entered in."""
    state, out = START, []
    for e in exits:
        out.append(state)
        state = e[state]
    return out


@dataclass
class Repair:
    """``report``: a row per conversation. ``acts``: per distinct turn its edits, with the insertions before it (and, at
    the end of a conversation, behind it)."""

    report: DataFrame
    acts: DataFrame


def _clean(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``_c, _n, _r, _t``: conversation, number, role and text; nulls in the last two are one space."""
    return table.select(F.col(conv_col).alias("_c"), F.col(turn_col).cast("long").alias("_n"), _clean(role_col).alias("_r"), _clean(text_col).alias("_t"))


def _kind(name: str) -> pa.DataType:
    return pa.list_(_kind(name[6:-1])) if name.startswith("array<") else {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def _each(df: DataFrame, f, out: str, keep: str | None = None) -> DataFrame:
    """``f`` over rows of plain lists, each a bounded piece of a conversation; the column ``keep`` passes untouched."""
    names, kinds = zip(*(x.split() for x in out.split(", ")), strict=True)
    kinds = [_kind(k) for k in kinds]
    passed = [keep] if keep else []
    df = df.select(*passed, *(c for c in df.columns if c not in passed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in core.slices(batches):
            rows = [f(*r) for r in zip(*(c.to_pylist() for c in b.columns[len(passed) :]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(passed)], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*passed, *names])

    return df.mapInArrow(run, ", ".join([f"{c} {core.id_type(df, c)}" for c in passed] + [out]))


def repair(rows: DataFrame, segment: int = SEGMENT) -> Repair:
    """Faults, cost and edits of conversations, from ``turns``."""
    ink = F.rtrim("_t", F.lit(SPACE))
    fault = F.when(ink == "", MUST_GO).when(F.right(ink, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    initial = F.coalesce(F.instr(F.lit(INITIALS), F.substring("_r", 1, 1)) - 1, F.lit(-1))
    initial = F.when((initial >= 0) & (F.col("_r") != ""), initial).otherwise(3)
    light = rows.select("_c", "_n", "_r", F.md5("_t").alias("_d"), initial.alias("_i"), fault.alias("_f"), (ink == "").alias("_b"))
    once = stage(light.groupBy("_c", "_n", "_r", "_d").agg(F.count(F.lit(1)).alias("_k"), F.first("_i").alias("_i"), F.first("_f").alias("_f"), F.first("_b").alias("_b")), "turns")

    # the first of equal turns, found by one key each, so no group is gathered anywhere
    first = once.groupBy("_c", "_r", "_d").agg(F.min(F.struct(F.col("_n").isNotNull().alias("k"), "_n")).alias("m")).select(F.col("_c").alias("c"), F.col("_r").alias("r"), F.col("_d").alias("d"), F.col("m._n").alias("n"), F.lit(True).alias("_first"))
    same = once["_c"].eqNullSafe(first["c"]) & once["_n"].eqNullSafe(first["n"]) & (once["_r"] == first["r"]) & (once["_d"] == first["d"])
    told = once.join(first, same, "left").drop("c", "r", "d", "n").withColumn("_first", F.coalesce("_first", F.lit(False)))
    told = told.withColumn("_f", F.when(F.col("_first") | F.col("_b"), F.col("_f")).otherwise(MUST_GO))
    order = ("_c", "_n", "_r", "_d")  # nulls first
    placed = stage(told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "turns-in-order")

    cell = F.struct("_at", "_n", "_r", "_d", F.col("_i").cast("int").alias("_i"), F.col("_f").cast("int").alias("_f"), "_k")
    chunk = F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / segment)
    cut = placed.groupBy("_c", F.shiftright("_at", 33).alias("p"), chunk.alias("q")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    cut = cut.select(F.col("cells")[0]["_at"].alias("_s"), "_c", "cells")
    fields = cut.select("_s", F.transform("cells", lambda x: x["_i"]).alias("i"), F.transform("cells", lambda x: x["_f"]).alias("f"), F.transform("cells", lambda x: x["_k"]).alias("k"), "_c", "cells")
    pieces = stage(fields, "segments")

    def measured(s, i, f, k):
        names = [INITIALS[x] if x < 3 else "x" for x in i]
        bad = sum(a + b not in LEGAL for a, b in zip(names, names[1:], strict=False)) + sum(x - 1 for x in k)
        return s, matrix(i, f), bad, names[0], names[-1]

    each = _each(pieces.select("_s", "i", "f", "k", "_c"), measured, "s long, m array<long>, bad long, head string, tail string", keep="_c")
    whole = each.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("s", "m", "bad", "head", "tail"))).alias("x"))
    whole = whole.select("_c", F.col("x.s").alias("s"), F.col("x.m").alias("m"), F.col("x.bad").alias("bad"), F.col("x.head").alias("head"), F.col("x.tail").alias("tail"))

    def aimed(s, m, bad, head, tail):
        v, cost = goals(m)
        return s[0], s, v, sum(bad) + sum(a + b not in LEGAL for a, b in zip(tail, head[1:], strict=False)), cost

    aims = stage(_each(whole.select("s", "m", "bad", "head", "tail"), aimed, "first long, s array<long>, v array<array<long>>, illegal long, cost long"), "costs-to-go")
    goal = aims.select("first", F.posexplode(F.arrays_zip("s", "v")).alias("place", "x"), F.size("s").alias("n")).select(F.col("x.s").alias("g"), F.col("x.v").alias("goal"), "place", (F.col("place") + 1 == F.col("n")).alias("last"), "first")

    def walked(s, i, f, goal, place, last, first):
        togo = costs(i, f, goal)
        ways = [walk(i, f, togo, state, last) if state == START or place else ("", 0) for state in range(4)]  # the first segment has one entry
        return s, first, [w for w, _ in ways], [e for _, e in ways]

    ways = stage(_each(pieces.join(goal, F.col("_s") == F.col("g")).select("_s", "i", "f", "goal", "place", "last", "first"), walked, "s long, first long, edits array<string>, exits array<int>"), "walks")
    joint = ways.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("s", "exits"))).alias("x")).select("first", F.col("x.s").alias("s"), F.col("x.exits").alias("e"))
    entered = _each(joint, lambda first, s, e: (s, entries(e)), "s array<long>, state array<int>").select(F.inline(F.arrays_zip("s", "state"))).select(F.col("s").alias("e"), "state")
    taken = ways.join(entered, F.col("s") == F.col("e")).select("s", "first", F.col("edits")[F.col("state")].alias("edits"))

    # an edit per distinct turn, insertions before it; copies of a turn are deleted behind it
    parts = F.regexp_extract_all("edits", F.lit("(I*[DKR](?:I+$)?)"), 1)
    full = stage(pieces.select("_s", "_c", "cells").join(taken, F.col("_s") == F.col("s")).withColumn("acts", parts), "edits")
    audit = F.array_join(F.zip_with("acts", "cells", lambda a, x: F.concat(F.regexp_extract(a, "^I*[DKR]", 0), F.repeat(F.lit("D"), (x["_k"] - 1).cast("int")), F.regexp_extract(a, "(?<=[DKR])I*$", 0))), "")
    said = full.select("_c", "first", "s", audit.alias("audit")).groupBy("_c").agg(F.min("first").alias("first"), F.sort_array(F.collect_list(F.struct("s", "audit"))).alias("x")).select("_c", "first", F.array_join("x.audit", "").alias("audit"))
    zeros = F.sum(F.when(F.col("_b"), F.col("_k")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("_b"), 0).otherwise(F.col("_k") - F.col("_first").cast("long"))).alias("duplicate"), F.sum(F.when(F.col("_f") == TRUNCATED, 1).otherwise(0)).cast("long").alias("truncated")
    many = F.sum(F.col("_k") - 1).alias("copies")
    tallies = placed.groupBy("_c").agg(*zeros, many)
    numbers = placed.groupBy("_c", "_n").agg(F.lit(1).alias("one")).groupBy("_c").agg(F.coalesce(F.max("_n") - F.min("_n") + 1 - F.count("_n"), F.lit(0)).alias("gaps"))
    report = said.join(aims.select("first", "illegal", "cost"), "first")
    for other in (tallies, numbers):
        other = other.withColumnRenamed("_c", "c")
        report = report.join(other, report["_c"].eqNullSafe(other["c"])).drop("c")
    report = report.select("_c", "gaps", "blank", "duplicate", "truncated", "illegal", (F.col("cost") + DELETE * F.col("copies")).alias("cost"), "audit")
    acts = full.select("_c", F.inline(F.arrays_zip("cells", "acts"))).select("_c", "cells._n", "cells._r", "cells._d", F.col("acts").alias("_act"))
    return Repair(report, acts)


def rebuilt(rows: DataFrame, acts: DataFrame) -> DataFrame:
    """``_c, role, text``: the repaired turns, conversation by conversation in order within each partition."""
    kind = core.id_type(rows, "_c")
    text = rows.select("_c", "_n", "_r", F.md5("_t").alias("_d"), F.lit(None).cast("string").alias("_act"), "_t")
    edit = acts.select("_c", "_n", "_r", "_d", "_act", F.lit(None).cast("string").alias("_t"))
    both = edit.unionByName(text).repartition("_c").sortWithinPartitions("_c", "_n", "_r", "_d", F.col("_act").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, act = object(), START, ""
        for b in core.slices(batches, 1024):
            out: list[tuple] = []
            for c, r, a, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if c != conv:
                    conv, state = c, START
                if a is None and not act:
                    continue  # a copy, or the text of a turn that went
                if a is not None:
                    act = a
                while act and act[0] in "ID":
                    if act[0] == "I":
                        out.append((c, "user" if FITS[state] == USER else "assistant", ""))
                        state = FITS[state]
                    act = act[1:]
                if act and a is None:
                    to = STEPS[r[0]][state] if act[0] == "K" else FITS[state]
                    out.append((c, r if act[0] == "K" else "user" if to == USER else "assistant", t.as_py()))
                    state, rest = to, act[1:]
                    act = ""
                    for _ in rest:  # insertions behind the last turn
                        out.append((c, "user" if FITS[state] == USER else "assistant", ""))
                        state = FITS[state]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.column(0).type), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], ["_c", "role", "text"])

    return both.select("_c", "_r", "_act", "_t").mapInArrow(run, f"_c {kind}, role string, text string")


def hashed(repaired: DataFrame) -> DataFrame:
    """``_c, repaired_sha256`` of ``role:text`` lines, from turns that stand together in order: one pass, no shuffle."""
    kind = core.id_type(repaired, "_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, code, any_yet = None, None, False

        def row(c, h, t):
            return pa.RecordBatch.from_arrays([pa.array(c, t), pa.array(h, pa.string())], ["_c", "repaired_sha256"])

        for b in batches:
            done: tuple[list, list] = ([], [])
            for c, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if not any_yet or c != conv:
                    if any_yet:
                        done[0].append(conv), done[1].append(code.hexdigest())
                    conv, code, any_yet = c, hashlib.sha256(), True
                else:
                    code.update(b"\n")
                code.update(f"{r}:".encode())
                code.update(t.as_py().encode())
            yield row(*done, b.column(0).type)
        if any_yet:
            yield row([conv], [code.hexdigest()], b.column(0).type)

    return repaired.mapInArrow(run, f"_c {kind}, repaired_sha256 string")


def damaged(table: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with one turn in four spoilt, by the CRC-32 of ``conv_id:turn``."""
    rows = table.select("*", (F.crc32(F.concat_ws(":", _clean("conv_id"), _clean("turn"))) % 20).alias("_x"))
    text = F.when(F.col("_x") == 1, "").when(F.col("_x") == 2, F.translate(_clean("text"), ".!?", "")).otherwise(_clean("text"))
    role = F.when(F.col("_x") == 4, "user").otherwise(_clean("role"))
    spoilt = rows.where("_x <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_x") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return spoilt.drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = turns(damaged(table))
    fixed = repair(rows)
    codes = hashed(rebuilt(rows, fixed.acts)).withColumnRenamed("_c", "h")
    every = table.select(F.col("conv_id")).distinct()
    out = every.join(fixed.report, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(codes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
