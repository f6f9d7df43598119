"""Conversation structure repair with iterative-deepening A*.

A conversation's rows are kept, given another role or deleted, and empty turns are inserted, so that the initials of the roles
read as an optional system turn and pairs of user and assistant. The cheapest edits are found by depth-first search in ASCII order
of the edits' initials under a cost bound, which rises until a path is accepted; so the first accepting path is the answer,
ties included. A state is a row and the role before it. The transposition table holds, for every state that failed, the least
cost it is known to need: that prunes it, and what the first state needs is the next bound. The estimates it starts
from are admissible: the cheapest edits of a conversation's rest, whatever role stands before it. They miss a few units at
most, so that neither the number of bounds nor the work per row grows with the conversation.

On the cluster, rows are told their faults where they are, one shuffle of codes (no texts) brings a conversation's rows together in
order, and a second one streams its texts through the edits. A conversation is one answer and so passes through one task, but
neither its rows nor its texts are held there: one byte a row in the first pass, one edit a row in the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelforge.llm.common import ship, slices, written

#: What stands before a row: nothing, the system turn, a user's, an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: The role that a repaired conversation has next, by what stands before.
NEXT = ("user", "user", "assistant", "user")
AFTER = (USER, USER, ASSISTANT, USER)
#: Costs of deleting, inserting, giving another role; an undeleted truncated row.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Faults of a row; the first two must go.
BLANK, DUPLICATE, CUT, FINE = range(4)
INITIALS = "sua"
BLANKS = r"\x20\x09-\x0D"
#: No conversation yet; a null id is one.
NONE = object()


def _moves() -> list[list[list[tuple[str, int, int, int]]]]:
    """By code (4 * initial + fault; the last: no row left) and state: edit, cost, rows consumed, next state, in ASCII order."""
    kept = {(START, "s"): SYSTEM} | {(q, "u"): USER for q in (START, SYSTEM, ASSISTANT)} | {(USER, "a"): ASSISTANT}
    out = []
    for initial in [*INITIALS, ""]:
        for fault in range(4):
            extra = TRUNCATED if fault == CUT else 0
            states = []
            for q in range(4):
                moves = [("D", DELETE, 1, q), ("I", INSERT, 0, AFTER[q])]
                if fault > DUPLICATE:
                    if (q, initial) in kept:
                        moves.append(("K", extra, 1, kept[q, initial]))
                    moves.append(("R", REROLE + extra, 1, AFTER[q]))
                states.append(moves)
            out.append(states)
    return [*out, [[("I", INSERT, 0, AFTER[q])] for q in range(4)]]


MOVES = _moves()
END = len(MOVES) - 1


def estimates(codes: bytes | list[int]) -> list[int]:
    """For each place the cost of the cheapest edits of the rows from there on, whatever role stands before them."""
    far = 1 << 60
    cost = [0 if q in ACCEPTED else far for q in range(4)]
    out = [0] * (len(codes) + 1)
    for at in range(len(codes), -1, -1):
        if at < len(codes):
            cost = [min(c + cost[to] for _, c, rows, to in MOVES[codes[at]][q] if rows) for q in range(4)]
        for _ in range(2):  # more than two inserted turns lead back to the same state
            cost = [min(cost[q], INSERT + cost[AFTER[q]]) for q in range(4)]
        out[at] = min(cost)
    return out


def cheapest(codes: bytes | list[int]) -> tuple[int, str]:
    """Cost and edits of the cheapest repair; of equally cheap ones, the least in ASCII order."""
    need = [h for h in estimates(codes) for _ in range(4)]
    codes = [*codes, END]
    last = len(codes) - 1
    while True:
        bound = need[START]
        path: list[str] = []
        # place, state, budget, moves still to try, least cost known so far
        stack = [[0, START, bound, iter(MOVES[codes[0]][START]), 1 << 60]]
        while stack:
            frame = stack[-1]
            at, q, left, moves, least = frame
            if at == last and q in ACCEPTED:
                return bound, "".join(path)
            for edit, cost, rows, to in moves:
                wants = need[4 * (at + rows) + to] + cost
                if wants <= left:
                    path.append(edit)
                    stack.append([at + rows, to, left - cost, iter(MOVES[codes[at + rows]][to]), 1 << 60])
                    frame[4] = least
                    break
                least = min(least, wants)
            else:
                stack.pop()
                need[4 * at + q] = max(need[4 * at + q], least)
                if stack:
                    edit, above = path.pop(), stack[-1]
                    cost = next(c for e, c, _, _ in MOVES[codes[above[0]]][above[1]] if e == edit)
                    above[4] = min(above[4], cost + need[4 * at + q])


def faulty(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, tie (a hash of role and text) and, but for repeats, fault of each row; nulls in role and text are one space."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    out = rows.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"))
    tie = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return out.withColumn("tie", tie).withColumn("fault", first_fault("text"))


def first_fault(text: Column | str) -> Column:
    """Blank, truncated or fine, by the text alone."""
    last = F.regexp_extract(text, f"([^{BLANKS}])[{BLANKS}]*\\z", 1)
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)


def plan(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (long) and audit (the edits) of each conversation of ``rows``.

    Rows stand in order of turn, nulls first; rows of one turn in order of a hash of role and text, so that equal ones are
    neighbours. A null role or text is one space; rows with a null id are one conversation. A row's first fault counts: blank,
    duplicate (role and text seen earlier), truncated. ``gaps`` are the turns missing between the first and the last.
    ``illegal`` counts neighbours whose initials aren't su, ua or au. A row without a role can't be kept as it is. Empty
    tables give no rows. Columns of other names are not read.
    """
    ship(rows.sparkSession)
    found = faulty(rows, key, turn, role, text)
    code = F.when(F.substring("role", 1, 1) == "", 3)
    for i, initial in enumerate(INITIALS):
        code = code.when(F.substring("role", 1, 1) == initial, i)
    narrow = found.select("conv_id", "turn", "tie", (4 * code.otherwise(3) + F.col("fault")).cast("int").alias("code"))
    # the partitioning by conversation serves the window, too
    narrow = narrow.repartition("conv_id").withColumn("seen", F.expr("row_number() over (partition by conv_id, tie order by turn nulls first)") > 1)
    kind = dict(narrow.dtypes)["conv_id"]
    ordered = narrow.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "tie", "seen").select("conv_id", "turn", "code", "seen")
    ids = to_arrow_type(ordered.schema["conv_id"].dataType)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(batches):
        answers: list[tuple] = []
        for conv, turns, codes in _conversations(batches):
            cost, audit = cheapest(codes)
            counts = [sum(1 for c in codes if c % 4 == f) for f in (BLANK, DUPLICATE, CUT)]
            illegal = sum((a // 4, b // 4) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
            answers.append((conv, turns, *counts, illegal, cost, audit))
            if len(answers) == 4096:
                yield _batch(answers, ids, names)
                answers = []
        if answers:
            yield _batch(answers, ids, names)

    return ordered.mapInArrow(run, schema)


LEGAL = {(INITIALS.index(a), INITIALS.index(b)) for a, b in ("su", "ua", "au")}


def _batch(rows: list[tuple], ids: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), ids), *(pa.array(list(c)) for c in columns[1:])], names=names)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, bytearray]]:
    """Of each conversation the id, the turns missing, and a code for each row."""
    known, codes, low, high, turns = NONE, bytearray(), None, None, 0
    for batch in batches:
        for conv, turn, code, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != known:
                if known is not NONE:
                    yield known, high - low + 1 - turns if turns else 0, codes
                known, codes, low, high, turns = conv, bytearray(), None, None, 0
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            if seen and code % 4 != BLANK:
                code = code - code % 4 + DUPLICATE
            codes.append(code)
    if known is not NONE:
        yield known, high - low + 1 - turns if turns else 0, codes


def _edited(rows: DataFrame, plans: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows of each conversation in order, its edits before them (``first``)."""
    found = faulty(rows, key, turn, role, text).select("conv_id", F.lit(True).alias("row"), "turn", "tie", "role", "text")
    heads = plans.select("conv_id", F.lit(False).alias("row"), F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("tie"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = found.union(heads).repartition("conv_id")
    return both.sortWithinPartitions(F.asc_nulls_first("conv_id"), "row", F.asc_nulls_first("turn"), "tie").select("conv_id", "row", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str, str]]:
    """The repaired turns: id, edit, role, text. A conversation's end has no edit."""
    known, edits, at, before = NONE, "", 0, START

    def inserted():
        nonlocal at, before
        while at < len(edits) and edits[at] == "I":
            yield known, "I", NEXT[before], ""
            at, before = at + 1, AFTER[before]

    for batch in slices(batches):
        for conv, is_row, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not is_row:
                if known is not NONE:
                    yield from inserted()
                    yield known, None, "", ""
                known, edits, at, before = conv, text, 0, START
                continue
            yield from inserted()
            edit, at = edits[at], at + 1
            if edit == "K":
                before = SYSTEM if role[0] == "s" else AFTER[before]
                yield known, edit, role, text
            elif edit == "R":
                yield known, edit, NEXT[before], text
                before = AFTER[before]
    if known is not NONE:
        yield from inserted()
        yield known, None, "", ""


def repaired(rows: DataFrame, plans: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the turns that stay or are inserted; ``plans`` as :func:`plan` gives them for ``rows``."""
    ship(rows.sparkSession)
    ordered = _edited(rows, plans, key, turn, role, text)
    kind, ids = dict(ordered.dtypes)["conv_id"], to_arrow_type(ordered.schema["conv_id"].dataType)
    names = ["conv_id", "place", "edit", "role", "text"]

    def run(batches):
        out, place = [], 0
        for conv, edit, role_, text_ in _turns(batches):
            if edit is None:
                place = 0
                continue
            out.append((conv, place, edit, role_, text_))
            place += 1
            if len(out) == 1024:
                yield _batch(out, ids, names)
                out = []
        if out:
            yield _batch(out, ids, names)

    return ordered.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, plans: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, repaired_sha256: of each planned conversation's repaired ``role:text``, joined by line breaks."""
    ship(rows.sparkSession)
    ordered = _edited(rows, plans, key, turn, role, text)
    kind, ids = dict(ordered.dtypes)["conv_id"], to_arrow_type(ordered.schema["conv_id"].dataType)
    names = ["conv_id", "repaired_sha256"]

    def run(batches):
        digest, some, out = hashlib.sha256(), False, []
        for conv, edit, role_, text_ in _turns(batches):
            if edit is not None:
                digest.update(f"{chr(10) if some else ''}{role_}:{text_}".encode())
                some = True
                continue
            out.append((conv, digest.hexdigest()))
            digest, some = hashlib.sha256(), False
            if len(out) == 4096:
                yield _batch(out, ids, names)
                out = []
        if out:
            yield _batch(out, ids, names)

    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", kinds: int = 20) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` with faults put in, by crc32 of "conv_id:turn" modulo ``kinds``.

    0 drops a row, 1 empties its text, 2 removes the text's ``. ! ?``, 3 repeats the row, 4 makes its role user. A null, in the
    id and the turn of the hashed text too, is one space.
    """
    space = F.lit(" ")
    known = [F.coalesce(F.col(c).cast("string"), space) for c in (key, turn)]
    kind = F.crc32(F.concat(known[0], F.lit(":"), known[1]).cast("binary")) % kinds
    role_, text_ = (F.coalesce(F.col(c).cast("string"), space) for c in (role, text))
    hurt = rows.select(
        F.col(key).alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"), kind.alias("kind")
    ).filter("kind <> 0")
    text_ = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return hurt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), again.alias("copy")).drop("copy")


def repair(rows: DataFrame, originals: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`plan` and :func:`digests` for every id of ``originals``; one without rows has zeros, no edits and the empty text's hash."""
    plans = written(plan(rows, key, turn, role, text), "plans")
    hashes = digests(rows, plans, key, turn, role, text)
    # one row per conversation on both sides; a null id is one, too
    both = plans.join(hashes.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id"))).drop("__id")
    every = originals.select(F.col(key).alias("__id")).distinct()
    joined = every.join(both, F.col("__id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("__id", "conv_id")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
