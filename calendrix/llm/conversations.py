"""Conversation structure repair: cheapest edits that make turns alternate, found by Dijkstra.

A conversation is well formed if its roles' initials spell (s?(ua)+)?. Its edit lattice has a node for
each (turn index, grammar state); Keep, Rerole, Delete and Insert are its edges, which are made only
where the search gets. The queue's key is (cost, audit), the audit being the edits' initials so far,
so that the first accepting end node popped is the cheapest repair and, of equal ones, the
ASCII-least. Two paths of one cost to one node are never each other's prefix (what comes after the
prefix could only be inserts, which cost), so the order of two audits holds for all that follows.

No conversation is collected. Turns are dealt by ranges of (conversation, turn, role, text hash), so one
conversation may span many tasks, and are cut into blocks of BLOCK turns. Each block is solved from
each state that it may be entered in; a conversation of one block is then done, and those of
more are joined block by block, which reads one row for BLOCK turns. Only equal rows of one turn must share
a task, which holds one of its blocks at a time.

Rows: a null role, text or id counts as one space where it is hashed or repaired, null turns come first. Rows
of one turn follow each other by role and then by the SHA-256 of their text, so repeated rows are neighbours.
A role without a first character of s, u or a (another role, an empty one) can't be kept. Conversations
without rows have no faults, no edits and an empty repair; a null conv_id is a conversation of its own.
Texts of any length are hashed where they are read and move only to the repaired table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import ASCII_SPACE, written

BLOCK = 256
DELETE, RETAG, INSERT, CUT = 4, 3, 3, 3
#: The grammar (s?(ua)+)?: states are what was last put out ("" is nothing yet).
MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
STATES, ACCEPTING = ("", "s", "u", "a"), ("", "a")
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


# -- the lattice ------------------------------------------------------------------------------------


def _edits(state: str, code: str):
    """(cost, letter, state after) of the edits that take one turn. A code is the turn's initial (o:
    another), in upper case if its text is cut off; x if it must be deleted."""
    yield DELETE, "D", state
    if code == "x":
        return
    extra, initial = (CUT, code.lower()) if code.isupper() else (0, code)
    if (state, initial) in MOVES:
        yield extra, "K", initial
    for role in ROLES:
        if role != initial and (state, role) in MOVES:
            yield RETAG + extra, "R", role


def _search(codes: str, start: str, ends: tuple):
    """(state, cost, audit) of the end nodes in the order in which they are popped; stops when all of ends
    have been."""
    queue, done, left = [(0, "", 0, start)], set(), set(ends)
    while queue and left:
        cost, audit, at, state = heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(codes):
            if state in left:
                left.discard(state)
                yield state, cost, audit
        else:
            for more, letter, after in _edits(state, codes[at]):
                if (at + 1, after) not in done:
                    heappush(queue, (cost + more, audit + letter, at + 1, after))
        for role in ROLES:
            if (state, role) in MOVES and (at, role) not in done:
                heappush(queue, (cost + INSERT, audit + "I", at, role))


@lru_cache(1 << 14)
def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a whole conversation: the first accepting end node."""
    return next((cost, audit) for state, cost, audit in _search(codes, "", STATES) if state in ACCEPTING)


@lru_cache(1 << 12)
def block_paths(codes: str) -> tuple[tuple[str, str, int, str], ...]:
    """(state before, state after, cost, audit): the best way through a block for each two states."""
    return tuple((start, *found) for start in STATES for found in _search(codes, start, STATES))


def _earlier(a: tuple, b: tuple) -> bool:
    """Whether audit a comes before b; both are (audit before, piece) links of as many blocks."""
    ours, theirs = [], []
    while a is not b:
        ours.append(a[1])
        theirs.append(b[1])
        a, b = a[0], b[0]
    return "".join(reversed(ours)) < "".join(reversed(theirs))


def join_blocks(blocks) -> tuple[int, list[tuple[str, str]]]:
    """(cost, [(state before, audit) of each block]) of the cheapest repair, of the block_paths of
    consecutive blocks.

    Paths share their past as links, so that about one audit is held and not one for each state.
    """
    front: dict[str, tuple[int, tuple | None]] = {"": (0, None)}
    for paths in blocks:
        then: dict[str, tuple[int, tuple]] = {}
        for start, end, cost, audit in paths:
            if start in front:
                total, link = front[start][0] + cost, (front[start][1], audit, start)
                best = then.get(end)
                if best is None or total < best[0] or total == best[0] and _earlier(link, best[1]):
                    then[end] = (total, link)
        front = then
    best = None
    for state in ACCEPTING:
        if state in front and (
            best is None or front[state][0] < best[0] or front[state][0] == best[0] and _earlier(front[state][1], best[1])
        ):
            best = front[state]
    pieces, link = [], best[1]
    while link:
        pieces.append((link[2], link[1]))
        link = link[0]
    return best[0], pieces[::-1]


# -- turns ------------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, chosen by crc32(conv_id:turn) % 20: 0 drops the row,
    1 empties its text, 2 takes out its [.!?], 3 repeats it, 4 makes its role user."""
    word = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    by = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), by.alias("by")).where("by != 0")
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _whole(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, hash): nulls as one space."""
    word = lambda c: F.coalesce(turns[c].cast("string"), F.lit(" "))
    return turns.select("conv_id", turns["turn"].cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text")).withColumn(
        "hash", F.unhex(F.sha2("text", 256))
    )


def _order(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull(), F.col(turn))


def _row(role: str) -> Column:
    """A key of conversation, turn, role and text hash; lengths and marks keep the parts apart."""
    parts = [F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col(role), F.hex("hash")]
    told = [F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*told), 256))


def light_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, hash, blank, cut, later) without texts; later: the same role and text stand
    in an earlier turn. (Equal rows of one turn are found where they are neighbours.)"""
    trimmed = F.rtrim("text", F.lit(ASCII_SPACE))
    light = written(
        _whole(turns).select("conv_id", "turn", "role", "hash", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    )
    seen = light.groupBy("conv_id", "role", "hash").agg(F.min(_order()).alias("first"), F.max(_order()).alias("last")).where("first < last")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first")
    met = light.join(seen, light.conv_id.eqNullSafe(seen.c) & (light.role == seen.r) & (light.hash == seen.h), "left")
    return met.select("conv_id", "turn", "role", "hash", "blank", "cut", F.coalesce(_order() > F.col("first"), F.lit(False)).alias("later"))


_PATHS = "array<struct<start:string,end:string,cost:bigint,audit:string>>"
_TURNS = "array<struct<turn:bigint,role:string,hash:binary>>"


def _blocks_of(size: int):
    """For sorted light turns: a row for each block; without ways through it where it is all of a
    conversation, as every one is that begins and ends in the same task's rows and is not longer than a block."""

    def run(batches):
        part, kind, at = TaskContext.get().partitionId(), None, 0
        conv, before, codes, rows, counts, illegal = object(), None, [], [], [0, 0, 0], 0
        whole = False

        def block(ends=True):
            nonlocal at, codes, rows, counts, illegal, whole
            at += 1
            text = "".join(codes)
            ways = () if whole and ends else block_paths(text)
            whole = False
            paths = [dict(zip(("start", "end", "cost", "audit"), p)) for p in ways]
            turns = [{"turn": t, "role": r, "hash": h} for t, r, h in rows]
            out = (conv, part, at, text, *counts, illegal, rows[0][1][:1], rows[-1][1][:1], paths, turns)
            codes, rows, counts, illegal = [], [], [0, 0, 0], 0
            return out

        def made(out):
            types = [kind, pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string()]
            types += [pa.list_(pa.struct([("start", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))]
            types += [pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("hash", pa.binary())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _BLOCK_COLUMNS)

        for batch in batches:
            kind, out = batch["conv_id"].type, []
            for conv_id, turn, role, digest, blank, cut, later in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "hash", "blank", "cut", "later"))):
                if conv_id != conv or len(codes) == size:
                    if codes:
                        out.append(block(ends=conv_id != conv))
                    if conv_id != conv:
                        # The first one here may have begun in the task before.
                        whole, conv, before = at > 0, conv_id, None
                again = later or (turn, role, digest) == before
                initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
                counts[0] += blank
                counts[1] += again and not blank
                counts[2] += cut and not again and not blank
                codes.append("x" if blank or again else initial.upper() if cut else initial)
                if rows:
                    illegal += rows[-1][1][:1] + role[:1] not in LEGAL
                rows.append((turn, role, digest))
                before = (turn, role, digest)
            if out:
                yield made(out)
        if codes:
            yield made([block(ends=False)])  # it may go on in the next task

    return run


_BLOCK_COLUMNS = ["conv_id", "part", "seq", "codes", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths", "turns"]


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """A row for each block of at most size turns, in order of (part, seq), with the ways through it."""
    light = light_turns(turns)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "hash"]
    kind = light.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in ("blank", "duplicate", "truncated", "illegal"))
    schema = f"conv_id {kind}, part int, seq bigint, codes string, {counts}, first string, last string, paths {_PATHS}, turns {_TURNS}"
    return written(written(light).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks_of(size), schema))


_PIECES = [("part", pa.int32()), ("seq", pa.int64()), ("state", pa.string()), ("at", pa.int64()), ("edits", pa.string())]
_DECIDED = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "pieces"]


def _join_runs(batches):
    """For blocks sorted by conversation, part and seq: a row for each conversation."""
    conv, held, sums, last, kind = object(), [], [0] * 4, "", None

    def whole():
        if len(held) == 1:
            cost, audit = repair(held[0][2])
            ways = [("", audit)]
        else:
            cost, ways = join_blocks(paths for *_, paths in held)
        pieces, at = [], 0
        for (part, seq, *_), (state, audit) in zip(held, ways):
            pieces.append({"part": part, "seq": seq, "state": state, "at": at, "edits": audit})
            at += len(audit) - audit.count("D")
        return (conv, *sums, cost, pieces)

    def made(out):
        types = [kind, *[pa.int64()] * 5, pa.list_(pa.struct(_PIECES))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _DECIDED)

    for batch in batches:
        kind, out = batch["conv_id"].type, []
        names = ("conv_id", "part", "seq", "codes", "paths", "first", "last", "blank", "duplicate", "truncated", "illegal")
        for conv_id, part, seq, codes, paths, first, end, *counts in zip(*(batch[c].to_pylist() for c in names)):
            if conv_id != conv:
                if held:
                    out.append(whole())
                conv, held, sums = conv_id, [], [0] * 4
            elif last + first not in LEGAL:
                sums[3] += 1
            held.append((part, seq, codes, [tuple(p[k] for k in ("start", "end", "cost", "audit")) for p in paths]))
            sums = [a + b for a, b in zip(sums, counts)]
            last = end
        if out:
            yield made(out)
    if held:
        yield made([whole()])


def decided(found: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, pieces): the edits of each conversation of
    blocks(), with the state and the number of turns put out before each block.

    One row for each block goes to its conversation's task; the edits, a character for each turn,
    are one value of the result by its definition.
    """
    kind = found.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _DECIDED[1:-1])
    light = found.drop("turns").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    pieces = "array<struct<part:int,seq:bigint,state:string,at:bigint,edits:string>>"
    return written(light.mapInArrow(_join_runs, f"conv_id {kind}, {counts}, pieces {pieces}"))


_PUT_OUT = ["conv_id", "position", "role", "turn", "old_role", "hash"]


def _put_out(batches):
    """For blocks with their edits: the turns put out, with the key of the turn that gives the text."""
    for batch in batches:
        out = []
        for conv_id, turns, state, at, edits in zip(*(batch[c].to_pylist() for c in ("conv_id", "turns", "state", "at", "edits"))):
            rows = iter(turns)
            for letter in edits:
                row = {"turn": None, "role": None, "hash": None} if letter == "I" else next(rows)
                if letter == "D":
                    continue
                # An edit can set one role in each state: that which may follow.
                state = row["role"][:1] if letter == "K" else next(r for r in ROLES if (state, r) in MOVES)
                at += 1
                out.append((conv_id, at, row["role"] if letter == "K" else ROLES[state], *row.values()))
        types = [batch["conv_id"].type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], _PUT_OUT)


def repaired(turns: DataFrame, found: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns after the repair, positions from 1. Inserted turns are empty.

    Texts meet their turns by a key of the single row, so no conversation's texts go to one task.
    """
    pieces = edits.select(F.explode("pieces").alias("p")).select("p.*")
    kind = found.schema["conv_id"].dataType.simpleString()
    put = found.select("conv_id", "part", "seq", "turns").join(pieces, ["part", "seq"]).select("conv_id", "turns", "state", "at", "edits")
    put = put.mapInArrow(_put_out, f"conv_id {kind}, position bigint, role string, turn bigint, old_role string, hash binary")
    # One key, so that the texts are dealt once for both the distinct ones and the join.
    texts = _whole(turns).select(_row("role").alias("row"), "text").dropDuplicates(["row"])
    # Inserted turns get a key that no text has, each its own, so that they are dealt evenly too.
    none = F.unhex(F.sha2(F.concat(F.lit("insert"), F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.col("position")), 256))
    put = put.select("conv_id", "position", "role", F.when(F.col("hash").isNotNull(), _row("old_role")).otherwise(none).alias("row"))
    return put.join(texts, "row", "left").select("conv_id", "position", "role", F.coalesce("text", F.lit("")).alias("text"))


def _hashed(batches):
    """For turns sorted by conversation and position: the SHA-256 of each conversation."""
    conv, state, kind = object(), None, None

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out], pa.string())], ["conv_id", "sha256"])

    for batch in batches:
        kind, out = batch["conv_id"].type, []
        for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text"))):
            if conv_id != conv:
                if state:
                    out.append((conv, state.hexdigest()))
                conv, state = conv_id, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if out:
            yield made(out)
    if state:
        yield made([(conv, state.hexdigest())])


def hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the role:text lines of repaired(). A hash is one pass over a conversation by its
    definition: its turns stream through one task, which holds none of them."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(_hashed, f"conv_id {kind}, sha256 string")


def gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): whole numbers missing between a conversation's least and greatest turn."""
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn")).distinct()
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return own.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


def report(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conv_id of ids: faults of its turns, the cheapest edits and the repair's SHA-256."""
    found = blocks(turns)
    edits = decided(found)
    out = ids.select("conv_id").distinct()
    audit = F.array_join(F.transform("pieces", lambda p: p["edits"]), "")
    edited = edits.withColumn("audit", audit).drop("pieces")
    for part in (gaps(turns), edited, hashes(repaired(turns, found, edits))):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, out.conv_id.eqNullSafe(part.c), "left").drop("c")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
