import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from calendrix.llm import conversations

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        by = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if by:
            text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
            out += [(conv, turn, "user" if by == 4 else role, text)] * (2 if by == 3 else 1)
    return out


def plain_repair(turns):
    """(cost, audit, lines) of ordered (role, text, fault) by dynamic programming over all outputs."""

    @lru_cache(None)
    def best(at, state, inserted):
        """Least (cost, audit, roles) from here on; inserts are bounded, as two in a row suffice."""
        options = [(0, "", ())] if at == len(turns) and state in ("", "a") else []
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if at < len(turns):
            role, text, fault = turns[at]
            rest = best(at + 1, state, 0)
            options.append((rest[0] + 4, "D" + rest[1], rest[2]))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in allowed:
                    rest = best(at + 1, role[:1], 0)
                    options.append((rest[0] + more, "K" + rest[1], (f"{role}:{text}", *rest[2])))
                for new in ("user", "assistant"):
                    if new[0] in allowed:
                        rest = best(at + 1, new[0], 0)
                        options.append((rest[0] + more + 3, "R" + rest[1], (f"{new}:{text}", *rest[2])))
        if inserted < 3:
            for new in ("user", "assistant"):
                if new[0] in allowed:
                    rest = best(at, new[0], inserted + 1)
                    options.append((rest[0] + 3, "I" + rest[1], (f"{new}:", *rest[2])))
        return min(options, default=(10**9, "", ()))

    return best(0, "", 0)


def plain_report(rows):
    damaged, out = plain_damage(rows), {}
    for conv in {r[0] for r in rows}:
        own = [r for r in damaged if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, turns = set(), []
        for _, _, role, text in own:
            core = text.strip(SPACE)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = {r[1] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = plain_repair(turns)
        count = lambda f: sum(t[2] == f for t in turns)  # noqa: E731, B023
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(n=120, seed=3):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No", "Why?", " ", "", "Go on!\n", "so ...\t", "Fine. then", None, "x" * 200_000 + "."]
    for conv in range(n):
        for turn in sorted(rng.sample(range(-2, 14), rng.randrange(1, 9))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "User"])
            rows.append((conv if conv else None, turn if rng.random() < 0.95 else None, role, rng.choice(texts[:-1] if rng.random() < 0.98 else texts)))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def as_plain(result):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in result.collect()}


@pytest.mark.parametrize("size", [2, 256])
def test_report_is_the_plain_one(spark, monkeypatch, size):
    """Blocks of two turns are joined into the same repairs as whole conversations are."""
    monkeypatch.setattr(conversations.blocks, "__defaults__", (size,))
    rows = random_rows()
    ids = spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "1 AS hash", "2 AS pieces", "3 AS part")
    got = conversations.report(ids, conversations.damage(ids))
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema] == [
        "conv_id bigint", "gaps bigint", "blank bigint", "duplicate bigint", "truncated bigint", "illegal bigint", "cost bigint", "audit string", "repaired_sha256 string",
    ]
    assert as_plain(got) == plain_report(rows)


def test_search_is_the_plain_one_for_all_short_conversations():
    kinds = {"s": ("system", "x.", ""), "u": ("user", "x.", ""), "a": ("assistant", "x.", ""), "o": ("tool", "x.", ""), "U": ("user", "x", "truncated"),
             "A": ("assistant", "x", "truncated"), "x": ("user", "", "blank")}
    for n in range(5):
        for codes in map("".join, itertools.product(kinds, repeat=n)):
            cost, audit, lines = plain_repair(tuple(kinds[c] for c in codes))
            assert conversations.repair(codes) == (cost, audit)
            assert GRAMMAR.match("".join(line[0] for line in lines))
            if n >= 2:
                joined, pieces = conversations.join_blocks(conversations.block_paths(c) for c in (codes[:1], codes[1:]))
                assert (joined, "".join(p for _, p in pieces)) == (cost, audit)


def test_one_long_conversation_spans_blocks_and_tasks(spark):
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"Turn {t % 1900}" + rng.choice([".", "", "!"])) for t in range(2000)] + [(8, 1, "user", "Alone.")]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = conversations.blocks(turns, 64)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.where("conv_id = 7").select("part").distinct().count() > 1
    edits = conversations.decided(found)
    out = conversations.repaired(turns, found, edits).orderBy("conv_id", "position").collect()
    seen, plain = set(), []
    for _, _, role, text in rows[:-1]:
        plain.append((role, text, "duplicate" if (role, text) in seen else "" if text[-1] in ".!" else "truncated"))
        seen.add((role, text))
    codes = "".join("x" if f == "duplicate" else r[0].upper() if f else r[0] for r, _, f in plain)
    cost, audit = conversations.repair(codes)
    row = edits.where("conv_id = 7").first()
    assert (row.cost, "".join(p.edits for p in row.pieces)) == (cost, audit)
    own = [r for r in out if r.conv_id == 7]
    assert [r.position for r in own] == list(range(1, len(own) + 1))
    assert GRAMMAR.match("".join(r.role[0] for r in own))
    kept = iter(plain)
    expected = [(None if k == "I" else next(kept), k) for k in audit]
    assert [t[1] if t else "" for t, k in expected if k != "D"] == [r.text for r in own]
    assert [(r.position, r.role, r.text) for r in out if r.conv_id == 8] == [(1, "user", "Alone."), (2, "assistant", "")]


def test_empty_table_and_dropped_conversations(spark):
    gone = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    ids = spark.createDataFrame([(gone, 0, "user", "All dropped.")], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert as_plain(conversations.report(ids, conversations.damage(ids))) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert conversations.report(ids.limit(0), conversations.damage(ids.limit(0))).count() == 0
