from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.llm import turn_repair as T

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = "\x20\t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        shown = text.strip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen
                   else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by exhaustive search over (row, roles so far), any role tried for each edit."""
    fault = faults(rows)
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}  # initials that may follow

    @functools.cache
    def best(i, last, put):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        for role in ("user", "assistant"):
            if put < 4 and role[0] in moves[last]:
                found.append(step(3, "I", (role, ""), best(i, role[0], put + 1)))
        if i < len(rows):
            role, text = rows[i]
            found.append(step(4, "D", None, best(i + 1, last, 0)))
            if fault[i] in ("", "truncated"):
                extra = 3 * (fault[i] == "truncated")
                if role[:1] and role[:1] in moves[last]:
                    found.append(step(extra, "K", (role, text), best(i + 1, role[0], 0)))
                for new in ("user", "assistant"):
                    if new[0] in moves[last]:
                        found.append(step(3 + extra, "R", (new, text), best(i + 1, new[0], 0)))
        return min((f for f in found if f), default=None)

    def step(cost, edit, row, rest):
        return rest and (cost + rest[0], edit + rest[1], ((row,) if row else ()) + rest[2])

    return best(0, "", 0)


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        spell = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(":".join(spell).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def content(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def expected(rows, originals):
    """The contract's row of every conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv in originals:
        own = sorted(groups.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), content(*r[1:])))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [(r, x) for _, r, x in own]
        found = faults(pairs)
        cost, audit, fixed = cheapest(tuple(pairs)) if own else (0, "", ())
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{r}:{x}" for r, x in fixed)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def codes_of(rows):
    kinds = {"s": 0, "u": 1, "a": 2}
    fault = {"": 0, "blank": 1, "duplicate": 1, "truncated": 2}
    return "".join(T.CODES[3 * kinds.get(r[:1], 3) + fault[f]] for (r, _), f in zip(rows, faults(rows)))


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]),
                          st.sampled_from(["", " \n", "a.", "b!", "c", "d?", "e \t", "f."])), max_size=9)


@settings(max_examples=300, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=5), st.integers(1, 4))
def test_blocks_give_the_least_cheapest_edits(conversations, width):
    """Any way of cutting conversations into blocks gives the exhaustive search's answer."""
    for rows in conversations:
        if not rows:
            continue
        codes = codes_of(rows)
        blocks = [codes[i:i + width] for i in range(0, len(codes), width)]
        matrices = T.block_matrices(blocks).reshape(-1, 4, 4)
        ends = [list(T.FINAL)]
        for m in reversed(matrices[1:]):
            ends.insert(0, (m + ends[0]).min(axis=1).tolist())
        exits, edits = T.block_walks(blocks, T.np.array(ends))
        state, text = 0, ""
        for e, x in zip(edits, exits):
            text, state = text + e[state], int(x[state])
        cost, audit, _ = cheapest(tuple(rows))
        assert ((matrices[0] + ends[0]).min(axis=1)[0], text + T.TAIL[state]) == (cost, audit)


def test_query_equals_the_contract(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(damaged_rows(rows), {r[0] for r in rows})
    got = {r["conv_id"]: tuple(r)[1:] for r in T.query(spark, FOLDER).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == want


def hard_rows():
    """Nulls, ties, repeated rows, long texts, one long conversation, ids beyond the floats' whole numbers."""
    draw = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", None, ""], ["", None, "a.", "b", "é!", "x" * 20_000 + "?", "q "]
    rows = [(draw.choice([1, 2, 3, None, (1 << 60) + 1]), draw.choice([None, 0, 1, 2, 3, 9]), draw.choice(roles), draw.choice(texts))
            for _ in range(60)]
    rows += [(77, i, draw.choice(roles[1:3]), f"t{draw.randrange(200)}{draw.choice('.! x')}") for i in range(140)]
    return rows + rows[:10]


@pytest.mark.parametrize("least", [1, 8])
def test_hard_rows(spark, least):
    rows = hard_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("block", "audit", "place", "content", "_conv")})
    audited = T.audit(frame, least).cache()
    want = expected(rows, {r[0] for r in rows})
    got = {r["conv_id"]: tuple(r)[1:] for r in audited.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in T.digests(frame, audited).collect()}
    assert hashes == {k: v[-1] for k, v in want.items()}
    lines = {}
    for r in T.repaired(frame, audited).collect():
        lines.setdefault(r["conv_id"], {})[r["position"]] = f"{r['role']}:{r['text']}"
    for conv, own in lines.items():
        assert sorted(own) == list(range(len(own)))
        assert hashlib.sha256("\n".join(own[i] for i in range(len(own))).encode()).hexdigest() == hashes[conv]
    audited.unpersist()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    audited = T.audit(empty)
    assert audited.count() == 0 and T.repaired(empty, audited).count() == 0 and T.digests(empty, audited).count() == 0
    # A conversation that lost all its rows.
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    original = spark.createDataFrame([(gone, 0, "user", "a."), (None, None, None, None)], SCHEMA)
    rows = T.damaged(original)
    audited = T.audit(rows)
    found = audited.join(T.digests(rows, audited).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    got = {r["conv_id"]: tuple(r)[1:] for r in T.over_all(original, found).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert None in got
