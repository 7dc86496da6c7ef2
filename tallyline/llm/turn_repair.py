"""Repair of conversation structure: the cheapest edits after which roles alternate as they should.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. A row may be kept (0), given
the role user or assistant (3) or deleted (4; blank and repeated rows must go), an empty row of one of these
roles may be put in anywhere (3), and an unfinished row that stays costs 3 more. Of all cheapest edits those
whose initials (D, I, K, R) come first in ASCII order are chosen.

The optimum is a shortest path over four states (start, after s, after u, after a), solved backwards with
checkpoints only: rows are ordered and dealt into blocks of about the square root of the longest conversation,
each block becomes one matrix of costs from state to state, and the vectors of costs-to-come are folded over the
blocks of a conversation, which leaves one vector at each block's end. Then every block is solved again
from its vector and walked forward along edits that stay on a cheapest path, once from each state; a second fold
picks the walk that the block before leads to. So a conversation of any length is spread over tasks of bounded
memory: texts are reduced to digests, and codes of one character a row, before rows move. Only the repaired texts
of a conversation are brought together, as a stream in order.

Order: by turn (nulls first); rows that share a turn by role, then by digest of role and text. Edge cases: null
roles and texts count as one space, so such a text is blank and such a role is never kept; a null id is a
conversation of its own; repeated rows are repeated texts, of which the first stays; an empty table gives an
empty result; columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table, written

COLUMNS = ("conv_id", "turn", "role", "text")
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
NEVER = 1 << 40
# States: start, after s, after u, after a. By state: the state an inserted (or re-roled) row leads to, its role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
# Costs from each state at the end of a conversation; rows to insert there.
FINAL = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
# Codes of a row: initial (s, u, a, other) x fault (none, to delete, unfinished).
INITIALS, CODES = "sua", "abcdefghijkl"
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
LEAST_BLOCK_BITS = 8


def _step(code: int) -> np.ndarray:
    """Costs from state to state over one row, without insertions."""
    initial, fault = (*INITIALS, "")[code // 3], code % 3
    costs = np.full((4, 4), NEVER, dtype=np.int64)
    for q in range(4):
        costs[q, q] = DELETE
        if fault != 1:
            more = UNFINISHED * (fault == 2)
            costs[q, NEXT[q]] = min(costs[q, NEXT[q]], REROLE + more)
            if q in KEPT[initial]:
                to = KEPT[initial][q]
                costs[q, to] = min(costs[q, to], more)
    return costs


STEPS = np.stack([_step(c) for c in range(12)])
KEEP_TO = np.array([[-1 if c % 3 == 1 else KEPT[(*INITIALS, "")[c // 3]].get(q, -1) for q in range(4)] for c in range(12)])
EXTRA = np.array([UNFINISHED * (c % 3 == 2) for c in range(12)])


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state (last axis but one) when rows may be inserted first; two suffice to reach any state."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[..., NEXT, :])
    return costs


# With insertions before the row.
MATRICES = _closed(STEPS)


def _padded(blocks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all blocks side by side (-1 behind the end) and the lengths."""
    lengths = np.array([len(b) for b in blocks])
    codes = np.full((len(blocks), max(1, int(lengths.max(initial=0)))), -1, dtype=np.int64)
    for i, block in enumerate(blocks):
        codes[i, :len(block)] = np.frombuffer(block.encode(), dtype=np.uint8) - ord("a")
    return codes, lengths


def _even_groups(blocks: Sequence[str], cells: int = 200_000) -> Iterator[np.ndarray]:
    """Places of blocks of similar length, at most ``cells`` codes together."""
    order = np.argsort([len(b) for b in blocks], kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * max(1, len(blocks[order[end]])) <= cells and len(blocks[order[end]]) <= 2 * len(blocks[order[start]]) + 8:
            end += 1
        yield order[start:end]
        start = end


def block_matrices(blocks: Sequence[str]) -> np.ndarray:
    """Costs from state to state over each block, flat: 16 numbers a block."""
    out = np.zeros((len(blocks), 4, 4), dtype=np.int64)
    unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for group in _even_groups(blocks):
        codes, lengths = _padded([blocks[i] for i in group])
        now = np.repeat(unit[None], len(group), axis=0)
        for t in range(codes.shape[1]):
            through = (now[:, :, :, None] + MATRICES[np.maximum(codes[:, t], 0)][:, None]).min(axis=2)
            now = np.where((lengths > t)[:, None, None], np.minimum(through, NEVER), now)
        out[group] = now
    return out.reshape(len(blocks), 16)


def block_walks(blocks: Sequence[str], ends: np.ndarray) -> tuple[np.ndarray, list[list[str]]]:
    """(exit states, edits) of each block from each of the four states; ``ends`` are the costs behind each block."""
    exits, edits = np.zeros((len(blocks), 4), dtype=np.int64), [[""] * 4 for _ in blocks]
    for group in _even_groups(blocks, 50_000):
        codes, lengths = _padded([blocks[i] for i in group])
        n, steps = codes.shape
        to_come = np.zeros((steps + 1, n, 4), dtype=np.int64)
        to_come[steps] = ends[group]
        for t in range(steps - 1, -1, -1):
            one = (MATRICES[np.maximum(codes[:, t], 0)] + to_come[t + 1][:, None, :]).min(axis=2)
            to_come[t] = np.where((lengths > t)[:, None], one, to_come[t + 1])
        row = np.repeat(np.arange(n), 4)
        state = np.tile(np.arange(4), n)
        marks = np.zeros((n * 4, steps * 3), dtype=np.uint8)
        following = np.array(NEXT)
        for t in range(steps):
            live = (lengths > t)[row]
            code = np.maximum(codes[row, t], 0)
            after = to_come[t + 1]
            for slot in range(2):
                have = to_come[t][row, state]
                # D comes before I, and I before what else may be done with the row.
                inserted = live & (DELETE + after[row, state] != have) & (INSERT + to_come[t][row, following[state]] == have)
                marks[inserted, 3 * t + slot] = ord("I")
                state = np.where(inserted, following[state], state)
            have = to_come[t][row, state]
            deleted = DELETE + after[row, state] == have
            to = KEEP_TO[code, state]
            kept = ~deleted & (to >= 0) & (EXTRA[code] + after[row, np.maximum(to, 0)] == have)
            rerole = ~deleted & ~kept
            marks[live, 3 * t + 2] = np.select([deleted, kept, rerole], [ord("D"), ord("K"), ord("R")])[live]
            moved = np.select([deleted, kept], [state, to], following[state])
            state = np.where(live, moved, state)
        exits[group] = state.reshape(n, 4)
        for i, place in enumerate(group):
            edits[place] = [line[line > 0].tobytes().decode() for line in marks[4 * i:4 * i + 4]]
    return exits, edits


# --- DataFrame steps ----------------------------------------------------------------------------


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def ordered(rows: DataFrame) -> DataFrame:
    """(place, conv_id, turn, content, initial, blank, unfinished): rows in order, without their texts.

    ``place`` ascends over the whole table; its high bits name the range partition.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+$", 1)
    narrow = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    narrow = narrow.select(
        "conv_id", "turn", "role", _content().alias("content"), F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("unfinished"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "content"]
    placed = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    return written(placed, "turns-ordered")


def _content() -> Column:
    """Digest of role and text; the length keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def blocks_of(placed: DataFrame, bits: int) -> DataFrame:
    """(conv_id, block, codes, first, last, illegal, blank, duplicate, truncated), one row per block."""
    # The first row of each content; as a table of unique places it joins without a hot key.
    firsts = placed.groupBy("conv_id", "content").agg(F.min("place").alias("_first")).select("_first")
    rows = placed.join(firsts, F.col("place") == F.col("_first"), "left").select(
        "conv_id", "place", "initial", "blank", (F.col("_first").isNull() & ~F.col("blank")).alias("duplicate"), "unfinished")
    fault = F.when(F.col("blank") | F.col("duplicate"), 1).when(F.col("unfinished"), 2).otherwise(0)
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = F.substring(F.lit(CODES), kind * 3 + fault + 1, F.lit(1))
    gathered = rows.select("conv_id", F.shiftright("place", bits).alias("block"), "place", code.alias("code"), "blank",
                           "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("unfinished")).alias("truncated")
                           ).groupBy("conv_id", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda r: r["code"]).alias("_codes"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    letters = F.transform("_codes", lambda c: F.translate(c, CODES, "sssuuuaaa---"))
    return gathered.select(
        "conv_id", "block", F.array_join("_codes", "").alias("codes"), F.get(letters, F.lit(0)).alias("first"),
        F.element_at(letters, -1).alias("last"), _illegal(letters).alias("illegal"), "blank", "duplicate", "truncated")


def _illegal(letters: Column) -> Column:
    """Neighbours of an array of initials other than su, ua and au."""
    pairs = F.zip_with(F.slice(letters, F.lit(1), F.size(letters) - 1), F.slice(letters, F.lit(2), F.size(letters)),
                       lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")


def _matrices(codes: pd.Series) -> pd.Series:
    return pd.Series(list(block_matrices(codes.tolist())), index=codes.index)


def _walks(codes: pd.Series, ends: pd.Series) -> pd.DataFrame:
    exits, edits = block_walks(codes.tolist(), np.array([list(e) for e in ends], dtype=np.int64).reshape(-1, 4))
    return pd.DataFrame({"exits": list(exits), "edits": edits}, index=codes.index)


def _before(matrix: Column, vector: Column) -> Column:
    """Costs-to-come before a block, from those behind it."""
    return F.array(*[
        F.least(*[F.get(matrix, F.lit(4 * q + p)) + F.get(vector, F.lit(p)) for p in range(4)]) for q in range(4)])


def _constant(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def audits(placed: DataFrame, bits: int) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit), one row per conversation with rows."""
    solved = written(blocks_of(placed, bits).withColumn("matrix", F.pandas_udf(_matrices, "array<long>")("codes")), "turn-blocks")
    # Checkpoints: a conversation's blocks from the last to the first, about the square root of its rows.
    ahead = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "matrix")), asc=False).alias("blocks"))
    vectors = F.aggregate(
        "blocks", F.struct(_constant(FINAL).alias("vector"), F.array().cast("array<struct<block:long,ends:array<long>>>").alias("done")),
        lambda acc, b: F.struct(_before(b["matrix"], acc["vector"]).alias("vector"),
                                F.concat(acc["done"], F.array(F.struct(b["block"].alias("block"), acc["vector"].alias("ends")))).alias("done")))
    alone = F.array(F.struct(F.get("blocks", F.lit(0))["block"].alias("block"), _constant(FINAL).alias("ends")))
    checkpoints = ahead.select("conv_id", F.explode(F.when(F.size("blocks") == 1, alone).otherwise(vectors["done"])).alias("_c"))
    checkpoints = checkpoints.select(F.col("conv_id").alias("_conv"), F.col("_c.block").alias("_block"), "_c.ends")
    walked = solved.join(checkpoints, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    walk = F.pandas_udf(_walks, "struct<exits:array<long>,edits:array<string>>")
    walked = walked.withColumn("walk", walk("codes", "ends"))
    cost = F.least(*[F.get("matrix", F.lit(p)) + F.get("ends", F.lit(p)) for p in range(4)])
    forward = walked.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "walk.exits", "walk.edits", "first", "last"))).alias("blocks"),
        F.min_by(cost, "block").alias("cost"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    borders = F.zip_with(F.slice("blocks", F.lit(1), F.size("blocks") - 1), F.slice("blocks", F.lit(2), F.size("blocks")),
                         lambda a, b: F.concat(a["last"], b["first"]))
    path = F.aggregate(
        "blocks", F.struct(F.lit(0).cast("long").alias("state"), F.array().cast("array<string>").alias("edits")),
        lambda acc, b: F.struct(F.get(b["exits"], acc["state"].cast("int")).alias("state"),
                                F.concat(acc["edits"], F.array(F.get(b["edits"], acc["state"].cast("int")))).alias("edits")))
    return forward.withColumn("_path", path).select(
        "conv_id", "blank", "duplicate", "truncated",
        (F.col("illegal") + F.size(F.filter(borders, lambda p: ~p.isin("su", "ua", "au")))).alias("illegal"), "cost",
        F.concat(F.array_join("_path.edits", ""), F.get(F.array(*map(F.lit, TAIL)), F.col("_path.state").cast("int"))).alias("audit"))


def block_bits(rows: DataFrame, least: int = LEAST_BLOCK_BITS) -> int:
    """Bits of a place within its block: about the square root of the rows of the longest conversation."""
    longest = rows.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    return max(least, math.ceil(math.log2(longest) / 2))


def audit(rows: DataFrame, least: int = LEAST_BLOCK_BITS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.

    ``audit`` spells the edits: K, R, D for the rows in order, I where a row is put in.
    """
    placed = ordered(rows.select(*COLUMNS))
    # Counted by turn first, so that a long conversation is counted in many places.
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    turns = turns.withColumnRenamed("conv_id", "_conv")
    return audits(placed, block_bits(placed, least)).join(turns, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _streams(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, as one sorted stream per partition."""
    plain = rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))
    both = audited.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.col("audit").alias("text"), F.lit(None).cast("binary").alias("content"), F.lit(0).alias("part")
                          ).unionByName(plain.select("*", _content().alias("content"), F.lit(1).alias("part")))
    return both.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "part", F.col("turn").asc_nulls_first(), "role", "content"
    ).select(F.col("conv_id").cast("string").alias("conv_id"), "part", "role", "text")  # whole numbers beside nulls


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv_id, role, text) of the repaired rows, and (conv_id, None, None) at each conversation's end.

    One conversation's audit and one batch of rows are held at a time.
    """
    conv, edits, at, state = None, None, 0, 0

    def inserted():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            yield conv, ROLE[state], ""
            at, state = at + 1, NEXT[state]

    for frame in frames:
        for i, part, role, text in zip(frame["conv_id"].tolist(), frame["part"].tolist(), frame["role"].tolist(), frame["text"].tolist()):
            if part == 0:
                if edits is not None:
                    yield from inserted()
                    yield conv, None, None
                conv, edits, at, state = i, text, 0, 0
                continue
            yield from inserted()
            edit = edits[at]
            at += 1
            if edit == "K":
                yield conv, role, text
                state = KEPT[role[0]][state]
            elif edit == "R":
                yield conv, ROLE[state], text
                state = NEXT[state]
    if edits is not None:
        yield from inserted()
        yield conv, None, None


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the rows of the repaired conversations, from 0."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        position, edited = 0, _edited(frames)
        while chunk := list(itertools.islice(edited, 5_000)):
            out = []
            for conv, role, text in chunk:
                if role is None:
                    position = 0
                    continue
                out.append((conv, position, role, text))
                position += 1
            yield pd.DataFrame(out, columns=["conv_id", "position", "role", "text"])

    made = _streams(rows, audited).mapInPandas(run, "conv_id string, position long, role string, text string")
    return made.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): digest of the repaired ``role:text`` lines, taken as they stream by."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, between, edited = hashlib.sha256(), b"", _edited(frames)
        while chunk := list(itertools.islice(edited, 5_000)):
            out = []
            for conv, role, text in chunk:
                if role is None:
                    out.append((conv, digest.hexdigest()))
                    digest, between = hashlib.sha256(), b""
                else:
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])

    made = _streams(rows, audited).mapInPandas(run, "conv_id string, repaired_sha256 string")
    return made.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after a damage that follows from id and turn: some dropped, emptied, unfinished, repeated, re-roled."""
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    text, fault = _text("text"), F.crc32(F.encode(key, "UTF-8")) % 20
    marked = rows.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(_text("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        fault.alias("_fault"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.filter("_fault != 0").withColumn("_copy", F.explode(copies)).drop("_fault", "_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    rows = damaged(original)
    audited = written(audit(rows), "audits")
    found = audited.join(digests(rows, audited).withColumnRenamed("conv_id", "_conv"),
                         F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    return over_all(original, found)


def over_all(original: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with a row for each original conversation: zeros where no row is left."""
    every = original.select(F.col("conv_id").alias("_every")).distinct()
    joined = every.join(found, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("_every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
