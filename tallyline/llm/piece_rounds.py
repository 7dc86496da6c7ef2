"""SentencePiece BPE by vectorised merge rounds.

All words of a batch lie in one flat symbol array. A round looks up the rank of every neighbouring
pair, takes the smallest rank of each word by a segmented minimum, merges all its occurrences at
once (leftmost first where they overlap) and compacts the array; words without a pair leave it. The
library merges one pair at a time, so a word in which a merge creates a pair of the same or a
better rank repeats its round with the leftmost occurrence alone. Segments of over ``LONG`` symbols (runs
of one character, very long words) leave the rounds, whose number would grow with their length, and are
merged from a heap instead.

Words are cut where no piece of the vocabulary can reach across, which white space is a case of.
Encoded words are remembered up to ``MEMO`` entries per worker; the memo changes no result.

Edge cases: a null text is empty and has no ids; texts may hold any character (what no piece covers
becomes byte pieces); null and repeated ids and repeated rows keep their own rows; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table, vocabulary_path, whole_text

SPACE = "▁"
MEMO = 400_000
# Segments of more symbols are merged pair by pair from a heap.
LONG = 512
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_RANK = np.iinfo(np.int64).max


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each-byte", _each_byte)


class KeyTable:
    """Places of integer keys by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.place = np.zeros(1 << self.bits, dtype=np.int64)
        slot, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):
            self.probes += 1
            free = self.keys[slot[waiting]] < 0
            at, first = np.unique(slot[waiting[free]], return_index=True)
            winners = waiting[free][first]
            self.keys[at], self.place[at] = keys[winners], winners
            waiting = waiting[~np.isin(waiting, winners)]
            slot[waiting] = (slot[waiting] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``wanted`` whose key is known, and the places of those keys."""
        slot = self._slot(wanted)
        seen = self.keys[slot]
        hit = seen == wanted
        open_ = np.flatnonzero(~hit & (seen >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            found = seen == wanted[open_]
            hit[open_[found]] = True
            open_ = open_[~found & (seen >= 0)]
        at = np.flatnonzero(hit)
        return at, self.place[slot[at]]


class PieceModel:
    """Encoder and decoder for a BPE model file with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        normal = spec.normalizer_spec
        if (spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback
                or normal.precompiled_charsmap or normal.remove_extra_whitespaces
                or not normal.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (USER_DEFINED, UNUSED) for p in spec.pieces)):
            raise ValueError("a BPE model with byte fallback, identity normalisation and plain pieces is needed")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        pieces = [p.piece for p in spec.pieces]
        types = [p.type for p in spec.pieces]
        ids = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t == NORMAL}
        self.byte_ids = np.zeros(256, dtype="<i4")
        for i, (p, t) in enumerate(zip(pieces, types)):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i

        # Symbols: the piece ids, then single characters of pieces that are no piece themselves.
        symbols = dict(ids)
        for character in sorted({c for p in ids for c in p} - set(ids)):
            symbols[character] = len(pieces) + len(symbols) - len(ids)
        self.first_unknown = len(pieces)
        self.spare = {v: k for k, v in symbols.items() if v >= len(pieces)}
        self.other = len(pieces) + len(self.spare)  # plus the code point: characters of no piece
        known = np.full(0x110000, -1, dtype=np.int64)
        for p, i in symbols.items():
            if len(p) == 1:
                known[ord(p)] = i
        absent = known < 0
        known[absent] = self.other + np.flatnonzero(absent)
        self.known, self.width = known, self.other + 0x110000

        scores = sorted({-spec.pieces[i].score for i in ids.values()})
        rank_of = {s: r for r, s in enumerate(scores)}
        pairs: list[tuple[int, int, int]] = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs.append((left * self.width + right, i, rank_of[-spec.pieces[i].score]))
        made = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 3)
        self.merged, self.rank = (np.ascontiguousarray(made[:, j]) for j in (1, 2))
        self.pairs = KeyTable(made[:, 0])
        # Neighbouring characters inside any piece: elsewhere no merge can happen.
        self.inside = KeyTable(np.array(
            sorted({ord(a) * 0x110000 + ord(b) for p in ids for a, b in zip(p, p[1:])}), dtype=np.int64))
        split = not any(SPACE in p.lstrip(SPACE) for p in ids)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if split else "(?s:.+)")
        self.texts = [
            b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else
            bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode()
            for p, t in zip(pieces, types)
        ]
        self.types = types
        self.memo: dict[str, bytes] = {}

    # --- encoding -------------------------------------------------------------------------------

    def _rounds(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and the segment each belongs to, in segment order."""
        lengths = np.diff(np.append(starts, len(symbols)))
        segment = np.repeat(np.arange(len(starts)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(lengths > LONG).tolist():
            merged_alone = self._one_by_one(symbols[starts[i]:starts[i] + lengths[i]])
            done.append((merged_alone, np.full(len(merged_alone), i)))
        if done:
            short = (lengths <= LONG)[segment]
            symbols, segment = symbols[short], segment[short]
        rank, merged = self._ranks(symbols, segment)
        while len(symbols):
            first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
            best = np.minimum.reduceat(rank, first)
            word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(symbols))))
            active = (best < NO_RANK)[word]
            if not active.all():
                done.append((symbols[~active], segment[~active]))
                symbols, segment, rank, merged, word = (x[active] for x in (symbols, segment, rank, merged, word))
                if not len(symbols):
                    break
            take = rank == best[word]
            places = np.flatnonzero(take)
            run = np.cumsum(np.append(True, np.diff(places) != 1)) - 1  # overlapping occurrences
            head = places[np.flatnonzero(np.append(True, np.diff(places) != 1))]
            places = places[(places - head[run]) % 2 == 0]
            while True:
                new_symbols = symbols.copy()
                new_symbols[places] = merged[places]
                keep = np.ones(len(symbols), dtype=bool)
                keep[places + 1] = False
                new_segment, new_word = segment[keep], word[keep]
                new_rank, new_merged = self._ranks(new_symbols[keep], new_segment)
                many = np.bincount(word[places], minlength=len(best)) > 1
                early = new_word[(new_rank <= best[new_word]) & many[new_word]]
                # Between two merges side by side, the left one meets the first symbol of the right one.
                side = places[:-1][(np.diff(places) == 2) & (word[places[:-1]] == word[places[1:]])]
                met, at = self.pairs.find(merged[side] * self.width + symbols[side + 2])
                early = np.append(early, word[side[met]][self.rank[at] <= best[word[side[met]]]])
                if not len(early):
                    break
                # A remaining pair as good as the merged one: take these words one merge at a time.
                again = np.zeros(len(best), dtype=bool)
                again[early] = True
                leftmost = np.append(True, word[places][1:] != word[places][:-1])
                places = places[leftmost | ~again[word[places]]]
            symbols, segment, rank, merged = new_symbols[keep], new_segment, new_rank, new_merged
        if not done:
            return symbols, segment
        symbols, segment = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def _one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """Final symbols of one long segment: its pairs wait in a heap by rank and place.

        Rounds would read the whole segment as often as it has different ranks, or, in a run of one
        character whose merges beat those before them, as often as it has merges.
        """
        rank, made = self._ranks(symbols, np.zeros(len(symbols), dtype=np.int64))
        symbol, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[int, tuple[int, int] | None] = {}
        places = np.flatnonzero(rank < NO_RANK)
        heap = [(r, i, symbol[i], symbol[i + 1], m) for r, i, m in zip(rank[places].tolist(), places.tolist(), made[places].tolist())]
        heapq.heapify(heap)

        def wait(i: int, j: int) -> None:
            key = symbol[i] * self.width + symbol[j]
            if key not in known:
                hit, at = self.pairs.find(np.array([key]))
                known[key] = (int(self.rank[at[0]]), int(self.merged[at[0]])) if len(hit) else None
            pair = known[key]
            if pair:
                heapq.heappush(heap, (pair[0], i, symbol[i], symbol[j], pair[1]))

        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two was merged meanwhile
            symbol[i], symbol[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                wait(i, after[i])
            if before[i] >= 0:
                wait(before[i], i)
        final = np.array(symbol, dtype=np.int64)
        return final[final >= 0]

    def _ranks(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(symbols), NO_RANK)
        merged = np.zeros(len(symbols), dtype=np.int64)
        inner = np.flatnonzero(segment[1:] == segment[:-1])
        found, at = self.pairs.find(symbols[inner] * self.width + symbols[inner + 1])
        inner = inner[found]
        rank[inner], merged[inner] = self.rank[at], self.merged[at]
        return rank, merged

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word (a stretch of normalised text)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        begins = np.zeros(len(points) + 1, dtype=bool)
        begins[0] = True
        begins[ends] = True
        cut = begins[:-1].copy()
        if len(points) > 1:
            joined, _ = self.inside.find(points[:-1] * 0x110000 + points[1:])
            apart = np.ones(len(points) - 1, dtype=bool)
            apart[joined] = False
            cut[1:] |= apart
        starts = np.flatnonzero(cut)
        of_word = np.cumsum(begins[:-1]) - 1
        symbols, segment = self._rounds(self.known[points], starts)
        word = of_word[starts][segment]
        unknown = np.flatnonzero(symbols >= self.first_unknown)
        size = np.ones(len(symbols), dtype=np.int64)
        spelled = {}
        for i in unknown.tolist():
            s = int(symbols[i])
            raw = (self.spare[s] if s < self.other else chr(s - self.other)).encode()
            spelled[i] = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
            size[i] = len(raw)
        after = np.cumsum(size)
        out = np.repeat(symbols, size).astype("<i4")
        for i, ids in spelled.items():
            out[after[i] - size[i]:after[i]] = ids
        total = np.cumsum(np.bincount(word, weights=size, minlength=len(words)).astype(np.int64))
        raw, bounds = out.tobytes(), [0, *(4 * total).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end ids."""
        split = [self.words.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in self.memo})
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list({w for words in split for w in words})
        for start in range(0, len(fresh), 50_000):
            part = fresh[start:start + 50_000]
            self.memo.update(zip(part, self.encode_words(part)))
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), dtype="<i4") for words in split]

    # --- decoding -------------------------------------------------------------------------------

    def _spell(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "each-byte")

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; byte pieces that form no character become one replacement sign each."""
        ids = list(ids)
        if any(self.types[i] == CONTROL for i in set(ids)):  # bytes on both sides of one form no character
            parts: list[list[int]] = [[]]
            for i in ids:
                parts.append([]) if self.types[i] == CONTROL else parts[-1].append(i)
            text = "".join(self._spell(part) for part in parts)
        else:
            text = self._spell(ids)
        if self.prefix:
            first = next((i for i in ids if self.types[i] != CONTROL), None)
            if first is not None and self.types[first] == NORMAL and text.startswith(" "):
                return text[1:]
        return text


@functools.cache
def piece_model(path: str) -> PieceModel:
    """One model per worker process and file."""
    return PieceModel(path)


def encode_decode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text."""

    def rounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = piece_model(model)
        for frame in frames:
            for start in range(0, len(frame), 1000):
                part = frame.iloc[start:start + 1000]
                ids = pieces.encode(part["_text"].tolist())
                yield pd.DataFrame({
                    "_id": part["_id"].array, "ids": ids, "decoded": [pieces.decode(x.tolist()) for x in ids],
                })

    kind = docs.schema[id_column].dataType.simpleString()
    return (
        docs.select(F.col(id_column).alias("_id"), whole_text(text_column).alias("_text"))
        .mapInPandas(rounds, f"_id {kind}, ids array<int>, decoded string")
        .withColumnRenamed("_id", id_column)
    )


def query(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"), model or vocabulary_path("piece_bpe_32k.model"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
