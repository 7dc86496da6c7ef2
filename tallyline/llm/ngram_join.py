"""Exact Jaccard join on sets of word n-grams: size-banded tiles, bitmap signatures, exact intersection.

1. Every text becomes a sorted array of 64-bit n-gram hashes. Texts with equal arrays form one class,
   which takes part once; a profile holds a class's size and its bitmap signature: the parity, per
   hash bucket, of the n-grams that fall there, with one to two buckets per n-gram.
2. Two sets that are similar enough share one of the first ``size - need + 1`` n-grams of each in a
   common order. N-grams of very many texts come last in it (any order is exact; this one keeps texts
   apart that share a frequent passage only), all others by hash. The first n-grams are dealt over
   shards as packed arrays. A shard
   sorts its n-grams, and classes that share one are cut where neighbouring sizes differ too much to
   link: the runs are the tiles. Equal tiles are kept once. A run of more than ``block`` classes is
   dealt as pairs of blocks that are compatible in size.
3. In a tile, differing bucket parities are counted: they bound the symmetric difference from below
   and so the overlap from above. A search from class to class gives a forest of what may link. The
   components of all forests hold all links.
4. Each component meets once with its arrays, in blocks of bounded size that all hold the
   component's pivot, and links are verified by exact intersection. Only where blocks of one
   component stay unconnected are they compared pairwise, so tight groups of copies cost linear work.

Nothing is dropped or capped: every step keeps a superset of the links until the exact check.

Edge cases: a null text or one without words has an empty set and links with nothing; fewer words
than ``n`` form one n-gram; repeated rows and equal texts keep their own rows; a null id takes part
but names no component unless all its ids are null; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import sweep, table, unused, whole_text, written
from tallyline.operators.pairwise import components

ODD = np.uint64(0x9E3779B97F4A7C15)
MEMO = 400_000
# Postings of one shard, about: 14 bytes each as they travel, a few times that in its task.
SHARD_POSTINGS = 1_500_000


# --- sets ---------------------------------------------------------------------------------------


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@functools.cache
def _hashes() -> _WordHashes:
    return _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def ngram_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted different n-gram hashes of a text; words are cut at ASCII white space, A-Z lowered."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _hashes()
    if len(known) > MEMO:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(w))
    out = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = out * ODD + w[k:len(w) - size + 1 + k]
    return np.unique(_mix(out))


def node_of(grams: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)) - (1 << 63)


def signature(grams: np.ndarray) -> bytes:
    """Bucket parities, one bit each; the number of buckets is the power of two from the size on."""
    bits = max(64, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Signatures:
    """Signatures of a tile by number of buckets; two of them are compared at the smaller number."""

    def __init__(self, raw: list[bytes]):
        self.width = np.array([len(s) // 8 for s in raw])
        self.row = np.zeros(len(raw), dtype=np.int64)
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            members = np.flatnonzero(self.width == w)
            self.row[members] = np.arange(len(members))
            self.rows[w, w] = np.frombuffer(b"".join(raw[i] for i in members), dtype="<u8").reshape(-1, w)

    def folded(self, width: int, to: int) -> np.ndarray:
        """All signatures of one width, folded: parities of buckets that fall together add up."""
        if (width, to) not in self.rows:
            rows = self.rows[width, width]
            self.rows[width, to] = np.bitwise_xor.reduce(rows.reshape(len(rows), width // to, to), axis=1)
        return self.rows[width, to]

    def differing(self, u: int, others: np.ndarray) -> np.ndarray:
        """Number of buckets in which the parities of ``u`` and each of the others differ."""
        own, out = int(self.width[u]), np.zeros(len(others), dtype=np.int64)
        widths = self.width[others]
        for w in np.unique(widths).tolist():
            pick, to = np.flatnonzero(widths == w), min(w, own)
            different = self.folded(w, to)[self.row[others[pick]]] ^ self.folded(own, to)[self.row[u]]
            out[pick] = np.bitwise_count(different).sum(axis=1, dtype=np.int64)
        return out


def may_link(a: np.ndarray, b: int, differing: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` that differ in at least ``differing`` n-grams can link.

    100 * common >= percent * together, with common = (a + b - d) / 2 and together = (a + b + d) / 2.
    """
    return (100 - percent) * (a + b) >= (100 + percent) * differing


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def forest(nodes: np.ndarray, sizes: np.ndarray, bits: list[bytes], percent: int, sets: list[np.ndarray] | None = None):
    """Edges that connect what links (with ``sets``) or may link (without), by a search in size order."""
    order = np.argsort(sizes, kind="stable")
    sizes, signatures = sizes[order].astype(np.int64), Signatures([bits[i] for i in order])
    left = np.ones(len(order), dtype=bool)
    edges: list[tuple[int, int]] = []
    for seed in range(len(order)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            u = queue.pop()
            low = np.searchsorted(sizes, -(-percent * sizes[u] // 100), "left")
            high = np.searchsorted(sizes, 100 * sizes[u] // percent, "right")
            near = low + np.flatnonzero(left[low:high])
            if not len(near):
                continue
            near = near[may_link(sizes[near], int(sizes[u]), signatures.differing(u, near), percent)]
            if sets is not None:
                one = sets[order[u]]
                same = np.array([common(one, sets[order[v]]) for v in near], dtype=np.int64)
                near = near[100 * same >= percent * (sizes[near] + sizes[u] - same)]
            left[near] = False
            queue += near.tolist()
            edges += [(int(nodes[order[u]]), int(nodes[order[v]])) for v in near]
    return edges


# --- steps --------------------------------------------------------------------------------------


MADE_SCHEMA = (
    "n_shingles long, node long, bits binary, text_key long, "  # of one row of the input
    "shard int, grams binary, nodes binary, sizes binary"  # of one batch and shard
)


def frequent_ngrams(docs: DataFrame, n: int, share: float) -> np.ndarray:
    """The n-grams of ``frequent_and_total``."""
    return frequent_and_total(docs, n, share)[0]


def frequent_and_total(docs: DataFrame, n: int, share: float) -> tuple[np.ndarray, int]:
    """Sorted hashes of n-grams that at least ``share`` of all texts hold, as far as batches show them, and the size of all sets.

    Every batch counts all its texts and reports what is frequent in it, and the reports are added
    up. At most (mean set size) / ``share`` n-grams can be that frequent, which bounds the result.
    """
    def heavy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            grams, counts = np.unique(np.concatenate([ngram_set(t, n) for t in frame["_text"]]), return_counts=True)
            often = counts >= max(3, share * len(frame))
            yield pd.DataFrame({"gram": grams[often].view(np.int64), "texts": counts[often], "all": 0})
            yield pd.DataFrame({"gram": [0], "texts": [0], "all": [int(counts.sum())]})

    reports = docs.select(whole_text().alias("_text")).mapInPandas(heavy, "gram long, texts long, all long")
    known = reports.groupBy("gram").agg(F.sum("texts").alias("texts"), F.sum("all").alias("all")).filter(
        (F.col("texts") >= share * docs.count()) | (F.col("all") > 0)).collect()
    grams = [r["gram"] for r in known if r["texts"]]
    return np.sort(np.array(grams, dtype=np.int64).view(np.uint64)), sum(r["all"] for r in known)


def text_key() -> Column:
    """64 bits that tell the texts of rows with equal ids apart."""
    return F.xxhash64(whole_text())


def profiles_and_postings(docs: DataFrame, n: int, percent: int, shards: int, frequent: np.ndarray) -> DataFrame:
    """A profile per row, and per incoming batch and shard one row of packed prefix n-grams."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [ngram_set(t, n) for t in frame["_text"]]
            nodes = [node_of(s) for s in sets]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].array, "n_shingles": [len(s) for s in sets], "node": nodes,
                "bits": [signature(s) for s in sets], "text_key": frame["_text_key"]}).reindex(columns=columns)
            first = {node: i for i, node in reversed(list(enumerate(nodes))) if len(sets[i])}
            if not first:
                continue
            grams, kept = [], []
            for i in first.values():
                s = sets[i]
                keep = len(s) + percent * len(s) // -100 + 1
                ranked = _mix(s * ODD) >> np.uint64(1)  # an order that has nothing to do with the shard
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    ranked[frequent[at] == s] += np.uint64(1 << 63)
                grams.append(s[np.argpartition(ranked, keep - 1)[:keep]] if keep < len(s) else s)
                kept.append(keep)
            # A posting takes the same few bytes however many shards there are.
            flat = np.concatenate(grams)
            node = np.repeat(np.fromiter(first, dtype=np.int64, count=len(first)), kept)
            size = np.repeat(np.array([len(sets[i]) for i in first.values()]), kept)
            shard = ((flat >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            flat, node, size, shard = flat[order], node[order], size[order], shard[order]
            rows = []
            for part in np.split(np.arange(len(flat)), np.flatnonzero(np.diff(shard)) + 1):
                rows.append((int(shard[part[0]]), flat[part].astype("<u4").tobytes(), node[part].tobytes(),
                             size[part].astype("<u2" if size[part].max() < 65536 else "<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["shard", "grams", "nodes", "sizes"]).reindex(columns=columns)

    columns = ["doc_id", "n_shingles", "node", "bits", "text_key", "shard", "grams", "nodes", "sizes"]

    def typed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in deal(frames):
            yield frame.astype({"n_shingles": "Int64", "node": "Int64", "text_key": "Int64", "shard": "Int32"})

    return docs.select("doc_id", whole_text().alias("_text"), text_key().alias("_text_key")).mapInPandas(typed, f"doc_id {kind}, {MADE_SCHEMA}")


def tiles(dealt: DataFrame, percent: int, block: int) -> DataFrame:
    """(tile, node) rows: classes that share a prefix n-gram and are compatible in size."""
    def runs(frame: pd.DataFrame) -> pd.DataFrame:
        grams, nodes, sizes = [], [], []
        for row in frame.itertuples():
            g = np.frombuffer(row.grams, dtype="<u4")
            grams.append(g)
            nodes.append(np.frombuffer(row.nodes, dtype=np.int64))
            sizes.append(np.frombuffer(row.sizes, dtype="<u2" if len(row.sizes) == 2 * len(g) else "<u4").astype(np.int64))
        g, node, size = np.concatenate(grams), np.concatenate(nodes), np.concatenate(sizes)
        order = np.argsort(g, kind="stable")  # n-grams of a single class go first: most of them
        sorted_g = g[order]
        shared = np.zeros(len(g), dtype=bool)
        equal = sorted_g[1:] == sorted_g[:-1]
        shared[1:] |= equal
        shared[:-1] |= equal
        order = order[shared]
        g, node, size = g[order], node[order], size[order]
        order = np.lexsort((node, size, g))
        g, node, size = g[order], node[order], size[order]
        fresh = np.ones(len(g), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (node[1:] != node[:-1])
        g, node, size = g[fresh], node[fresh], size[fresh]
        if not len(g):
            return pd.DataFrame({"tile": [], "node": []}, dtype=np.int64)
        first = np.ones(len(g), dtype=bool)
        first[1:] = (g[1:] != g[:-1]) | (100 * size[:-1] < percent * size[1:])
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(g)))
        mixed = _mix(node.view(np.uint64) * ODD)
        name = _mix(np.add.reduceat(mixed, start) + length.astype(np.uint64))
        _, one = np.unique(name, return_index=True)
        one = one[length[one] > 1]
        small = one[length[one] <= 2 * block]
        rows = np.repeat(start[small], length[small]) + np.arange(length[small].sum()) - np.repeat(
            np.cumsum(length[small]) - length[small], length[small])
        out_tile, out_node = [np.repeat(name[small], length[small])], [node[rows]]
        for i in one[length[one] > 2 * block]:
            edges = np.arange(start[i], start[i] + length[i] + block, block).clip(max=start[i] + length[i])
            parts = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
            for x, (a, b) in enumerate(parts):
                for y, (c, d) in enumerate(parts[x + 1:], x + 1):
                    if 100 * size[b - 1] < percent * size[c]:
                        break
                    both = np.concatenate([node[a:b], node[c:d]])
                    pair = _mix(name[i:i + 1] + np.uint64(x * 1_000_003 + y + 1))
                    out_tile.append(np.repeat(pair, len(both)))
                    out_node.append(both)
        return pd.DataFrame({"tile": np.concatenate(out_tile).view(np.int64), "node": np.concatenate(out_node)})

    return dealt.groupBy("shard").applyInPandas(runs, "tile long, node long")


def _by_group(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Complete groups of frames that come sorted by ``key``; at most one group is held back."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        values = frame[key].to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            part = frame.iloc[a:b]
            if held and held[0][key].iat[0] != values[a]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between classes that may link, a forest per tile."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges: list[tuple[int, int]] = []
        for group in _by_group(frames, "tile"):
            edges += forest(group["node"].to_numpy(), group["n_shingles"].to_numpy(), group["bits"].tolist(), percent)
            if len(edges) > 50_000:
                yield pd.DataFrame(edges, columns=["u", "v"]).drop_duplicates()
                edges = []
        yield pd.DataFrame(edges, columns=["u", "v"], dtype=np.int64).drop_duplicates()

    return members.repartition("tile").sortWithinPartitions("tile").mapInPandas(search, "u long, v long")


# Words of 64 bits in the filter of wanted ids: its size is fixed, and small enough to be sent to every task.
FILTER_WORDS = 1 << 18


def _bit(value: Column) -> tuple[Column, Column]:
    """The word of the filter that belongs to a value, and its bit in it."""
    h = F.xxhash64(value)
    word = F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS).cast("long")).cast("int")
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def maybe_among(rows: DataFrame, column: str, wanted: DataFrame, value: str) -> DataFrame:
    """Rows whose ``column`` is among the wanted values, and a few others, without moving the rows.

    The wanted values are or-ed into a table of at most ``FILTER_WORDS`` words, whatever their number; Spark
    sends that to the tasks. The more values, the more others pass: an exact join must follow.
    """
    word, bit = _bit(F.col(value))
    words = written(wanted.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")), "wanted-bits")
    word, bit = _bit(F.col(column))
    return rows.withColumns({"_of": word, "_mask": bit}).join(
        words, (F.col("_of") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_mask")) != 0), "left_semi").drop("_of", "_mask")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, grams binary) for the classes of ``wanted`` (node, doc)."""
    def arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [ngram_set(t, n) for t in frame["_text"]]
            # Another row may carry the same id: only the wanted set passes.
            right = [node_of(s) == node for s, node in zip(sets, frame["node"])]
            yield pd.DataFrame({"node": frame["node"], "grams": [s.tobytes() for s in sets]})[right]

    texts = maybe_among(docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text")), "_id", wanted, "doc")
    # The wanted classes are narrow rows and are built into a table per partition; texts stream past.
    return texts.join(wanted.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("doc"))).mapInPandas(
        arrays, "node long, grams binary")


def verified(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between linked classes, enough to connect each tile's components."""
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_group(frames, "tile"):
            group = group.drop_duplicates("node")
            arrays = [np.frombuffer(x, dtype=np.uint64) for x in group["grams"]]
            edges = forest(group["node"].to_numpy(), np.array([len(x) for x in arrays]),
                           [signature(x) for x in arrays], percent, arrays)
            yield pd.DataFrame(edges, columns=["u", "v"], dtype=np.int64)

    return sets.repartition("tile").sortWithinPartitions("tile").mapInPandas(check, "u long, v long")


def step(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, after which what it was made from can go: shuffle files and tables that nothing reads any more."""
    made = written(df, name)
    sweep(df.sparkSession, collect=True)
    return made


def linked_rows(
    docs: DataFrame, n: int = 5, percent: int = 75, block: int = 4096, set_block: int = 512, frequent_share: float = 0.0005,
) -> DataFrame:
    """The rows of ``link`` with text_key, and ``component``, which is NULL for an empty set alone."""
    # The number of shards follows the postings, so that a shard's n-grams fit a task at every size.
    frequent, total = frequent_and_total(docs, n, frequent_share)
    postings = total * (100 - percent) // 100
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-postings // SHARD_POSTINGS))
    made = written(profiles_and_postings(docs, n, percent, shards, frequent), "ngrams")
    profile = made.filter("shard IS NULL").select("doc_id", "n_shingles", "node", "text_key")
    dealt = made.filter("shard IS NOT NULL").select("shard", "grams", "nodes", "sizes")
    classes = written(
        profile.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n_shingles")),
        "classes",
    )
    tile_rows = step(tiles(dealt, percent, block), "tiles").distinct()
    known = written(tile_rows.select("node").distinct().join(
        made.filter("n_shingles > 0").select("node", "n_shingles", "bits"), "node").dropDuplicates(["node"]), "bits")
    profile = written(profile, "profiles")
    del made, dealt  # the postings are in the tiles: the largest table goes before anything is searched
    sweep(docs.sparkSession, collect=True)
    near = step(candidates(tile_rows.join(known, "node"), percent).distinct(), "candidates")
    del tile_rows, known

    groups = step(components(near).select(F.col("id").alias("node"), "component"), "groups")
    sizes = groups.groupBy("component").agg(
        F.ceil(F.count(F.lit(1)) / set_block).cast("int").alias("_blocks"), F.min("node").alias("_pivot"))
    placed = (
        groups.join(written(sizes, "group-sizes"), "component").join(classes.select("node", "doc"), "node")
        .withColumn("_block", F.pmod(F.xxhash64("node"), F.col("_blocks").cast("long")).cast("int"))
    )
    # The pivot joins every block of its component.
    blocks = F.sequence(F.lit(0), F.col("_blocks") - 1)
    spots = F.when(F.col("node") == F.col("_pivot"), blocks).otherwise(F.array("_block"))
    placed = written(placed.withColumn("tiles", F.transform(spots, lambda b: F.xxhash64("component", b))), "placed")
    sets = step(sets_of(docs, placed.select("node", "doc"), n), "sets")

    def dealt_sets(where: DataFrame) -> DataFrame:
        return where.join(sets, "node").select(F.explode("tiles").alias("tile"), "node", "grams")

    links = step(verified(dealt_sets(placed.select("node", "tiles")), percent), "links")
    reached = step(components(links).select(F.col("id").alias("node"), F.col("component").alias("_reached")), "reached")

    # Components of several blocks that the first pass left in several parts: compare their blocks.
    parts = placed.filter("_blocks > 1").join(reached, "node", "left").groupBy("component").agg(
        F.min(F.coalesce("_reached", "node")).alias("_a"), F.max(F.coalesce("_reached", "node")).alias("_b"))
    open_ = written(parts.filter("_a < _b").select("component"), "open")
    if not open_.isEmpty():
        pairs = F.transform(F.filter(blocks, lambda b: b != F.col("_block")), lambda b: F.xxhash64(
            "component", F.least(b, F.col("_block")), F.greatest(b, F.col("_block"))))
        more = placed.join(open_, "component").select("node", pairs.alias("tiles"))
        links = written(links.union(verified(dealt_sets(more), percent)).distinct(), "all-links")
        reached = written(components(links).select(F.col("id").alias("node"), F.col("component").alias("_reached")), "all-reached")

    named = written(classes.select("node", "doc").join(reached, "node", "left").withColumn(
        "_c", F.coalesce("_reached", "node")), "named")
    smallest = named.groupBy("_c").agg(F.min("doc").alias("component_id"))
    label = written(named.join(written(smallest, "smallest"), "_c").select(F.col("node").alias("_node"), "_c", "component_id"), "labels")
    joined = profile.join(label, F.col("node") == F.col("_node"), "left")
    return joined.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_key", F.when(F.col("n_shingles") > 0, F.col("_c")).alias("component"))


def link(docs: DataFrame, n: int = 5, percent: int = 75, **blocks) -> DataFrame:
    """(doc_id, n_shingles, component_id); component_id is the smallest id that links reach."""
    return linked_rows(docs, n, percent, **blocks).select("doc_id", "n_shingles", "component_id")


def first_rows(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One row of each component, the one with the smallest id (null ids last), and all rows without words."""
    of_id, of_text = unused(docs, "_d", "_t")
    rows = written(linked_rows(docs, n, percent).filter("component IS NOT NULL").select(
        "component", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key").alias("row")), "linked-rows")
    first = written(
        rows.groupBy("component").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1").select(F.col("component").alias("_c"), "_first"),
        "first-rows")
    # Pairs of id and text of components of several rows; the first one may be several equal rows.
    pairs = rows.join(first, F.col("component") == F.col("_c")).groupBy("row").agg(
        F.max(F.col("row").eqNullSafe(F.col("_first"))).alias("_is_first"), F.count(F.lit(1)).alias("_n"))
    marks = written(
        pairs.filter("NOT _is_first OR _n > 1").select(
            F.col("row.doc_id").alias(of_id), F.col("row.text_key").alias(of_text), "_is_first"),
        "marks")
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (text_key() == F.col(of_text))
    left = docs.join(marks.drop("_is_first").hint("shuffle_hash"), same, "left_anti")
    equal = marks.filter("_is_first")
    if equal.isEmpty():
        return left
    copies = docs.join(equal.select(of_id, of_text).hint("shuffle_hash"), same, "left_semi").withColumn(of_text, text_key())
    return left.unionByName(copies.dropDuplicates(["doc_id", of_text]).drop(of_text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
