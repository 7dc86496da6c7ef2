"""Line dedup, with DataFrame functions only: every repeated passage, or whole content-defined chunks.

``dedup`` removes every passage of two visible lines or more that occurred before. Its unit is the
stretch of two consecutive visible lines with the blank lines between them, so where a passage stands
and what surrounds it does not matter. Keys of all stretches are counted (pre-aggregated, 8 bytes
each), stretches whose key was found once are left behind, and the others are compared by a 256-bit
digest of their text. All but the first place of a stretch (smallest document id, then line) lose their
lines. A line is only removed where an equal line stands at a smaller place, so each text of a line
stays at least once.

``dedup_chunks`` is the registered query and what its SQL states. It removes whole chunks only, and
short passages that hold no chunk of their own stay.

Lines are hashed, a rolling hash over ``WINDOW`` consecutive line hashes is taken at every line, and a
chunk ends where it is smaller than at both neighbouring lines. The place of an end depends on a few
lines around it alone, so inserted or removed lines move no other end. Local minima never follow
each other, so all chunks but a document's first and last have two lines or more.

Chunks of several lines that occur more than once are removed everywhere but at their first place
(smallest document id, then line), after their text was compared with that first text. Hashes, keys
and places are exchanged for all chunks; text is exchanged for repeated chunks only, and once more
for the documents themselves. Joins on a chunk's key have a plain exchange on both sides, so that
adaptive execution can split a chunk that very many documents share.

Edge cases: a null text stays null; single lines and chunks without any visible character are never
removed (nor, by ``dedup``, a single line that repeats between blank lines, or the overlap of a
stretch of two equal lines with itself); a document may end up empty but keeps its row; equal rows
(same id and text) count as one occurrence and are treated alike; a null id comes before all others;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import let, table, unused, whole_text, written

WINDOW = 2
BASE, MODULUS = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    """28 bits of a digest, so that rolling sums stay within a long."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunk_bounds(lines: Column) -> Column:
    """Array of (start, end) line numbers of consecutive chunks, both inclusive."""
    def rolling(hashes: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            total = F.get(hashes, i)
            for back in range(1, WINDOW):
                total = total + F.coalesce(F.get(hashes, i - back), F.lit(0).cast("long")) * (BASE ** back % MODULUS)
            return total % MODULUS
        return F.transform(hashes, at)

    def ends(r: Column) -> Column:
        last = F.size(r) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (
            (i > 0) & (i < last - 1) & (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))))

    def bounds(e: Column) -> Column:
        return F.transform(e, lambda x, k: F.struct(
            (F.coalesce(F.get(e, k - 1), F.lit(-1)) + 1).alias("start"), x.alias("end")))

    return let(F.transform(lines, line_hash), lambda h: let(rolling(h), lambda r: let(ends(r), bounds)))


def stretch(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, end - start + 1), "\n")


def _pieces(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = whole_text(text_column)
    return docs.select(
        F.col(id_column).alias("_doc"), F.xxhash64(text).alias("_text_key"), F.split(text, "\n").alias("_lines"))


def _cut(docs: DataFrame, places: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` without the lines of ``places`` (_d, _t, _place: start and end), and n_lines and n_removed."""
    lines_name, removed_name, n_lines, n_removed, of_id, of_text = unused(
        docs, "_lines", "_removed", "n_lines", "n_removed", "_d", "_t")
    text, key = whole_text(text_column), F.xxhash64(whole_text(text_column))
    taken = places.groupBy(
        F.col("_d").alias(of_id), F.col("_t").alias(of_text)).agg(F.collect_set("_place").alias(removed_name))
    # Lines are cut after the exchange, so that texts move once.
    joined = docs.join(
        taken.hint("shuffle_hash"), F.col(id_column).eqNullSafe(F.col(of_id)) & (key == F.col(of_text)), "left"
    ).withColumn(lines_name, F.split(text, "\n"))
    gone = F.array_distinct(F.flatten(F.transform(removed_name, lambda x: F.sequence(x["_start"], x["_end"]))))
    kept = let(F.col(lines_name), lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda i: F.get(ls, i)), "\n"))
    columns = [
        F.when(F.col(removed_name).isNull(), F.col(text_column)).otherwise(kept).alias(text_column)
        if c == text_column else F.col(f"`{c}`") for c in docs.columns
    ]
    return joined.select(
        *columns, F.size(lines_name).cast("long").alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed))


def dedup_chunks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and n_lines and n_removed (lines)."""
    pieces = _pieces(docs, id_column, text_column)
    chunks = (
        pieces.withColumn("_chunk", F.explode(chunk_bounds(F.col("_lines"))))
        .filter(F.col("_chunk.end") > F.col("_chunk.start"))
        .select("_doc", "_text_key", "_chunk", stretch(F.col("_lines"), F.col("_chunk.start"), F.col("_chunk.end")).alias("_part"))
        .filter(F.col("_part").rlike("[^ \\t-\\r]"))
    )
    places = written(
        chunks.select("_doc", "_text_key", F.col("_chunk.start").alias("_start"), F.col("_chunk.end").alias("_end"),
                      F.unhex(F.md5("_part")).alias("_key")),
        "chunks",
    )
    repeated = written(
        places.groupBy("_key").agg(F.min(F.struct("_doc", "_text_key", "_start")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1).select(F.col("_key").alias("_known"), "_first"),
        "repeated",
    )
    wanted = places.join(repeated, F.col("_key") == F.col("_known")).select(
        F.col("_doc").alias("_d"), F.col("_text_key").alias("_t"),
        F.struct("_start", "_end", "_key", (
            F.struct("_doc", "_text_key", "_start").eqNullSafe(F.col("_first"))).alias("_is_first")).alias("_place"))
    # Arrays stay within a document: it has at most as many chunks as lines.
    wanted = wanted.groupBy("_d", "_t").agg(F.collect_set("_place").alias("_places"))
    texts = written(
        pieces.join(wanted.hint("shuffle_hash"), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text_key") == F.col("_t")))
        .select("_doc", "_text_key", "_lines", F.explode("_places").alias("_place"))
        .select("_doc", "_text_key", "_place.*", stretch(F.col("_lines"), F.col("_place._start"), F.col("_place._end")).alias("_part")),
        "chunk-texts",
    )
    first = texts.filter("_is_first").dropDuplicates(["_key"]).select(F.col("_key").alias("_known"), F.col("_part").alias("_text"))
    first = written(first, "first-texts")
    equal = (
        texts.filter(~F.col("_is_first")).join(first, F.col("_key") == F.col("_known"))
        .filter(F.col("_part") == F.col("_text"))
        .select(F.col("_doc").alias("_d"), F.col("_text_key").alias("_t"), F.struct("_start", "_end").alias("_place"))
    )
    return _cut(docs, written(equal, "removed"), id_column, text_column)


def stretches(lines: Column) -> Column:
    """Array of (start, end) of every two consecutive visible lines, both inclusive."""
    visible = F.filter(
        F.transform(lines, lambda x, i: F.when(x.rlike("[^ \\t-\\r]"), i)), lambda i: i.isNotNull())
    return let(visible, lambda v: F.transform(
        F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))),
        lambda x, k: F.struct(x.alias("start"), F.get(v, k + 1).alias("end"))))


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without any repeated passage of two lines or more, and n_lines and n_removed (lines)."""
    pieces = _pieces(docs, id_column, text_column)

    def spelled(place: Column) -> Column:
        return stretch(F.col("_lines"), place["start"], place["end"])

    # Texts and line arrays stay in their row; narrow rows leave it.
    keys = pieces.select(F.explode(F.transform(stretches(F.col("_lines")), lambda p: F.xxhash64(spelled(p)))).alias("_known"))
    twice = written(
        keys.groupBy("_known").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_known"), "twice")
    places = pieces.select("_doc", "_text_key", F.explode(F.transform(stretches(F.col("_lines")), lambda p: let(
        spelled(p), lambda t: F.struct(
            p["start"].alias("_start"), p["end"].alias("_end"), F.xxhash64(t).alias("_key"),
            F.unhex(F.sha2(t.cast("binary"), 256)).alias("_digest"))))).alias("_place"))
    found = written(
        places.select("_doc", "_text_key", "_place.*").join(twice, F.col("_key") == F.col("_known")).drop("_key", "_known"),
        "passages")
    place = F.struct("_doc", "_text_key", "_start", "_end")
    first = written(
        found.groupBy("_digest").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1).select(F.col("_digest").alias("_known"), "_first"),
        "first-passages")
    # Equal lines in a row: a stretch that begins in its own first place is no second one.
    overlaps = (F.col("_doc").eqNullSafe(F.col("_first._doc")) & (F.col("_text_key") == F.col("_first._text_key"))
                & (F.col("_start") <= F.col("_first._end")))
    gone = (
        found.join(first, F.col("_digest") == F.col("_known"))
        .filter(~overlaps)
        .select(F.col("_doc").alias("_d"), F.col("_text_key").alias("_t"), F.struct("_start", "_end").alias("_place"))
    )
    return _cut(docs, written(gone, "removed"), id_column, text_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Whole chunks are compared as text; no key takes part.
ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM d),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM l),
r AS (SELECT *, (h + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {BASE}) % {MODULUS} AS r FROM h),
b AS (SELECT *, i = n - 1 OR (i > 0 AND i < n - 2 AND r < lag(r) OVER w AND r <= lead(r) OVER w) AS ends
      FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM b),
chunks AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS part, count(*) AS lines FROM c GROUP BY doc_id, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, c) AS k FROM chunks
           WHERE lines > 1 AND regexp_matches(part, '[^ \\t-\\r]')),
out AS (SELECT chunks.doc_id, sum(chunks.lines) AS n,
          string_agg(chunks.part, chr(10) ORDER BY chunks.c) FILTER (WHERE coalesce(k, 1) = 1) AS text,
          coalesce(sum(chunks.lines) FILTER (WHERE k > 1), 0) AS gone
        FROM chunks LEFT JOIN ranked USING (doc_id, c) GROUP BY chunks.doc_id)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(out.text, '') END AS text,
  CAST(n AS BIGINT) AS n_lines, CAST(gone AS BIGINT) AS n_removed
FROM out JOIN d USING (doc_id)"""
