"""Fill-in-middle documents: texts cut into prefix, middle and suffix at unit bounds and put in a new order.

Each batch is one pass of ``pyarrow.compute``: texts are split into units as list arrays, flattened with
the index of their parent, numbered within it, filtered by role (prefix, middle, suffix), gathered into
lists again, joined, and the pieces joined by element. No text is touched by a Python loop. Texts are
handled as UTF-8 bytes: all white space of the unit pattern is ASCII, so that units of bytes are units
of code points, and the byte 0xFF, which no text holds, can stand between units.

Cuts and forms depend on the seed and the id only, so that a lost executor's work comes out the same again.
``restored`` inverts the output.

Edge cases: a null text is empty, and an empty text stays plain; a null id counts as no digits; rows that
repeat an id are cut at the same draws, each in its own text; a text that holds a marker stays plain; a batch
is worked on in slices of about ``SLICE_BYTES``, a longer text alone; an empty table gives an empty result;
other columns are left out unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallyline.llm.common import table, whole_text

WORD_UNITS = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
BETWEEN = b"\xff"
MARKERS = ("<P>", "<S>", "<M>")
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of ``column``, or of one row."""
    sizes = pc.binary_length(batch.column(column).cast(pa.binary())).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def split_units(texts: pa.Array, pattern: bytes) -> tuple[pa.Array, pa.Array]:
    """(units, counts): the units of each text and their number; every list has one empty unit more at its end."""
    marked = pc.replace_substring_regex(texts, pattern=pattern, replacement=rb"\0" + BETWEEN)
    units = pc.split_pattern(marked, pattern=BETWEEN)
    return units, pc.cast(pc.subtract(pc.list_value_length(units), 1), pa.int64())


def remainder(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(by, pc.divide(x, by)))


def pieces(units: pa.Array, low: pa.Array, high: pa.Array, counts: pa.Array) -> list[pa.Array]:
    """The joined units before ``low``, from there to ``high``, and from there to ``counts``, of each list."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    lengths = pc.cast(pc.list_value_length(units), pa.int64())
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    ordinal = pc.subtract(pc.subtract(pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), len(flat))), 1), starts.take(parent))
    low_of, high_of, end_of = (x.take(parent) for x in (low, high, counts))
    roles = (
        (pc.less(ordinal, low_of), low),
        (pc.and_(pc.greater_equal(ordinal, low_of), pc.less(ordinal, high_of)), pc.subtract(high, low)),
        (pc.and_(pc.greater_equal(ordinal, high_of), pc.less(ordinal, end_of)), pc.subtract(counts, high)),
    )
    joined = []
    for chosen, sizes in roles:
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)]).cast(pa.int32())
        joined.append(pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(chosen)), pa.scalar(b"", pa.binary())))
    return joined


def together(*parts: pa.Array | bytes) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in parts],
                                       pa.scalar(b"", pa.binary()))


def transform_batch(
    batch: pa.RecordBatch, pattern: bytes, rate: int, suffix_first: int, markers: Sequence[str],
) -> dict[str, pa.Array]:
    """The columns of ``fill_in_middle`` for a batch of ``_text`` and four draws."""
    texts = batch.column("_text").cast(pa.binary())
    draws = [batch.column(f"_h{i}") for i in range(4)]
    units, n = split_units(texts, pattern)
    places = pc.add(n, 1)
    one, two = remainder(draws[0], places), remainder(draws[1], places)
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    hundred = pa.repeat(pa.scalar(100, pa.int64()), len(texts))
    plain = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.greater_equal(remainder(draws[2], hundred), rate))
    p, s, m = (x.encode() for x in markers)
    for marker in (p, s, m):
        plain = pc.or_(plain, pc.match_substring(texts, pattern=marker))
    spm = pc.less(remainder(draws[3], hundred), suffix_first)
    prefix, middle, suffix = pieces(units, low, high, n)
    output = pc.if_else(plain, texts, pc.if_else(
        spm, together(s, suffix, p, prefix, m, middle), together(p, prefix, s, suffix, m, middle)))
    nothing = pa.scalar(None, pa.int64())

    def characters(part: pa.Array) -> pa.Array:
        return pc.if_else(plain, nothing, pc.cast(pc.utf8_length(part.cast(pa.string())), pa.int64()))

    return {
        "n": n, "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": characters(prefix), "middle_chars": characters(middle), "output": output.cast(pa.string()),
    }


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    rate: int = 50,
    suffix_first: int = 80,
    markers: Sequence[str] = MARKERS,
    pattern: bytes = WORD_UNITS,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    ``rate`` of a hundred documents are rearranged, ``suffix_first`` of a hundred of these with the suffix
    first (spm), the others with the prefix first (psm). ``pattern`` matches one unit, over bytes; units must
    cover every text. ``n`` counts units; the lengths are code points, null where the form is plain.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    staged = docs.select(F.col(id_column).alias(id_column), *[F.col(f"`{c}`") for c in keep],
                         whole_text(text_column).alias("_text"), digest.alias("_digest"))
    staged = staged.select("*", *[
        F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]).drop("_digest")
    kept = [id_column, *keep]
    markers = tuple(markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                made = transform_batch(batch, pattern, rate, suffix_first, markers)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], *made.values()], names=[*kept, *made])

    schema = StructType([staged.schema[c] for c in kept])
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)
    return staged.mapInArrow(run, schema)


def _halves(texts: pa.Array, marker: bytes) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first ``marker``, which every text holds."""
    both = pc.split_pattern(texts, pattern=marker, max_splits=1)
    return pc.list_element(both, 0), pc.list_element(both, 1)


def restore_batch(output: pa.Array, form: pa.Array, markers: Sequence[str] = MARKERS) -> pa.Array:
    """The texts from which outputs and forms were made."""
    p, s, m = (x.encode() for x in markers)
    back = output
    for name, first, second in (("psm", p, s), ("spm", s, p)):
        chosen = pc.equal(form, name)
        left, rest = _halves(_halves(output.filter(chosen), first)[1], second)
        right, middle = _halves(rest, m)
        before, after = (left, right) if name == "psm" else (right, left)
        back = pc.replace_with_mask(back, chosen, together(before, middle, after))
    return back


def restored(made: DataFrame, name: str = "restored", markers: Sequence[str] = MARKERS) -> DataFrame:
    """``made`` with the text rebuilt from ``output`` and ``form`` instead of the output."""
    kept = [c for c in made.columns if c != "output"]
    schema = StructType([made.schema[c] for c in kept]).add(name, StringType())
    markers = tuple(markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "output"):
                text = restore_batch(batch.column("output").cast(pa.binary()), batch.column("form"), markers)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], text.cast(pa.string())], names=[*kept, name])

    return made.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    return restored(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
        F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS w,
        CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
         ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
