"""Quality rules by distribution divergence, with DataFrame functions only.

Each document is compared with the reference of its language by the Jensen-Shannon distance of two
histograms: character classes, and the common words of the language beside all other words. Short
documents have noisy histograms, so each comparison has a minimum length below which it has no say.

A reference is a median of medians: over the documents of a source (all that pass the base rules, each
with its shares, so length has no weight), then over the sources, so a source has one vote however
many rows it holds. Shares are counted in ``LEVELS`` steps, so the state of a median is bounded. A
language has a reference of its own if ``min_sources`` sources hold it; otherwise, and where the
language is null, or unknown and rare, the reference over all languages is taken. Tables without a
source column take the median over documents.

Per-document arrays (words, windows) never leave their row: repeated three-word windows are found
by sorting window hashes packed with their positions, and the few windows whose hashes meet are then
compared as text. Only counts are shuffled.

Edge cases: a null text has no words; a null or unknown language has no common words, so its words have
no say; a null source is a source; null and repeated ids and repeated rows keep their own rows; an empty table gives an
empty result; other columns are left out unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import let, table, whole_text, written

# Frequent function words of each language, as they are written inside a sentence.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
BINS = 12
LEVELS = 4096  # steps of a share from 0 to 1 in the medians of references
SPACE = "[ \\t-\\r]+"
# Each class takes what the ones before it left; what remains is other.
CLASSES = {
    "lower": "[a-z]+", "space": SPACE, "upper": "[A-Z]+", "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+", "punctuation": "[!-/:-@\\[-`{-~]+",
}


def _bits(op: str, value: Column, bits: Column) -> Column:
    return F.call_function(op, value, bits)


def repeated_words(words: Column, n: Column) -> list[tuple[str, Column]]:
    """Columns to add one after the other; the last counts the words in repeated three-word windows."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    bits, keys, packed = F.length(F.bin(n)), F.col("_windows"), F.col("_packed")
    near = F.filter(
        packed,
        lambda x, i: (_bits("shiftright", x, F.col("_bits")) == _bits("shiftright", F.get(packed, i - 1), F.col("_bits")))
        | (_bits("shiftright", x, F.col("_bits")) == _bits("shiftright", F.get(packed, i + 1), F.col("_bits"))),
    )
    mask = _bits("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1

    def spelled(x: Column) -> Column:
        at = x.bitwiseAND(mask).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)).alias("w"), at.alias("p"))

    same = F.filter(
        F.col("_spelled"),
        lambda x, i: (x["w"] == F.get(F.col("_spelled"), i - 1)["w"]) | (x["w"] == F.get(F.col("_spelled"), i + 1)["w"]),
    )
    covered = F.flatten(F.transform(same, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    return [
        ("_windows", windows),
        ("_bits", F.when(F.size(F.array_distinct(keys)) < F.size(keys), bits)),
        ("_packed", F.when(F.col("_bits").isNotNull(), F.sort_array(F.transform(
            keys, lambda h, i: _bits("shiftleft", _bits("shiftright", h, F.col("_bits")), F.col("_bits"))
            .bitwiseOR(i.cast("long")))))),
        ("_spelled", F.sort_array(F.transform(near, spelled))),
        ("n_repeat_words", F.when(F.col("_bits").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")),
    ]


def features(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Counts and histograms of every document, still unwritten."""
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    df = docs.select(
        F.col("doc_id").alias("doc_id"), *keep, F.col("lang").cast("string").alias("_lang"), source.alias("_source"),
        whole_text().alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    for name, column in repeated_words(F.col("_words"), F.size("_words")):
        df = df.withColumn(name, column)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    df = df.withColumn("_lines", lines).withColumn(
        "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    known = sorted({w for words in COMMON_WORDS.values() for w in words})
    df = df.withColumn("_common", F.filter("_words", lambda w: w.isin(known)))
    wanted = F.lit(None)
    for lang, words in COMMON_WORDS.items():
        wanted = F.when(F.col("_lang") == lang, F.array(*map(F.lit, words))).otherwise(wanted)
    wanted = F.coalesce(wanted, F.array(*[F.lit("")] * BINS))  # no word is empty
    df = df.withColumn("_bins", F.transform(
        wanted, lambda c: (F.size("_common") - F.size(F.array_remove(F.col("_common"), c))).cast("long")))
    rest, counts = F.col("_text"), []
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_after_{name}", F.regexp_replace(rest, pattern, ""))
        df = df.withColumn(f"_n_{name}", F.length(rest) - F.length(f"_after_{name}"))
        rest = F.col(f"_after_{name}")
        counts.append(F.col(f"_n_{name}"))
    counts.append(F.length(rest))
    return df.select(
        "doc_id", *keep, "_lang", "_source", "n_words",
        (F.length("_text") - F.col("_n_space")).cast("long").alias("word_chars"),
        F.col("_n_symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(*[c.cast("long") for c in counts]).alias("_chars"),
        F.concat("_bins", F.array(F.col("n_words") - F.aggregate("_bins", F.lit(0).cast("long"), lambda a, x: a + x))).alias("_common"),
    )


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of two arrays of counts; NULL if either is empty."""
    def shares(counts: Column) -> Column:
        return let(F.nullif(_total(counts), F.lit(0).cast("long")), lambda n: F.transform(counts, lambda c: c / n))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(shares(p), shares(q), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def medians(passed: DataFrame, measured: DataFrame, by_source: bool, min_sources: int, rare_percent: int) -> DataFrame:
    """(_of, _of_chars, _of_common) for every language of ``measured``, learned from the rows of ``passed``."""
    sizes = {"_chars": len(CLASSES) + 1, "_common": BINS + 1}
    known = F.col("_lang").isin(*COMMON_WORDS)

    def middle(df: DataFrame, keys: list[str], value) -> DataFrame:
        # Doubled, so that a median between two steps stays an integer.
        arrays = [F.array(*[(2 * F.percentile(value(c, i), F.lit(0.5))).cast("long") for i in range(n)]).alias(c)
                  for c, n in sizes.items()]
        return df.groupBy(*keys).agg(*arrays, *([F.count(F.lit(1)).alias("_votes")]), F.sum("_docs").alias("_docs"))

    def share(column: str, i: int) -> Column:
        part = F.get(column, F.lit(i)) / F.nullif(_total(F.col(column)), F.lit(0).cast("long"))
        part = F.round(LEVELS * part).cast("long")
        return F.when(F.coalesce(known, F.lit(False)), part) if column == "_common" else part

    def vote(column: str, i: int) -> Column:
        return F.get(column, F.lit(i))

    def reference(keys: list[str]) -> DataFrame:
        one = passed.withColumn("_docs", F.lit(1).cast("long"))
        return middle(middle(one, [*keys, "_source"], share), keys, vote) if by_source else middle(one, keys, share)

    own = reference(["_lang"]).select(
        F.col("_lang").alias("_own"), F.col("_chars").alias("_own_chars"), F.col("_common").alias("_own_common"),
        F.col("_votes").alias("_own_votes"), F.col("_docs").alias("_own_docs"))
    languages = measured.select(F.col("_lang").alias("_of")).distinct()
    # The reference over all languages is one row, read as a scalar subquery.
    everywhere = reference([]).select(F.struct("_chars", "_common", "_docs")).scalar()
    joined = languages.join(own, F.col("_of").eqNullSafe(F.col("_own")), "left").withColumn("_all", everywhere).select(
        "*", "_all._chars", "_all._common", "_all._docs")
    known = F.coalesce(F.col("_of").isin(*COMMON_WORDS), F.lit(False))
    common = F.col("_of").isNotNull() & (100 * F.col("_own_docs") >= rare_percent * F.col("_docs"))
    independent = F.coalesce((F.col("_own_votes") >= min_sources) & (known | common), F.lit(False))
    no_words = F.array(*[F.lit(int(i == BINS)).cast("long") for i in range(BINS + 1)])
    return joined.select(
        "_of", F.when(independent, F.col("_own_chars")).otherwise(F.col("_chars")).alias("_of_chars"),
        F.when(~known, no_words).when(independent, F.col("_own_common")).otherwise(F.col("_common")).alias("_of_common"))


def judge(
    docs: DataFrame,
    keep: Sequence[str] = (),
    char_limit: float = 0.3,
    word_limit: float = 0.25,
    min_chars: int = 300,
    min_words: int = 100,
    base_words: int = 50,
    repeat_percent: int = 50,
    min_sources: int = 3,
    rare_percent: int = 5,
) -> DataFrame:
    """One row per document: its counts, char_distance, word_distance, base_failed and kept."""
    measured = written(features(docs, keep), "quality")
    failed = (F.col("n_words") < base_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    reference = written(
        medians(measured.filter(~failed), measured, "source" in docs.columns, min_sources, rare_percent),
        "languages",
    )
    df = measured.join(reference, F.col("_lang").eqNullSafe(F.col("_of")))
    df = df.withColumn("char_distance", distance(F.col("_chars"), F.col("_of_chars")))
    df = df.withColumn("word_distance", distance(F.col("_common"), F.col("_of_common")))
    far = (
        ((_total(F.col("_chars")) >= min_chars) & (F.col("char_distance") > char_limit))
        | ((F.col("n_words") >= min_words) & (F.col("word_distance") > word_limit))
    )
    return df.select(
        "doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"),
        "char_distance", "word_distance",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _sql() -> str:
    """The same result in DuckDB, from the definition: every window is counted as text."""
    words = ", ".join(f"('{lang}', [{', '.join(repr(w) for w in ws)}])" for lang, ws in COMMON_WORDS.items())
    count = "length(t) - length(regexp_replace(t, '{}', '', 'g'))"
    known = ", ".join(map(repr, COMMON_WORDS))
    kinds = ("[a-z]", "[ \\t-\\r]", "[A-Z]", "[0-9]", "[#*$%&|<>]", "[!\"\\x27()+,./:;=?@\\[\\\\\\]^_`{}~-]")
    chars = ", ".join(f"length(t) - length(regexp_replace(t, '{kind}', '', 'g'))" for kind in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \\t-\\r]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d),
tri AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM twice GROUP BY r),
langs(lang, list) AS (VALUES {words}),
h AS (SELECT w.*, coalesce(rep.n, 0) AS n_repeat_words, [{chars}] AS c0,
        list_transform(coalesce(langs.list, list_transform(range({BINS}), lambda z: '')),
                       lambda q: len(list_filter(words, lambda x: x = q))) AS k0
      FROM w LEFT JOIN rep USING (r) LEFT JOIN langs ON langs.lang = w.lang),
h2 AS (SELECT *, list_concat(c0, [length(t) - list_sum(c0)]) AS c,
        list_concat(k0, [len(words) - list_sum(k0)]) AS k FROM h),
ok AS (SELECT * FROM h2 WHERE NOT (len(words) < 50 OR 100 * n_repeat_words > 50 * len(words))),
-- Shares of 4096 steps, one row per document and place; kind 0: character classes, 1: common words of known languages.
sh AS (SELECT lang, source, 0 AS kind, j, CAST(round(4096 * (v / nullif(n, 0))) AS BIGINT) AS s FROM (
         SELECT lang, source, unnest(c) AS v, unnest(range(len(c))) AS j, list_sum(c) AS n FROM ok)
       UNION ALL SELECT lang, source, 1, j, CAST(round(4096 * (v / nullif(n, 0))) AS BIGINT) FROM (
         SELECT lang, source, unnest(k) AS v, unnest(range(len(k))) AS j, list_sum(k) AS n FROM ok WHERE lang IN ({known}))),
-- Medians over the documents of a source, then over sources; doubled, so that they stay whole numbers.
own1 AS (SELECT lang, source, kind, j, CAST(2 * median(s) AS BIGINT) AS s FROM sh GROUP BY ALL),
own AS (SELECT lang, kind, list(s ORDER BY j) AS m FROM (
          SELECT lang, kind, j, CAST(2 * median(s) AS BIGINT) AS s FROM own1 GROUP BY ALL) GROUP BY ALL),
all1 AS (SELECT source, kind, j, CAST(2 * median(s) AS BIGINT) AS s FROM sh GROUP BY ALL),
everywhere AS (SELECT kind, list(s ORDER BY j) AS m FROM (
          SELECT kind, j, CAST(2 * median(s) AS BIGINT) AS s FROM all1 GROUP BY ALL) GROUP BY ALL),
votes AS (SELECT lang, count(*) AS votes, sum(docs) AS docs FROM (SELECT lang, source, count(*) AS docs FROM ok GROUP BY ALL) GROUP BY 1),
lg AS (SELECT lang AS rl, lang IN ({known}) IS TRUE AS known, coalesce(votes.votes >= 3 AND (lang IN ({known})
         OR (lang IS NOT NULL AND 100 * votes.docs >= 5 * (SELECT count(*) FROM ok))), false) AS independent
       FROM (SELECT DISTINCT lang FROM h2) l LEFT JOIN votes USING (lang)),
ref AS (SELECT rl, CASE WHEN independent THEN (SELECT m FROM own WHERE own.lang = rl AND kind = 0)
          ELSE (SELECT m FROM everywhere WHERE kind = 0) END AS rc FROM lg),
refk AS (SELECT rl, CASE WHEN NOT known THEN list_transform(range({BINS + 1}), lambda i: CAST(i = {BINS} AS BIGINT))
          WHEN independent THEN (SELECT m FROM own WHERE own.lang = rl AND kind = 1)
          ELSE (SELECT m FROM everywhere WHERE kind = 1) END AS rk FROM lg),
pairs AS (SELECT h2.*, list_zip(c, rc) AS zc, list_zip(k, refk.rk) AS zk,
            list_sum(c) AS nc, list_sum(rc) AS mc, list_sum(k) AS nk, list_sum(refk.rk) AS mk
          FROM h2 JOIN ref ON h2.lang IS NOT DISTINCT FROM ref.rl JOIN refk ON h2.lang IS NOT DISTINCT FROM refk.rl),
js AS (SELECT *,
  CASE WHEN nc > 0 AND mc > 0 THEN sqrt(greatest(0, list_sum(list_transform(zc, lambda z:
    (CASE WHEN z[1] > 0 THEN z[1] / nc * log2(2 * (z[1] / nc) / (z[1] / nc + z[2] / mc)) ELSE 0 END)
  + (CASE WHEN z[2] > 0 THEN z[2] / mc * log2(2 * (z[2] / mc) / (z[1] / nc + z[2] / mc)) ELSE 0 END))) / 2)) END AS jc,
  CASE WHEN nk > 0 AND mk > 0 THEN sqrt(greatest(0, list_sum(list_transform(zk, lambda z:
    (CASE WHEN z[1] > 0 THEN z[1] / nk * log2(2 * (z[1] / nk) / (z[1] / nk + z[2] / mk)) ELSE 0 END)
  + (CASE WHEN z[2] > 0 THEN z[2] / mk * log2(2 * (z[2] / mk) / (z[1] / nk + z[2] / mk)) ELSE 0 END))) / 2)) END AS jk
  FROM pairs)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(c[5] AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (len(words) < 50 OR 100 * n_repeat_words > 50 * len(words)) AS base_failed,
  (len(words) >= 50 AND 100 * n_repeat_words <= 50 * len(words)
   AND NOT coalesce((nc >= 300 AND jc > 0.3) OR (nk >= 100 AND jk > 0.25), false)) AS kept,
  round(jc, 6) AS char_distance, round(jk, 6) AS word_distance
FROM js"""


ORACLE = _sql()
