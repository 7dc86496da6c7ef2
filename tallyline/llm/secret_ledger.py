"""Secret scan with an incremental ledger of blobs.

Every version of every path is addressed by the digest of its content. The ledger records, for a digest,
which versions of which rules have read it and what they found. A run scans only pairs of blob and rule
version that the ledger lacks: a new version of a file costs one scan, a changed rule is run alone over the
blobs, and copies of a text are scanned once. Findings then join back to all rows by digest.

DataFrame functions only. A rule is a regular expression; the places of its matches follow from the
lengths of the matches and of the texts between them, both of which one split gives in order.

Edge cases: a null text is empty; null and repeated ids and repeated rows keep their own rows (rows that agree
in id and text are one version, scanned as often as they stand); very long texts and texts with very many
matches are scanned whole; an empty table gives an empty result and adds nothing to the ledger; other columns
are left out unless named in ``keep``.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyline.lineage import scratch_path
from tallyline.llm.common import let, table, whole_text, written

FINDING = "struct<rule:string,start:int,end:int>"
LEDGER_SCHEMA = f"digest binary, rules array<string>, findings array<{FINDING}>"
SPAN_TYPE = "array<struct<start:int,kind:int,end:int>>"
# Digests not yet scanned above this number meet their texts in an exchange; below it Catalyst may broadcast them.
FEW_PENDING = 50_000


@dataclasses.dataclass(frozen=True)
class Rule:
    """Leftmost, not overlapping matches of ``pattern`` whose group ``measured`` has ``least`` characters or more.

    ``needs`` names texts of which one must occur where the pattern matches: a quick test before it. ``base``
    marks the rules that a caller counts apart.
    """

    kind: str
    pattern: str
    least: int = 1
    measured: int = 0
    needs: tuple[str, ...] = ()
    base: bool = False

    @property
    def version(self) -> str:
        """Changes with whatever changes the findings."""
        text = "\x00".join([self.kind, self.pattern, str(self.least), str(self.measured)])
        return f"{self.kind}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


# Fixed forms of well-known credentials. ``assign`` takes its words in either case.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)",
         least=8, measured=2, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, needs=("AKIA",), base=True),
    # A run shorter than 32 is never a finding, so that only long runs are matched at all.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", least=32, base=True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("hosting_token", r"(?:gh[pousr]_|github_pat_|glpat-)[A-Za-z0-9_-]{20,}", needs=("gh", "glpat-")),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}", needs=("AIza",)),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}", needs=("k_live_",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^\s/@:]{6,128}@[A-Za-z0-9.-]+", needs=("://",)),
)


def running_sums(values: Column) -> Column:
    """Sums of an array's first 1, 2, ... elements; blocks of about its square root keep long arrays cheap."""
    def blocks(array: Column, width: Column) -> Column:
        count = F.ceil(F.size(array) / width).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(array, b * width + 1, width))
        return let(cut, lambda parts: let(F.transform(parts, total), lambda sums: F.flatten(F.transform(
            parts, lambda part, b: let(total(F.slice(sums, F.lit(1), b)), lambda before: F.transform(
                part, lambda _, i: before + total(F.slice(part, F.lit(1), i + 1))))))))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), operator.add)

    return let(values, lambda array: blocks(array, F.ceil(F.sqrt(F.size(array))).cast("int")))


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<rule, start, end>> of one rule; offsets are code points, ends exclusive."""
    def lengths(strings: Column) -> Column:
        return F.transform(strings, F.length)

    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = found if rule.measured == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured))
    between = F.split(text, rule.pattern, -1)
    # Each match and the text before it; after the last match nothing is needed.
    spans = let(lengths(found), lambda whole: let(
        running_sums(F.zip_with(F.slice(lengths(between), F.lit(1), F.size(whole)), whole, lambda a, b: a + b)),
        lambda ends: F.zip_with(F.zip_with(whole, ends, lambda n, end: F.struct(
            F.lit(rule.version).alias("rule"), (end - n).alias("start"), end.alias("end"))), lengths(measured),
            lambda span, n: F.when(n >= rule.least, span))))
    gate = text.rlike(rule.pattern)
    if rule.needs:
        gate = functools.reduce(operator.or_, [F.contains(text, F.lit(word)) for word in rule.needs]) & gate
    none = F.lit(None).cast(f"array<{FINDING}>")
    return F.coalesce(F.when(gate, F.filter(spans, lambda s: s.isNotNull())).otherwise(none), F.array().cast(f"array<{FINDING}>"))


def recorded(spark: SparkSession, ledger_path: str) -> DataFrame:
    """(digest, rules, findings): all that the ledger holds, one row per digest."""
    try:
        ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    except AnalysisException:  # nothing was scanned yet
        return spark.createDataFrame([], LEDGER_SCHEMA)
    # As many rows per digest as there were scans of it; two runs at once may have scanned a pair twice.
    return ledger.groupBy("digest").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"),
        F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))


def scan(
    versions: DataFrame,
    ledger_path: str,
    rules: Sequence[Rule] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(id, *keep, digest, spans), one row per row of ``versions``: every version of every path.

    ``spans`` holds (start, kind, end), sorted; ``kind`` is the place of the rule in ``rules``. The path, the
    revision and the like are columns to keep. ``ledger_path`` is a folder that lives as long as the findings
    shall; a second run over the same rows reads no text but to address it.
    """
    spark, wanted = versions.sparkSession, F.array(*[F.lit(r.version) for r in rules])
    digest = F.unhex(F.sha2(whole_text(text_column), 256))
    keys = written(versions.select(F.col(id_column).alias(id_column), *[F.col(f"`{c}`") for c in keep],
                                   digest.alias("digest")), "blob-keys")
    known = recorded(spark, ledger_path).select("digest", "rules")
    pending = written(
        keys.groupBy("digest").agg(F.min(id_column).alias("_one")).join(known, "digest", "left")
        .select(F.col("digest").alias("_digest"), "_one",
                F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>"))).alias("_todo"))
        .filter(F.size("_todo") > 0),
        "blobs-pending",
    )
    # One version of each blob brings its text. The key holds the id, so that copies of one text do not meet;
    # texts stream past the narrow side unsorted.
    narrow = pending if pending.count() <= FEW_PENDING else pending.hint("shuffle_hash")
    texts = versions.select(F.col(id_column).alias("_id"), whole_text(text_column).alias("_text"), digest.alias("_key"))
    chosen = texts.join(narrow, (F.col("_key") == F.col("_digest")) & F.col("_id").eqNullSafe(F.col("_one")))
    findings = F.concat(*[
        F.when(F.array_contains("_todo", rule.version), matches(F.col("_text"), rule))
        .otherwise(F.array().cast(f"array<{FINDING}>")) for rule in rules])
    scanned = chosen.select(F.col("_digest").alias("digest"), F.col("_todo").alias("rules"), findings.alias("findings"))
    scanned.write.mode("append").parquet(ledger_path)
    # Both sides of the join are plain exchanges, so that a digest of very many copies can be split.
    found = written(recorded(spark, ledger_path).select("digest", _spans(wanted).alias("spans")), "blob-findings")
    return keys.join(found, "digest").select(id_column, *[F.col(f"`{c}`") for c in keep], "digest", "spans")


def _spans(wanted: Column) -> Column:
    """The findings of the wanted rule versions as sorted (start, kind, end)."""
    placed = F.transform("findings", lambda f: F.struct(
        f["start"].alias("start"), (F.array_position(wanted, f["rule"]) - 1).cast("int").alias("kind"), f["end"].alias("end")))
    return F.array_sort(F.filter(placed, lambda s: s["kind"] >= 0)).cast(SPAN_TYPE)


def spelled(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Secrets of all documents; without a ``ledger_path`` the ledger starts empty."""
    found = scan(table(spark, sf_dir, "documents"), ledger_path or scratch_path(spark, "secret-ledger"))
    base = [i for i, rule in enumerate(RULES) if rule.base]

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{RULES[kind].kind}")

    return found.select(
        "doc_id", *map(count, base),
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """The same result in DuckDB: no ledger, every text by every rule."""
    # No case folding or look-behind there; runs are maximal in any case, since matches begin leftmost.
    patterns = {
        "assign": "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
                  "|[aA][pP][iI]_?[kK][eE][yY])[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)",
        "hex": "[0-9a-f]+",
        "url_login": "[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[^ \\t\\n\\x0B\\f\\r/@:]{6,128}@[A-Za-z0-9.-]+",
    }
    parts = []
    for kind, rule in enumerate(RULES):
        pattern = patterns.get(rule.kind, rule.pattern)
        parts.append(
            f"SELECT r, {kind} AS kind, '{rule.kind}' AS name, regexp_extract_all(t, '{pattern}') AS m, "
            f"regexp_extract_all(t, '{pattern}', {rule.measured}) AS g, string_split_regex(t, '{pattern}') AS b, "
            f"{rule.least} AS least FROM d WHERE regexp_matches(t, '{pattern}')")
    base = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, unnest(m) AS w, unnest(g) AS v, unnest(b[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM m),
s AS (SELECT *, sum(length(w) + length(gap)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM e),
f AS (SELECT r, kind, stop - length(w) AS start, name || ':' || CAST(stop - length(w) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS spell
      FROM s WHERE length(v) >= least),
a AS (SELECT r, {counts}, string_agg(spell, ',' ORDER BY start, kind) FILTER (WHERE kind IN ({base})) AS base,
        string_agg(spell, ',' ORDER BY start, kind) AS spans FROM f GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in RULES if r.base)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)"""


ORACLE = _sql()
