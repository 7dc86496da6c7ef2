"""Personal data: exact patterns, and spans added by a linear-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans. The tagger reads words by their shape
(runs of letters and digits), checksums and neighbours, and adds spans that touch no base span. It
is trained on a small labelled table by maximum likelihood with a quadratic penalty, and decoded by
Viterbi for all word sequences of a batch at once.

A word without a digit or ``@`` is outside every span by construction, so a text falls into
independent runs of words that have one; decoding these runs is decoding the whole text.

Edge cases: a null text is empty and has no spans; null and repeated ids and repeated rows keep
their own rows; very long words and digit runs are scanned in linear time; an empty table gives an
empty result; other columns are left out by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table, unused, whole_text
from tallyline.llm.pii_examples import EXAMPLES

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits begins: from inside the run it would fail in the same way.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
MARKS = "@0123456789"

# --- base patterns ------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    doubled = [v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)]
    return sum(doubled) % 10 == 0


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Local part, ``@``, dotted domain, leftmost first: each ``@`` is tried with all that may stand before it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    spans = [("email", a, b) for a, b in emails(text)]
    if any(c in text for c in MARKS[1:]):
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(map(byte_sized, m.groups()))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# --- word features ------------------------------------------------------------------------------

# Fixed word lists: what often stands before a span, or before a number that is none.
CUES = {
    "phone": "tel telefon telephone phone call called fax mobile cell handy rufnummer ruf anruf téléphone portable "
             "appelez le teléfono móvil llame al reach ring",
    "email": "mail email e-mail courriel correo write contact send",
    "ip": "ip host server servidor adresse address connect open",
    "card": "card visa mastercard karte carte tarjeta credit",
    "other": "order invoice isbn version id number key code rechnung facture pedido page chapter section page line lines",
}
CUE_OF = {word: kind for kind, words in CUES.items() for word in words.split()}
EDGE = ".,;:!?\"'«»[]<>"


def shape(core: str) -> str:
    """Runs of letters as x, runs of digits as d with their length, all else as it is."""
    parts = re.findall(r"[0-9]+|[^\W\d_]+|.", core[:200], re.S)
    if len(parts) > 12 or len(core) > 60:
        return "long"
    return "".join(f"d{min(len(p), 20)}" if p[0] in MARKS[1:] else "x" if p.isalpha() else p for p in parts)


def coarse(core: str) -> str:
    return re.sub(r"d[0-9]+", "d", shape(core))


def marked(word: str) -> bool:
    return any(c in word for c in MARKS)


def runs_of(text: str) -> list[tuple[list[tuple[int, int]], str, str]]:
    """Runs of neighbouring marked words: (word bounds, word before, word after)."""
    runs: list[tuple[list[tuple[int, int]], str, str]] = []
    current: list[tuple[int, int]] = []
    before = last = ""
    for m in WORD.finditer(text):
        if marked(m.group()):
            if not current:
                before = last
            current.append(m.span())
        elif current:
            runs.append((current, before, m.group()))
            current = []
        last = m.group()
    if current:
        runs.append((current, before, ""))
    return runs


def run_features(text: str, bounds: Sequence[tuple[int, int]], before: str, after: str) -> list[list[str]]:
    words = [text[a:b] for a, b in bounds]
    cores = [w.strip(EDGE) for w in words]
    cue = CUE_OF.get(before.strip(EDGE + "()").lower(), "word" if before else "none")
    coarse_shapes = [coarse(c) for c in cores]
    digits = [sum(c in MARKS[1:] for c in w) for w in cores]
    out = []
    for i, core in enumerate(cores):
        plain = core.replace("-", "")
        names = [
            f"shape={shape(core)}", f"coarse={coarse_shapes[i]}", f"cue={cue},{'first' if i == 0 else 'later'}",
            f"previous={coarse_shapes[i - 1] if i else 'start'}",
            f"next={coarse_shapes[i + 1] if i + 1 < len(cores) else 'end'}",
            f"digits={min(digits[i], 20)}", f"run={min(len(cores), 6)}",
        ]
        if "@" in core[1:-1]:
            names.append("at-inside")
        if core[:1] == "@" or core[-1:] == "@":
            names.append("at-edge")
        if core[:1] == "+":
            names.append("plus")
        parts = core.split(":")[0].split("/")[0].split(".")
        if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
            names.append("address" if all(map(byte_sized, parts)) else "no-address")
        if 14 <= len(plain) <= 19 and plain.isascii() and plain.isdigit():
            names.append("checksum" if luhn(plain) else "no-checksum")
        near = "".join(c for w in cores[i:i + 5] for c in w if c in MARKS[1:])[:19]
        if i == 0 and digits[0] == 4 and len(near) >= 16 and luhn(near[:16]):
            names.append("checksum-ahead")
        out.append(names)
    return out


# --- the field ----------------------------------------------------------------------------------


def parse(example: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A marked sentence as text and spans."""
    text, spans = "", []
    for plain, kind, inside in re.findall(r"([^{]*)(?:\{(\w+)\|([^}]*)\})?", example):
        text += plain
        if kind:
            spans.append((kind, len(text), len(text) + len(inside)))
            text += inside
    return text, spans


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights of features by label, of label pairs, and of first labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        self.names, self.weights, self.pairs, self.first = names, weights, pairs, first

    def scores(self, runs: Sequence[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Label scores of all words, padded to the longest run, and the lengths."""
        lengths = np.array([len(r) for r in runs])
        out = np.zeros((len(runs), int(lengths.max()), len(LABELS)))
        for i, run in enumerate(runs):
            for j, names in enumerate(run):
                known = [self.names[n] for n in names if n in self.names]
                out[i, j] = self.weights[known].sum(axis=0)
        return out, lengths

    def decode(self, runs: Sequence[list[list[str]]]) -> list[list[int]]:
        """The best labels of each run; runs of similar length are decoded together."""
        result: list[list[int]] = [[] for _ in runs]
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        start = 0
        while start < len(order):
            end, words = start, 0
            while end < len(order) and (end == start or (words + len(runs[order[end]]) < 20_000 and len(runs[order[end]]) <= 2 * len(runs[order[start]]))):
                words += len(runs[order[end]])
                end += 1
            group = order[start:end]
            scores, lengths = self.scores([runs[i] for i in group])
            for i, path in zip(group, self._viterbi(scores, lengths)):
                result[i] = path
            start = end
        return result

    def _viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        n, steps, _ = scores.shape
        best = scores[:, 0] + self.first
        back = np.zeros((n, steps, len(LABELS)), dtype=np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + self.pairs[None]
            back[:, t] = through.argmax(axis=1)
            best = np.where((lengths > t)[:, None], through.max(axis=1) + scores[:, t], best)
        path = np.zeros((n, steps), dtype=np.int8)
        at = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            inside = lengths > t
            path[inside, t] = at[inside]
            moved = back[np.arange(n), t, at]
            at = np.where(inside & (t > 0), moved, at)
        return [p[:k].tolist() for p, k in zip(path, lengths)]


def labels_of(bounds: Sequence[tuple[int, int]], spans: Sequence[tuple[str, int, int]]) -> list[int]:
    out = []
    for a, b in bounds:
        label = 0
        for kind, start, end in spans:
            if a < end and start < b:
                label = LABELS.index(("B-" if a <= start or not out or not any(x < a and start < y for x, y in bounds) else "I-") + kind)
        out.append(label)
    return out


@functools.cache
def trained(penalty: float = 0.02, rounds: int = 250) -> Field:
    """The field of the labelled table: gradient ascent with adaptive steps on all runs at once."""
    runs, tags = [], []
    for example in EXAMPLES:
        text, spans = parse(example)
        for bounds, before, after in runs_of(text):
            runs.append(run_features(text, bounds, before, after))
            tags.append(labels_of(bounds, spans))
    names: dict[str, int] = {}
    for run in runs:
        for word in run:
            for name in word:
                names.setdefault(name, len(names))
    count, steps, k = len(runs), max(map(len, runs)), len(LABELS)
    inside = np.zeros((count, steps), dtype=bool)
    gold = np.zeros((count, steps), dtype=np.int64)
    used = np.zeros((count, steps, len(names)))
    for i, (run, tag) in enumerate(zip(runs, tags)):
        inside[i, :len(run)] = True
        gold[i, :len(tag)] = tag
        for j, word in enumerate(run):
            used[i, j, [names[n] for n in word]] = 1
    truth = np.eye(k)[gold] * inside[:, :, None]
    both = inside[:, 1:, None, None] * truth[:, :-1, :, None] * truth[:, 1:, None, :]
    field = Field(names, np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k))
    state = [np.zeros_like(field.weights), np.zeros_like(field.pairs), np.zeros_like(field.first)]
    for _ in range(rounds):
        scores = used @ field.weights
        forward = np.zeros((count, steps, k))
        forward[:, 0] = scores[:, 0] + field.first
        for t in range(1, steps):
            step = _logsumexp(forward[:, t - 1, :, None] + field.pairs[None], 1) + scores[:, t]
            forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
        total = _logsumexp(forward[:, -1], 1)
        backward = np.zeros((count, steps, k))
        for t in range(steps - 2, -1, -1):
            step = _logsumexp(field.pairs[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        single = np.exp(forward + backward - total[:, None, None]) * inside[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + field.pairs + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
                      - total[:, None, None, None]) * inside[:, 1:, None, None]
        gradients = [
            np.einsum("rtf,rtk->fk", used, truth - single) - penalty * field.weights,
            (both - pair).sum(axis=(0, 1)) - penalty * field.pairs,
            (truth[:, 0] - single[:, 0]).sum(axis=0) - penalty * field.first,
        ]
        for weights, gradient, seen in zip((field.weights, field.pairs, field.first), gradients, state):
            seen += gradient ** 2
            weights += 0.5 * gradient / np.sqrt(seen + 1e-8)
    return field


def spans_from(text: str, bounds: Sequence[tuple[int, int]], path: Sequence[int]) -> list[tuple[str, int, int]]:
    """Tagged words as spans, without punctuation at their ends."""
    found: list[list] = []
    for (a, b), label in zip(bounds, path):
        if not label:
            continue
        kind, begins = KINDS[(label - 1) // 2], label % 2 == 1
        if not begins and found and found[-1][0] == kind and found[-1][3]:
            found[-1][2] = b
        else:
            found.append([kind, a, b, True])
        found[-1][3] = True
    out = []
    for kind, a, b, _ in found:
        while a < b and text[a] in EDGE:
            a += 1
        while a < b and text[b - 1] in EDGE:
            b -= 1
        if a < b:
            out.append((kind, a, b))
    return out


def all_spans(texts: Sequence[str], field: Field) -> list[list[dict]]:
    """Base spans of each text and the tagger's spans that touch none of them."""
    base = [base_spans(t) if marked(t) else [] for t in texts]
    runs, owner = [], []
    for i, text in enumerate(texts):
        if marked(text):
            for run in runs_of(text):
                runs.append(run)
                owner.append(i)
    paths = field.decode([run_features(texts[i], *run) for i, run in zip(owner, runs)]) if runs else []
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, (bounds, _, _), path in zip(owner, runs, paths):
        added[i] += spans_from(texts[i], bounds, path)
    out = []
    for spans, more in zip(base, added):
        ends = sorted((a, b) for _, a, b in spans)
        starts = [a for a, _ in ends]
        furthest = np.maximum.accumulate([b for _, b in ends]) if ends else []
        rows = [(k, a, b, True) for k, a, b in spans]
        for k, a, b in more:
            before = int(np.searchsorted(starts, b, "left"))  # base spans that start before this one ends
            if before == 0 or furthest[before - 1] <= a:
                rows.append((k, a, b, False))
        rows.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        out.append([dict(zip(("kind", "start", "end", "base"), r)) for r in rows])
    return out


# --- operators ----------------------------------------------------------------------------------


def find(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans): all spans of every text, by start and kind; offsets are code points, ends exclusive."""
    field = field or trained()

    def tag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({id_column: frame[id_column].array, "spans": all_spans(frame["_text"].tolist(), field)})

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias(id_column), whole_text(text_column).alias("_text")).mapInPandas(
        tag, f"{id_column} {kind}, spans {SPAN_TYPE}")


def masked(text: str, spans: Sequence[dict]) -> str:
    """The text with each span (overlapping ones together) replaced by the kind of its first."""
    parts, done = [], 0
    for span in spans:
        if span["end"] <= done:
            continue
        if span["start"] >= done:
            parts += [text[done:span["start"]], f"[{span['kind'].upper()}]"]
        done = span["end"]
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, field: Field | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind, and all other columns as they are."""
    field = field or trained()
    (name,) = unused(docs, "_masked")

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        have = texts.fillna("").tolist()
        done = [masked(t, s) for t, s in zip(have, all_spans(have, field))]
        return pd.Series(done, index=texts.index, dtype=object).where(texts.notna(), None)

    return docs.withColumn(name, mask(F.col(text_column).cast("string"))).select(
        *[F.col(name).alias(text_column) if c == text_column else F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
    )
