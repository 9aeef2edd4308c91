"""Secret scan: pattern rules plus sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of the characters of a secret (letters, digits, ``+/_=.-``).  For each
character class a window of fixed width slides over the candidate; the entropy of its characters is
kept by incremental counts (one character enters, one leaves), and windows at or above the class's
threshold are joined into spans.  ``=`` only divides a name from its value or pads a value: the parts
of a candidate around it are judged on their own, and padding after a span belongs to the span.
Candidates and parts on the allow-list (UUIDs, dates, versions, links, words, also with a number
after them) give no entropy span, so a secret of letters of one case only is not told from a word.
Texts below 16 characters fill no window and are left to the pattern rules.  Pattern spans always stay.

Pattern rules, each leftmost and non-overlapping within its kind, matches that fail dropped:

* ``assign``: a name such as ``api_key`` or ``password`` in either case, ``:`` or ``=``, and a value
  of 12 characters or more; the span is the whole match;
* ``access``: ``AKIA`` and capitals or digits, 18 characters or more;
* ``hex``: a run of lower-case hexadecimal digits, 16 characters or more.

Nulls and edge cases: a null text counts as empty and has no span; every input row gives one output
row, repeated rows and null ids included; no other column is read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sensortwin.llm.common import map_rows, ship, slices, texts_of

BASE_KINDS = ("assign", "access", "hex")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a greedy run of at least n equals a greedy run whose short matches are dropped
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MIN_VALUE = 12
#: Behind a ``=`` that something else follows, a value begins.
_PARTS = re.compile(r"(?<==)(?=[^=])")


@dataclass(frozen=True)
class EntropyClass:
    """Windows of ``width`` characters of ``chars`` whose entropy is ``bits`` or more; up to ``pad``
    signs ``=`` after the last one are taken along."""

    kind: str
    chars: str
    width: int
    bits: float
    pad: int = 0


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The limits are what 99 of 100 random windows of 16 characters reach, drawn from 16, 32, 36 and 64
#: different characters (20,000 windows each: 2.68, 3.08, 3.16 and 3.33 bits at that quantile).
ENTROPY_CLASSES = (
    EntropyClass("entropy_hex", "0123456789abcdefABCDEF", 16, 2.67),
    EntropyClass("entropy_base32", _UPPER + "234567", 16, 3.07, 6),
    EntropyClass("entropy_lower", _LOWER + _DIGITS, 16, 3.15),
    EntropyClass("entropy_upper", _UPPER + _DIGITS, 16, 3.15),
    EntropyClass("entropy_base64", _UPPER + _LOWER + _DIGITS + "+/_-", 16, 3.32, 2),
)
#: A candidate that one of these matches as a whole is no secret.
ALLOW_LIST = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
    r"[0-9.:/_=-]+",  # numbers, dates, versions, rulers
    r"[A-Z]?[a-z]+(?:[._/=-]+[A-Z]?[a-z]+)*[._/=-]*",  # words, also joined or as a path
    r"[A-Z]+(?:[._/=-]+[A-Z]+)*[._/=-]*",
    # words, capitals within included, each with a number after it or none: names, paths, hosts
    r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+)?[0-9]*(?:[._/=-](?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+)?[0-9]*)*",
    r"(?://|www\.)[A-Za-z0-9._/=-]+",  # the rest of a link after its scheme
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern spans ``(start, end, kind)`` by start, then kind in the order of ``BASE_KINDS``."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def entropy_windows(run: str, cls: EntropyClass) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``run`` that lie in the class and reach its entropy.

    The sum of c*log2(c) over the characters' counts c changes by one step for the character that
    enters and one for the character that leaves, so a window costs constant time.
    """
    w = cls.width
    step = [0.0] + [c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0.0) for c in range(1, w + 1)]
    limit = w * (math.log2(w) - cls.bits) + 1e-9  # entropy >= bits <=> sum of c log2 c <= limit
    allowed, counts, total, size = set(cls.chars), {}, 0.0, 0
    spans: list[list[int]] = []
    for i, ch in enumerate(run):
        if ch not in allowed:
            counts, total, size = {}, 0.0, 0
            continue
        if size == w:
            old = run[i - w]
            total -= step[counts[old]]
            counts[old] -= 1
        else:
            size += 1
        counts[ch] = counts.get(ch, 0) + 1
        total += step[counts[ch]]
        if size == w and total <= limit:
            if spans and i - w + 1 <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([i - w + 1, i + 1])
    return [(a, b) for a, b in spans]


def _padded(run: str, end: int, pad: int) -> int:
    """``end``, or the end of the ``=`` that follow it, ``pad`` at most."""
    last = min(len(run), end + pad)
    while end < last and run[end] == "=":
        end += 1
    return end


class Scanner:
    """The rules compiled once per Python worker."""

    def __init__(self, classes: Iterable[EntropyClass] = ENTROPY_CLASSES, allow_list: Iterable[str] = ALLOW_LIST):
        self.classes = tuple(classes)
        self.kinds = {k: i for i, k in enumerate((*BASE_KINDS, *(c.kind for c in self.classes)))}
        least = min((c.width for c in self.classes), default=0)
        self.candidates = re.compile(rf"[A-Za-z0-9+/_=.-]{{{least},}}") if self.classes else None
        allow = "|".join(f"(?:{p})" for p in allow_list)
        self.allowed = re.compile(allow).fullmatch if allow else lambda s: None

    def entropy_spans(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        if self.candidates is None:
            return out
        for m in self.candidates.finditer(text):
            if self.allowed(m.group()):
                continue
            at = m.start()
            for run in _PARTS.split(m.group()):
                if not self.allowed(run):
                    out += [(at + a, at + _padded(run, b, cls.pad), cls.kind) for cls in self.classes for a, b in entropy_windows(run, cls)]
                at += len(run)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """All spans ``(start, end, kind)`` in code points by start, then kind."""
        return sorted(base_spans(text) + self.entropy_spans(text), key=lambda s: (s[0], self.kinds[s[2]], s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, classes: Iterable[EntropyClass] = ENTROPY_CLASSES, allow_list: Iterable[str] = ALLOW_LIST,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``spans``, an array of ``(start, end, kind, secret)``."""
    scanner = Scanner(classes, allow_list)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        texts = texts_of(batch)
        return {id_col: batch.column(0), "spans": [
            [{"start": a, "end": b, "kind": k, "secret": t[a:b]} for a, b, k in scanner.spans(t)] for t in texts]}

    return map_rows(docs.select(id_col, docs[text_col].alias("text")), run,
                    f"`{id_col}` {id_type}, spans array<struct<start:int,`end`:int,kind:string,secret:string>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the pattern spans and all spans as text, from :func:`scan`'s rows."""
    from pyspark.sql import functions as F

    def label(kept):
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        id_col,
        *[count(k) for k in BASE_KINDS],
        F.sha2(label(base), 256).alias("base_sha256"), label(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans become one mark.  All
    columns stay as they are but for the text and, where present, ``n_chars``; a null text stays null."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                texts = [None if t is None else _redact(t, mark) for t in part.column(place).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array(texts, part.schema.field(place).type)
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(part.schema.field(counted).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


#: Bytes of documents redacted at once.
SLICE_BYTES = 4 << 20
_DEFAULT = Scanner()


def _redact(text: str, mark: str) -> str:
    out, at = [], 0
    for a, b, _ in _DEFAULT.spans(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:] if out else text
