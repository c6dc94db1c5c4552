"""Personal data in texts, disguised forms included, at offsets of the source.

Plain identifiers are found by four patterns. For disguised ones, transducers
rewrite the text: look-alike characters become ASCII, invisible ones go, spelled digits
become digits, and written-out "at" and "dot" become signs. Each rewritten
character remembers the source characters it came from, so an identifier found
in the rewritten text maps back to a source span. Spans of the plain patterns always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: No match starts within a run of digits: if the run's first digit starts none, its others don't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Matches of local@domain.domain..., found from the sign outwards."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


_HAS_DIGIT = re.compile(r"[0-9]")


def plain_spans(text: str) -> dict[str, list[Span]]:
    digit = _HAS_DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digit else [],
        "card": cards(text) if digit else [],
        "phone": phones(text) if digit and "+" in text else [],
    }


# Letters of other scripts that are drawn like Latin ones.
_LIKE = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονγ", "ABEKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXovy", strict=True))
# Signs drawn like the ones identifiers use.
_SIGNS = {"․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ", " ": " "}
_UNSEEN = "­​‌‍⁠﻿"


def _likeness() -> dict[str, str]:
    """Look-alikes: the tables above, and every character whose compatibility form is one ASCII character."""
    out = {**_LIKE, **_SIGNS, **dict.fromkeys(_UNSEEN, "")}
    ranges = [(0x0660, 0x066A), (0x06F0, 0x06FA), (0x0966, 0x0970), (0x2460, 0x2469), (0x24B6, 0x24EB), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)]
    for low, high in ranges:
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            if digit is not None:
                out[c] = str(digit)
            elif len(plain) == 1 and " " < plain < "\x7f":
                out[c] = plain
    return out


LIKE = _likeness()


def _ranges(chars: str) -> str:
    """A character class by runs of neighbours: a long list of single characters would be searched one by one."""
    codes = sorted(map(ord, chars))
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


_ODD = re.compile(_ranges("".join(LIKE)))

# Digits spelled in the languages of the corpus.
SPELLED = {
    w: str(d)
    for d, of in enumerate(
        ("zero oh null cero zéro", "one eins uno un", "two zwei zwo dos deux", "three drei tres trois", "four vier cuatro quatre", "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")
    )
    for w in of.split()
}
_REPEAT = {"double": 2, "triple": 3}
_SPELL = "|".join(sorted(SPELLED, key=len, reverse=True))
_GAP = r"(?:[\x20\t]*[-,.][\x20\t]*|[\x20\t]+)"
_UNIT = rf"(?:(?:(?:{'|'.join(_REPEAT)}){_GAP})?(?:{_SPELL})|[0-9]+)"
#: Runs of spelled digits, maybe mixed with plain ones; short runs are ordinary words.
_SPELLED_RUN = re.compile(rf"(?<!\w)(?:(?:plus|más)[\x20\t]+|\+[\x20\t]*)?{_UNIT}(?:{_GAP}(?:(?:dot|point|punto|punkt){_GAP})?{_UNIT}){{3,}}(?!\w)", re.I)
_TOKEN = re.compile(rf"plus|más|dot|point|punto|punkt|{'|'.join(_REPEAT)}|{_SPELL}|[0-9]+|\+|[^\w\s]|\s+", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
_UNITS = {w: "1" for w in (*SPELLED, *_REPEAT, "dot", "point", "punto", "punkt", "plus", "más")}
_SIGN_WORDS = frozenset("dot punto punkt point dt at arroba arobase ät chez".split())


def _may_spell(words: list[str], digits: bool) -> bool:
    """Whether two number words meet, or one is in a text that has digits too."""
    if _UNITS.keys().isdisjoint(words):
        return False
    marks = "".join([_UNITS.get(w, "0") for w in words])
    return "11" in marks or digits


_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase|ät|chez)", r"(?:dot|punto|punkt|point|dt)"
_AROUND = r"(?:\s*+[-_*/|~]\s*+|\s++)"
_AT_SIGN = rf"(?:\s*+{_OPEN}\s*+(?:{_AT_WORD}|@)\s*+{_SHUT}\s*+|{_AROUND}{_AT_WORD}{_AROUND}|\s*+@\s*+)"
_DOT_SIGN = rf"(?:\s*+{_OPEN}\s*+(?:{_DOT_WORD}|\.)\s*+{_SHUT}\s*+|{_AROUND}{_DOT_WORD}{_AROUND}|\.)"
#: Local part, sign, and a domain; labels end before the next sign, so "-dot-" is not a part of one.
_LOCAL = rf"[A-Za-z0-9_%+]+(?:-(?!{_AT_WORD}-|{_DOT_WORD}-)[A-Za-z0-9_%+]+)*"
_NAME = rf"[A-Za-z0-9]+(?:-(?!{_DOT_WORD}-)[A-Za-z0-9]+)*"
_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:{_DOT_SIGN}{_LOCAL})*", re.I)
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:{_DOT_SIGN}{_LOCAL})*(?P<at>{_AT_SIGN}){_NAME}(?:{_DOT_SIGN}{_NAME})+", re.I)
_AT_ONLY, _DOT_ONLY = re.compile(_AT_SIGN, re.I), re.compile(_DOT_SIGN, re.I)
_WRITTEN = re.compile(rf"(?<![A-Za-z]){_DOT_WORD}(?![A-Za-z])|{_OPEN}\s*(?:{_AT_WORD}|@|\.)\s*{_SHUT}|\s@|@\s|[-_*/|~]\s*{_AT_WORD}\s*[-_*/|~\s]|\s{_AT_WORD}\s*[-_*/|~]", re.I)
_BRACED = re.compile(rf"{_OPEN}|[*_|~/-]\s*{_AT_WORD}\s*[*_|~/-]", re.I)
_DOT_TEXT = re.compile(rf"(?<![A-Za-z]){_DOT_WORD}(?![A-Za-z])", re.I)
_OCTETS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT_SIGN}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


class Traced:
    """A text and, for each of its characters, the span of the source it stands for."""

    def __init__(self, text: str, start: array | None = None, end: array | None = None, changed: bytearray | None = None):
        self.text = text
        self.start = array("q", range(len(text))) if start is None else start
        self.end = array("q", range(1, len(text) + 1)) if end is None else end
        self.changed = bytearray(len(text)) if changed is None else changed

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replaces each (from, to) in order; new characters stand for the whole of what they replace."""
        text: list[str] = []
        start, end = array("q"), array("q")
        changed = bytearray()
        at = 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            start += self.start[a : a + 1] * len(new)
            end += self.end[b - 1 : b] * len(new)
            changed += b"\x01" * len(new)
            at = b
        text.append(self.text[at:])
        return Traced("".join(text), start + self.start[at:], end + self.end[at:], changed + self.changed[at:])

    def span(self, a: int, b: int) -> Span:
        return self.start[a], self.end[b - 1]

    def touched(self, a: int, b: int) -> bool:
        return any(self.changed[a:b]) or self.end[b - 1] - self.start[a] != b - a


def _unlike(t: Traced) -> Traced:
    return t.rewritten([(m.start(), m.end(), LIKE[m[0]]) for m in _ODD.finditer(t.text)])


def _spelled(t: Traced) -> Traced:
    """Each run of spelled digits becomes digits, each standing for its word; gaps become nothing, or a dot if spelled."""
    edits: list[tuple[int, int, str]] = []
    for m in _SPELLED_RUN.finditer(t.text):
        if not re.search(rf"(?<!\w)(?:{_SPELL})(?!\w)", m[0], re.I):
            continue
        times = 1
        for w in _TOKEN.finditer(m[0]):
            a, b, word = m.start() + w.start(), m.start() + w.end(), w[0].lower()
            if word in SPELLED:
                edits.append((a, b, SPELLED[word] * times))
                times = 1
            elif word in _REPEAT:
                edits.append((a, b, ""))
                times = _REPEAT[word]
            elif word in ("plus", "más"):
                edits.append((a, b, "+"))
            elif word in ("dot", "point", "punto", "punkt"):
                edits.append((a, b, "."))
            elif not word[0].isdigit() and word not in "+.":
                edits.append((a, b, ""))
    return t.rewritten(edits)


def _addresses(text: str) -> Iterator[re.Match]:
    """Disguised addresses. A chain of names and dots that starts none is passed over whole: each of its names would only go through its rest again."""
    at = 0
    while chain := _CHAIN.search(text, at):
        m = _DISGUISED.match(text, chain.start())
        if m:
            yield m
        at = m.end() if m else chain.end()


def _signs(t: Traced) -> Traced:
    """Written-out at and dot signs become signs where they shape an address."""
    edits: list[tuple[int, int, str]] = []
    for m in _addresses(t.text):
        a, b = m.span("at")
        tail = t.text[b : m.end()]
        # a bare "at" needs written dots and a top-level label of letters: "look at it. The" is prose
        marked = "@" in m["at"] or _BRACED.search(m["at"])
        if not marked and not _DOT_TEXT.search(tail):
            continue
        if not re.search(r"[A-Za-z]{2,}$", tail):
            continue
        # nor is "meet at two three four five dot com": a number in words is no label after a bare "at"
        label = re.match(r"[0-9]+(?![A-Za-z-])", tail)
        if not marked and label and all(t.changed[b : b + label.end()]):
            continue
        if "@" in m["at"] and m["at"].strip() == "@" and m["at"] != "@" and not _DOT_TEXT.search(tail) and not re.search(r"\.[A-Za-z]{2,}$", tail):
            continue
        edits += [(x.start(), x.end(), ".") for x in _DOT_ONLY.finditer(t.text, m.start(), a) if x[0] != "."]
        if m["at"] != "@":
            edits.append((a, b, "@"))
        edits += [(x.start(), x.end(), ".") for x in _DOT_ONLY.finditer(t.text, b, m.end()) if x[0] != "."]
    out = t.rewritten(edits)
    dots = [
        (x.start(), x.end(), ".") for m in _OCTETS.finditer(out.text) for x in _DOT_ONLY.finditer(out.text, *m.span()) if x[0] != "."
    ]
    return out.rewritten(dots) if dots else out


def disguised_spans(text: str) -> dict[str, list[Span]]:
    """Source spans of identifiers that show only in the rewritten text; empty where nothing can be rewritten."""
    traced = _unlike(Traced(text)) if not text.isascii() and _ODD.search(text) else None
    plain = traced.text if traced else text
    words = _LETTERS.findall(plain.lower())
    if _may_spell(words, _HAS_DIGIT.search(plain) is not None):
        traced = _spelled(traced or Traced(plain))
        plain = traced.text
    if ("@" in plain or "[" in plain or "(" in plain or "{" in plain or "<" in plain or not _SIGN_WORDS.isdisjoint(words)) and _WRITTEN.search(plain):
        traced = _signs(traced or Traced(plain))
    if traced is None:
        return {}
    return {k: [traced.span(a, b) for a, b in of if traced.touched(a, b)] for k, of in plain_spans(traced.text).items()}


def find_pii(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans) as (kind, start, end), in code points, by start and then kind as listed."""
    text = text or ""
    rank = {k: n for n, k in enumerate(KINDS)}
    base = {(k, a, b) for k, of in plain_spans(text).items() for a, b in of}
    more = {(k, a, b) for k, of in disguised_spans(text).items() for a, b in of}
    by = lambda s: (s[1], rank[s[0]], s[2])
    return sorted(base, key=by), sorted(base | more, key=by)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_sha256``, ``spans`` and ``found`` (array of kind, start, end, text) added.

    ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` count the plain patterns' spans, whose
    listing ``base_sha256`` digests; ``spans`` and ``found`` also hold the disguised ones. Null and empty texts have none.
    Rows are independent: repeated rows come out alike, empty tables empty. Columns of ``docs`` are carried; those
    named as the new ones are replaced.
    """
    item = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("text", "string")
    new = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType()), ("found", T.ArrayType(item))]
    docs = docs.select(*[c for c in docs.columns if c not in dict(new)])
    at, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)])
    for k, (_, kind) in enumerate(new):
        schema = schema.add(f"c{width + k}", kind)
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, found = [], [], []
            for value in batch.column(at):
                text = value.as_py() or ""
                base, every = find_pii(text)
                for n, k in zip(counts, KINDS, strict=True):
                    n.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
                found.append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for k, a, b in every])
            arrays = [batch.column(k) for k in range(width)] + [pa.array(n, pa.int64()) for n in counts]
            arrays += [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(found, found_type)]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])

    return docs.mapInArrow(run, schema).toDF(*docs.columns, *[name for name, _ in new])
