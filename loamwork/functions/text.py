"""Scalar text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions.vectors import let

TOKEN = r"[\p{L}\p{N}\-_./]+"
CONNECTORS = "-_./"
#: The closed set of categories.
CATEGORIES = ("concept", "procedure", "reference", "snippet", "configuration", "definition", "example", "other")
#: Words that label nothing.
STOP_WORDS = tuple("a an the and or of to in on for with how do i is it what can my me does why when are be this that from at by into was we you not no".split())
#: Units that make a number a value.
UNITS = tuple("s ms us ns m h d w y b k kb mb gb tb pb kib mib gib tib hz khz mhz ghz px x".split())


def token_estimate(text: Column) -> Column:
    """Characters times 2/7, rounded down."""
    return F.floor(F.char_length(text) * 2 / 7).cast("long")


def output_ceiling(context: Column, prompt: Column, most: Column) -> Column:
    """What a reply may take: the context less the prompt and a headroom of an eighth of it (64 to 512), capped."""
    headroom = F.least(F.greatest(F.floor(prompt / 8), F.lit(64)), F.lit(512))
    return F.least(F.greatest(context - prompt - headroom, F.lit(0)), most).cast("long")


def segment_budget(usable: int, most_out: int, ratio: float) -> int:
    """Input tokens of a segment whose output is ``ratio`` times as long; 256 at least."""
    ratio = max(ratio, 0.1)
    return max(256, int(min(usable / (1 + ratio), most_out / ratio)))


def cut_long_line(line: Column, tokens: int) -> Column:
    """Pieces of max(tokens * 7/2, 64) characters."""
    width = max(tokens * 7 // 2, 64)
    n = F.greatest(F.ceil(F.char_length(line) / width), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(line, k * width + 1, F.lit(width)))


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, from 1, both included; empty where the range is not valid."""
    lines = F.split(text, "\n")
    return F.when((start >= 1) & (end >= start) & (start <= F.size(lines)), F.array_join(F.slice(lines, start, end - start + 1), "\n")).otherwise("")


def title(text: Column, most: int = 80) -> Column:
    """First heading without its marks, else the first line that is not blank; null if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    headings = F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+\S"))
    filled = F.filter(lines, lambda x: x != "")
    found = F.coalesce(F.regexp_replace(F.get(headings, F.lit(0)), r"^#{1,6}\s+", ""), F.get(filled, F.lit(0)))
    return F.substring(found, 1, most)


def lexical_tokens(text: Column) -> Column:
    """Runs of letters, digits and connectors, trimmed and lowered, 40 bytes at most; compounds are followed by their parts."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), lambda t: F.lower(F.btrim(t, F.lit(CONNECTORS))))
    whole = F.filter(runs, lambda t: (t != "") & (F.octet_length(t) <= 40))
    parts = F.flatten(F.transform(F.filter(runs, lambda t: t.rlike(r"[\-_./]")), lambda t: F.split(t, r"[\-_./]+")))
    return F.concat(whole, F.filter(parts, lambda t: (t != "") & (F.octet_length(t) <= 40)))


def saturated(tf: Column) -> Column:
    """Term weight of a count: tf * 2.2 / (tf + 1.2), whatever the text's length."""
    return tf * 2.2 / (tf + 1.2)


def term_number(term: Column) -> Column:
    """First four bytes of SHA-256 as an unsigned little-endian number."""
    h = F.sha2(term, 256)
    pairs = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return F.conv(pairs, 16, 10).cast("long")


def sparse_vector(text: Column) -> Column:
    """Array of (term, weight) of a text, terms as numbers and in their order. Equal terms are runs of the sorted list, so a long text is no square of work."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        firsts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (F.get(s, i - 1) != F.get(s, i - 2))))
        return let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(term_number(F.get(s, i - 1)).alias("term"), saturated(F.coalesce(F.get(f, k + 1), n + 1) - i).cast("double").alias("weight"))))

    return F.array_sort(let(F.array_sort(lexical_tokens(F.coalesce(text, F.lit("")))), runs))


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """MD5 of each run of ``size`` lower-cased words, all words if there are fewer; none without words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    run = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda k: F.md5(F.array_join(F.slice(w, k, size), " ")))
    return let(words, lambda w: F.when(F.size(w) > 0, run(w)).otherwise(F.array().cast("array<string>")))


def signature(text: Column, size: int = 5, k: int = 128) -> Column:
    """Bottom-k MinHash: the ``k`` smallest distinct shingle hashes, ascending."""
    return F.slice(F.array_sort(F.array_distinct(shingle_hashes(text, size))), 1, k)


def similarity(a: Column, b: Column, most: int = 128) -> Column:
    """Jaccard estimate over the bottom k of the union, k the smallest of ``most`` and both sizes; 0 if one is empty."""
    k = F.least(F.lit(most), F.size(a), F.size(b))
    low = F.slice(F.array_sort(F.array_union(a, b)), 1, F.greatest(k, F.lit(1)))
    shared = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(k > 0, shared / k).otherwise(F.lit(0.0))


def fact_tokens(text: Column) -> Column:
    """Distinct value-shaped words: digits with a separator, or digits with a unit; edges trimmed, a version's v dropped, lowered."""
    words = F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[vV]([0-9])", "$1")))
    shape = rf"^[0-9]+([-.:/_].*|({'|'.join(UNITS)}))$"
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: w.rlike(shape))))


def literals(text: Column) -> Column:
    """Back-ticked spans, paths and flags: what a rewrite must repeat as it stands."""
    spans = F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), 1)
    marks = F.regexp_extract_all(text, F.lit(r"(?:^|\s)(--?[A-Za-z][\w-]*|(?:/[\w.-]+){2,})"), 1)
    return F.array_distinct(F.concat(spans, marks))


def missing(wanted: Column, haystack: Column) -> Column:
    """Those of ``wanted`` that the haystack lacks, white space aside."""
    return let(F.regexp_replace(haystack, r"\s+", " "), lambda flat: F.filter(wanted, lambda x: ~F.contains(flat, F.trim(F.regexp_replace(F.regexp_replace(x, r"^\w+: ", ""), r"\s+", " ")))))


def distinctive_tokens(text: Column) -> Column:
    """Distinct lower-cased tokens of more than three bytes."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}\-_./=]+)"), 1)
    return F.array_distinct(F.filter(F.transform(runs, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), lambda t: F.octet_length(t) > 3))


def normal_query(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def contains_normal(long: Column, short: Column) -> Column:
    """Whether the short text is in the long one, case and white space aside; blank texts are in nothing."""
    return (normal_query(short) != "") & F.contains(normal_query(long), normal_query(short))


def decayed(value: Column, since: Column, at: Column | int, half_life_days: float) -> Column:
    """Exponential decay of a value by half-lives passed; times to come count as now, no half-life as no decay."""
    if half_life_days <= 0:
        return value.cast("double")
    at = F.lit(at) if isinstance(at, int) else at
    return value * F.pow(F.lit(2.0), -F.greatest(at - since, F.lit(0)) / (half_life_days * 86400.0))


def category(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*CATEGORIES), low).otherwise(F.lit("other"))


def clean_tags(tags: Column, most: int = 32, chars: int = 64) -> Column:
    """Trimmed, filled, distinct tags of ``chars`` characters or fewer, the first ``most`` of them."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: (t != "") & (F.char_length(t) <= chars))), 1, most)


def snippet(text: Column, most: int = 160) -> Column:
    """Plain text of up to ``most`` characters, cut at a word."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[#*_`>|]+", ""), r"\s+", " "))
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.regexp_extract(F.substring(flat, 1, most + 1), r"^(.*)\s", 1), F.lit("…")))


#: Fixed value: how an answer opens that declines.
ABSTAINS = "not in the knowledge base"


def abstained(answer: Column) -> Column:
    """Whether an answer opens with the declining phrase, behind markup, list marks or quotes.

    A phrase quoted and followed by more text is a mention, not a refusal.
    """
    quotes, marks = "\"'„“”‘’«»", r"\s*_#>`\-+•·"
    lead = rf"^[{marks}{quotes}]*(?:[0-9]+[.)][{marks}{quotes}]*)?"
    opening = F.regexp_replace(answer, lead, "")
    before = F.left(answer, F.char_length(answer) - F.char_length(opening))
    rest = F.substr(opening, F.lit(len(ABSTAINS) + 1))
    mention = before.rlike(f"[{quotes}]") & rest.rlike(rf"^[{quotes}]\s*\S")
    return F.lower(opening).startswith(ABSTAINS) & ~mention


def citations(answer: Column, sources: Column) -> Column:
    """Distinct numbers of [n] marks between 1 and the number of sources, ascending."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("long"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= sources))))


def stable_id(*parts: Column) -> Column:
    """SHA-256 of the parts in order."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def set_id(ids: Column) -> Column:
    """SHA-256 of a set of ids, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(ids.cast("array<string>")), ","), 256)


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2), F.least(F.greatest(attempt, F.lit(1)), F.lit(16))), F.lit(21600)).cast("long")


def rendered(template: str, **fields: Column) -> Column:
    """A template with {name} places; what is put in is not looked at again."""
    parts = [fields[p[1:-1]] if p[1:-1] in fields and p[:1] == "{" else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def device_key(*parts: Column) -> Column:
    """MD5 of the device's properties; null if none is known."""
    return F.when(F.coalesce(*parts).isNotNull(), F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])))


def plain_html(html: Column) -> Column:
    """Text of a page by regular expressions: scripts, styles and tags go, white space collapses."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    return F.btrim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " "))
