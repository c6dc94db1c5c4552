"""Structure-aware windows and passages of documents; state runs along a document's lines, so these are Arrow operators over whole rows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamwork.operators.dealing import sliced

_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S")


def lines_of(text: str) -> list[str]:
    """Lines as they end at a line feed alone, a carriage return before it going with it; nothing follows the last line feed."""
    found = text.split("\n")
    last = found.pop()
    return [x.removesuffix("\r") for x in found] + ([last] if last else [])


def tokens(text: str) -> int:
    return len(text) * 2 // 7


def is_heading(line: str) -> bool:
    return bool(_HEADING.match(line))


def heading_title(line: str) -> str:
    return line.strip().lstrip("#").strip()


def pieces(line: str, budget: int) -> list[str]:
    """A line cut so that each part fits; one that fits stays whole."""
    if tokens(line) <= budget:
        return [line]
    width = max(budget * 7 // 2, 64)
    return [line[k : k + width] for k in range(0, len(line), width)]


@dataclass
class Segment:
    """start and end: lines of the document, from 1. carried: lines in front that repeat an earlier heading."""

    text: str
    start: int
    end: int
    carried: int = 0


def _cuts(lines: list[str], budget: int) -> list[tuple[int, int, int]]:
    """Windows over lines as (from, to, heading): where each begins and ends, and the line whose heading it carries, -1 for none.

    A window takes lines while their tokens and line ends fit. The line that would run over ends it: a heading begins the
    next one; a blank line is the old one's last; before another line the window is cut at its last boundary, a
    heading or the place after a blank line, and what follows that begins the next window, which takes the line whatever
    it costs. Without a boundary a window that has used up the budget ends, and one that hasn't takes the line.
    """
    n = len(lines)
    spent = [0, *accumulate(tokens(x) + 1 for x in lines)]
    heads = [is_heading(x) for x in lines]
    blank = [not x.strip() for x in lines]
    # the last heading, and the last blank line, up to each line
    last_head = list(accumulate((k if h else -1 for k, h in enumerate(heads)), max))
    last_blank = list(accumulate((k if b else -1 for k, b in enumerate(blank)), max))
    out: list[tuple[int, int, int]] = []
    start, settled, carried = 0, 1, -1
    while start < n:
        over = max(settled, bisect_right(spent, spent[start] + budget) - 1)
        if over >= n:
            out.append((start, n, carried))
            break
        heading = last_head[over - 1]
        boundary = max(heading, last_blank[over - 2] if over > 1 else -1)
        if heads[over]:
            end, follows = over, over
        elif blank[over]:
            end, follows = over + 1, heading
        elif boundary > start:
            end = boundary if heads[boundary] else boundary + 1
            follows = last_head[end - 1] if last_head[end - 1] >= start else carried if carried >= 0 else heading
        elif spent[over] - spent[start] >= budget:
            end, follows = over, heading
        else:
            settled = over + 1
            continue
        out.append((start, end, carried))
        start, settled, carried = end, max(over, end) + 1, follows
    return out


def split_segments(text: str | None, budget: int = 4096) -> list[Segment]:
    """Windows of ``budget`` tokens, whole if the text fits; blank texts have none. A window that begins without a heading is led by the one it stands under."""
    if not text or not text.strip():
        return []
    whole = lines_of(text)
    if tokens(text) <= budget:
        return [Segment(text, 1, max(1, len(whole)))]
    parts = [(part, number) for number, line in enumerate(whole, 1) for part in pieces(line, budget)]
    out = []
    for a, b, heading in _cuts([part for part, _ in parts], budget):
        body = "\n".join(part for part, _ in parts[a:b])
        carried = heading >= 0 and not body.lstrip().startswith("#")
        out.append(Segment(f"{parts[heading][0]}\n{body}" if carried else body, parts[a][1], parts[b - 1][1], int(carried)))
    return out


@dataclass
class Passage:
    title: str | None
    text: str
    start: int
    end: int


def split_passages(window: Segment, budget: int = 384) -> list[Passage]:
    """A window's passages with the heading each stands under: carried, else its first own, else the last seen."""
    lines = lines_of(window.text)
    seen = heading_title(lines[0]) if window.carried and lines else None
    out = []
    for part in split_segments("\n".join(lines[window.carried :]), budget):
        own = lines_of(part.text)
        carried = heading_title(own[0]) if part.carried and own else None
        own = own[part.carried :]
        inside = [heading_title(x) for x in own if is_heading(x)]
        start = min(max(window.start + part.start - 1, window.start), window.end)
        end = min(max(window.start + part.end - 1, start), window.end)
        out.append(Passage(carried or (inside[0] if inside else None) or seen, "\n".join(own), start, end))
        seen = inside[-1] if inside else carried or seen
    return out


_TRIM = "(),.;:\"'*_"
_SPAN = re.compile(r"`([^`\n]+)`")


def literals(text: str | None, indented: bool = True) -> list[str]:
    """What must come from a source as it stands: fenced and indented lines, back-ticked spans, paths and flags. In order, each once."""
    found: dict[str, None] = {}
    fence = False
    for line in lines_of(text or ""):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif fence or (indented and re.match(r"(?: {4}|\t)\s*\S", line)):
            if line.strip():
                found[line.strip()] = None
        else:
            found |= dict.fromkeys(s.strip() for s in _SPAN.findall(line) if s.strip())
            for word in _SPAN.sub(" ", line).split():
                w = word.strip(_TRIM)
                shaped = w.startswith(("--", "/", "~/", "./")) or ("/" in w and re.search(r"[.\-_=$*]", w))
                if len(w) >= 3 and shaped:
                    found[w] = None
    return list(found)


def missing_literals(text: str | None, haystack: str | None) -> list[str]:
    """Those literals of a text that the haystack lacks; white space and a leading label are forgiven."""
    flat = " ".join((haystack or "").split())
    out = []
    for lit in literals(text):
        one = " ".join(lit.split())
        if one not in flat and re.sub(r"^[\w ]{1,30}: ", "", one) not in flat:
            out.append(lit)
    return out


def _mapped(docs: DataFrame, text_col: str, id_col: str, fields: T.StructType, rows) -> DataFrame:
    """Rows that ``rows(text)`` makes of each document, behind its id."""
    schema = T.StructType([docs.schema[id_col], *fields.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, made = [], []
            for k, text in enumerate(batch.column(1)):
                got = rows(text.as_py())
                ids += [k] * len(got)
                made += got
            arrays = [batch.column(0).take(pa.array(ids, pa.int64()))] + [pa.array([m[c] for m in made], f.type) for c, f in enumerate(shape)]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, *shape.names])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def segment_documents(docs: DataFrame, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, start_line, end_line, carry_lines, text) of each document's windows. Rows are independent."""
    fields = T.StructType().add("idx", "long").add("start_line", "long").add("end_line", "long").add("carry_lines", "long").add("text", "string")
    return _mapped(docs, text_col, id_col, fields, lambda t: [(k, s.start, s.end, s.carried, s.text) for k, s in enumerate(split_segments(t, budget))])


def passage_documents(docs: DataFrame, budget: int = 4096, chunk: int = 384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, idx, title, start_line, end_line, text) of each document's passages."""
    fields = T.StructType().add("segment", "long").add("idx", "long").add("title", "string").add("start_line", "long").add("end_line", "long").add("text", "string")

    def rows(text: str | None) -> list[tuple]:
        return [(k, i, p.title, p.start, p.end, p.text) for k, s in enumerate(split_segments(text, budget)) for i, p in enumerate(split_passages(s, chunk))]

    return _mapped(docs, text_col, id_col, fields, rows)


def document_literals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, literal) of each document."""
    return _mapped(docs, text_col, id_col, T.StructType().add("literal", "string"), lambda t: [(x,) for x in literals(t)])


def split_paragraphs(text: str | None, budget: int) -> list[str]:
    """Paragraphs packed greedily under a budget; a paragraph over it is packed by lines, a line over it is cut."""
    out: list[str] = []

    def pack(parts: list[str], glue: str, finer) -> None:
        held = ""
        for p in parts:
            joined = p if not held else held + glue + p
            if tokens(joined) <= budget:
                held = joined
                continue
            if held:
                out.append(held)
            held = ""
            if tokens(p) <= budget:
                held = p
            else:
                finer(p)
        if held:
            out.append(held)

    by_line = lambda p: pack(p.split("\n"), "\n", lambda x: out.extend(pieces(x, budget)))
    pack([p for p in re.split(r"\n\s*\n", text or "") if p.strip()], "\n\n", by_line)
    return out
