"""Reading what a model replied, and checking it against its sources. Plain functions of texts; ``operators.guards`` applies them to tables."""

from __future__ import annotations

import json
import re

from loamwork.operators.segments import lines_of, missing_literals

#: Most queries of a plan, most caveats of an artifact.
PLAN, CAVEATS = 3, 3
_LABEL_EDGES = "\"'."
_ITEM = re.compile(r"\s*(?:[-*+] |[0-9]+\. )")


def json_part(reply: str) -> str:
    """From the first opening to the last closing brace; the whole reply if there is no such part."""
    a, b = reply.find("{"), reply.rfind("}")
    return reply[a : b + 1] if 0 <= a < b else reply


def _read(reply: str | None):
    try:
        return json.loads(json_part(reply or ""))
    except ValueError:
        return None


def plan_of(reply: str | None) -> list[str]:
    """Up to three further queries, none blank, none twice whatever its case; an unreadable reply asks for none."""
    found = _read(reply)
    need = found.get("need") if isinstance(found, dict) else None
    asked = [need] if isinstance(need, str) else [q for q in need if isinstance(q, str)] if isinstance(need, list) else []
    kept: dict[str, str] = {}
    for q in filter(None, (q.strip() for q in asked)):
        kept.setdefault(q.lower(), q)
    return list(kept.values())[:PLAN]


def gap_label_of(reply: str | None) -> str | None:
    """The label without quotes and full stops at its ends; null if there is none."""
    found = _read(reply)
    label = found.get("label") if isinstance(found, dict) else None
    return (label.strip().strip(_LABEL_EDGES).strip() if isinstance(label, str) else "") or None


def verdict_of(reply: str | None) -> dict | None:
    """The verdict's object, in its envelope or alone; null for what can't be read, which is no verdict."""
    found = _read(reply)
    if not isinstance(found, dict):
        return None
    return found["verdict"] if isinstance(found.get("verdict"), dict) else found


def whole_objects(text: str, at: int) -> list[dict]:
    """The objects of a list that begins at ``at``, as far as they can be read one by one."""
    read, out = json.JSONDecoder(), []
    while (at := re.compile(r"[\s,]*").match(text, at).end()) < len(text) and text[at] != "]":
        try:
            found, at = read.raw_decode(text, at)
            out += [found] if isinstance(found, dict) else []
        except ValueError:
            # on to where the next object may begin
            nxt = text.find("{", at + 1)
            if nxt < 0:
                break
            at = nxt
    return out


def artifacts_of(reply: str | None) -> list[dict]:
    """Proposed artifacts with a text: text, title, category, lines, caveats. Of a list cut off or spoilt, the objects that stand by themselves."""
    found = _read(reply)
    raw = found.get("artifacts") if isinstance(found, dict) else None
    if not isinstance(raw, list):
        m = re.search(r'"artifacts"\s*:\s*\[', reply or "")
        raw = whole_objects(reply, m.end()) if m else []
    out = []
    for x in raw:
        text = x.get("text") if isinstance(x, dict) else None
        if not isinstance(text, str) or not text.strip():
            continue
        said = lambda k, x=x: x[k].strip() if isinstance(x.get(k), str) and x[k].strip() else None
        lines = x.get("corpus_lines")
        span = lines if isinstance(lines, list) and len(lines) == 2 and all(isinstance(n, int) for n in lines) else None
        caveats = [c.strip() for c in x.get("caveats") or [] if isinstance(c, str) and c.strip()][:CAVEATS]
        out.append({"text": text.strip(), "title": said("title"), "category": said("category"), "lines": span, "caveats": caveats})
    return out


def unsupported_literals(answer: str | None, excerpts: list[str]) -> list[str]:
    """Literals of an answer that none of its excerpts has; bullets of prose are none. Without excerpts nothing is checked."""
    if not excerpts:
        return []
    return [x for x in missing_literals(answer, "\n\n".join(excerpts)) if not _ITEM.match(x)]


def _words(text: str | None, first_line: int = 1) -> tuple[list[str], list[int]]:
    """Lower-cased words of a text, and the line that each stands in."""
    found = [(w, first_line + n) for n, line in enumerate(lines_of(text or "")) for w in line.lower().split()]
    return [w for w, _ in found], [n for _, n in found]


def _place(asked: list[str], words: list[str]) -> int | None:
    """The first word at which the asked words stand in a row; the first may end a longer word, and the last begin one."""
    if len(asked) == 1:
        return next((k for k, w in enumerate(words) if asked[0] in w), None)
    ends = range(len(words) - len(asked) + 1)
    return next((k for k in ends if words[k].endswith(asked[0]) and words[k + len(asked) - 1].startswith(asked[-1]) and words[k + 1 : k + len(asked) - 1] == asked[1:-1]), None)


def located_span(text: str | None, window: str | None, first_line: int = 1) -> tuple[int, int] | None:
    """First and last line of a window in which lines of a text stand, wherever the window breaks its own; null if none does. Lines of eight bytes or fewer aren't looked for."""
    words, owner = _words(window, first_line)
    spans = []
    for line in lines_of(text or ""):
        asked = line.lower().split()
        if len(" ".join(asked).encode()) > 8 and (k := _place(asked, words)) is not None:
            spans.append((owner[k], owner[k + len(asked) - 1]))
    return (min(a for a, _ in spans), max(b for _, b in spans)) if spans else None


_FENCE = re.compile(r" {0,3}(```|~~~)")


def marked_headings(text: str) -> str:
    """Underlined headings become headings with marks in front; what is fenced stays as it is."""
    lines, out, fence, skip = lines_of(text), [], None, False
    for k, line in enumerate(lines):
        if skip:
            skip = False
            continue
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1] == fence and set(line.strip()) == {fence[0]}:
                fence = None
        elif mark:
            fence = mark[1]
        else:
            under = lines[k + 1].rstrip() if k + 1 < len(lines) else ""
            if line.strip() and len(under) > 1 and set(under) in ({"="}, {"-"}):
                out.append(("# " if under[0] == "=" else "## ") + line.strip())
                skip = True
                continue
        out.append(line)
    return "\n".join(out)
