"""Exact merge-type piece encoding by backtracking, and decoding.

A text is cut where no merge can reach across: before a space mark that follows
another character (checked against the vocabulary), and at characters that the
vocabulary lacks, which become byte pieces. Each part is encoded left to right with the longest
piece that an Aho-Corasick automaton finds. A piece may follow another only
if merging the two texts anew gives just the pair; else the next shorter piece
is tried. Positions from which no piece fits are marked in a bit field, so none is tried twice.

That is exact: greedy merging by rank, leftmost first, crosses a border in the
whole text only if it crosses it in the two pieces alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loamwork.llm.common import tidied

MARK = "▁"
#: Parts whose encoding a worker remembers, and how long such a part may be.
CACHE, CACHE_CHARS = 200_000, 48
_loaded: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder of a merge-type model file with byte fallback and an identity normaliser."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.unknown = lib.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.bytes = {b: i for i, b in self.byte_of.items()}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        rest = self.silent | set(self.byte_of) | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in rest}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        # a piece that merging never forms can't be part of an encoding
        whole = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        self.machine = ahocorasick.Automaton()
        for p in whole:
            self.machine.add_word(p, (self.ids[p], len(p)))
        self.machine.make_automaton()
        known = set(whole)
        self.length = [len(p) for p in self.pieces]
        self.shorter = {
            self.ids[p]: next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in whole
        }
        lone = "".join(p for p in whole if len(p) == 1 and p != MARK)
        within = f"[{re.escape(lone)}]" if lone else "(?!)"
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.parts = re.compile(f"[{MARK}{re.escape(lone)}]+|." if crossing else f"{MARK}+{within}*|{within}+|.", re.S)
        self.cache: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Merging as defined: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, one: int, two: int) -> bool:
        found = self.pairs.get((one, two))
        if found is None:
            if len(self.pairs) >= 4 * CACHE:
                self.pairs.clear()
            a, b = self.pieces[one], self.pieces[two]
            found = self.pairs[one, two] = self.merged(a + b) == [a, b]
        return found

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part; a single character that the vocabulary lacks gives its bytes."""
        n, length, shorter, pairs = len(part), self.length, self.shorter, self.pairs
        longest: list[int | None] = [None] * n
        for end, (piece, size) in self.machine.iter(part):
            longest[end - size + 1] = piece
        piece = longest[0]
        if piece is None:
            return [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]
        # the field of failed positions, made when the first one fails
        dead: bytearray | None = None
        out: list[int] = []
        at = end = 0
        while at < n:
            while piece is not None:
                end = at + length[piece]
                if dead is None or not dead[end >> 3] >> (end & 7) & 1:
                    if not out:
                        break
                    fits = pairs.get((out[-1], piece))
                    if fits or (fits is None and self.compatible(out[-1], piece)):
                        break
                piece = shorter[piece]
            if piece is not None:
                out.append(piece)
                at = end
                piece = longest[at] if at < n else None
                continue
            dead = dead or bytearray(n // 8 + 1)
            dead[at >> 3] |= 1 << (at & 7)
            last = out.pop()
            at -= length[last]
            piece = shorter[last]
        return out

    def remembered(self, part: str) -> tuple[str, str]:
        """Comma-joined ids and decoded text of a part."""
        ids = self.encode_part(part)
        # a part is of pieces alone, or the bytes of one character
        decoded = self.decode_raw(ids) if ids[0] in self.byte_of else "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        found = (",".join(map(str, ids)), decoded)
        if len(part) <= CACHE_CHARS and len(self.cache) < CACHE:
            self.cache[part] = found
        return found

    def marked(self, text: str) -> list[str]:
        return self.parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.marked(text or "") for i in self.encode_part(part)]

    def decode_raw(self, ids: list[int]) -> str:
        """Text of ids, with the space that encoding puts in front."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def digest(self, text: str | None) -> tuple[str, str]:
        """Comma-joined ids and decoded text; parts met before come from the cache."""
        known, miss = self.cache, self.remembered
        found = [known.get(p) or miss(p) for p in self.marked(text or "")]
        decoded = "".join([d for _, d in found])
        return ",".join([i for i, _ in found]), decoded[1:] if decoded[:1] == " " else decoded


def codec(path: str) -> PieceCodec:
    """The codec of a model file; each Python worker loads it once."""
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def piece_round_trip(docs: DataFrame, model: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_text``, ``decoded_sha256`` and, on demand, ``ids`` added.

    ``model``: path of the model file, the same on every machine. Whole texts are
    encoded without begin or end ids; null counts as empty, which has no ids and decodes to the
    empty text. Rows are independent: repeated ones come out alike, empty tables empty.
    Columns of ``docs`` are carried; those named as the new ones are replaced.
    """
    text = T.StringType()
    new = [("n_tokens", T.LongType()), ("ids_sha256", text), ("decoded_text", text), ("decoded_sha256", text)]
    new += [("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    docs = docs.select(*[c for c in docs.columns if c not in dict(new)])
    at, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)])
    for k, (_, kind) in enumerate(new):
        schema = schema.add(f"c{width + k}", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(at):
                ids, decoded = tool.digest(text.as_py())
                rows.append((ids.count(",") + 1 if ids else 0, sha(ids), decoded, sha(decoded), ids if keep_ids else None))
            cols = [pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3)]
            if keep_ids:
                cols.append(pa.array([[int(x) for x in r[4].split(",")] if r[4] else [] for r in rows], pa.list_(pa.int32())))
            arrays = [batch.column(k) for k in range(width)] + cols
            yield pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])

    return docs.mapInArrow(tidied(run), schema).toDF(*docs.columns, *[name for name, _ in new])
