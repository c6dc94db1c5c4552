"""Checks of what models wrote, as one Arrow pass each over tables of replies, answers and drafts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamwork.functions import replies
from loamwork.operators.dealing import sliced


def rows_of(df: DataFrame, ids: list[str], inputs: list[str], fields: T.StructType, rows: Callable[..., list[tuple]]) -> DataFrame:
    """The rows that ``rows`` makes of each row's inputs, behind its ids. Rows are independent."""
    shape, n = to_arrow_schema(fields), len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            places, made = [], []
            for k, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]), strict=True)):
                got = rows(*values)
                places += [k] * len(got)
                made += got
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns[:n]] + [pa.array([m[c] for m in made], f.type) for c, f in enumerate(shape)], [*ids, *shape.names])

    return df.select(*ids, *inputs).mapInArrow(run, T.StructType([*(df.schema[c] for c in ids), *fields.fields]))


def located(artifacts: DataFrame) -> DataFrame:
    """(id, start_line, end_line) of artifacts (id, text, window, first_line) that have lines in their window."""
    fields = T.StructType().add("start_line", "long").add("end_line", "long")
    return rows_of(artifacts, ["id"], ["text", "window", "first_line"], fields, lambda t, w, n: [s] if (s := replies.located_span(t, w, n)) else [])


def traceable(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """The ids of pairs (text, window) of which a line of the text is in the window."""
    return rows_of(pairs, ids, ["text", "window"], T.StructType().add("__at", "long"), lambda t, w: [(s[0],)] if (s := replies.located_span(t, w)) else []).drop("__at")


def unsupported(answers: DataFrame) -> DataFrame:
    """(id, literal): what answers (id, answer, excerpts) state that no excerpt has."""
    return rows_of(answers, ["id"], ["answer", "excerpts"], T.StructType().add("literal", "string"), lambda a, e: [(x,) for x in replies.unsupported_literals(a, e or [])])


def plans(answers: DataFrame) -> DataFrame:
    """(id, plan): the queries that replies (id, reply) ask for."""
    return rows_of(answers, ["id"], ["reply"], T.StructType().add("plan", T.ArrayType(T.StringType())), lambda r: [(replies.plan_of(r),)])


def proposals(answers: DataFrame) -> DataFrame:
    """(id, place, text, title, category, lines, caveats): the artifacts that replies (id, reply) propose."""
    fields = T.StructType().add("place", "long").add("text", "string").add("title", "string").add("category", "string").add("lines", T.ArrayType(T.LongType())).add("caveats", T.ArrayType(T.StringType()))
    return rows_of(answers, ["id"], ["reply"], fields, lambda r: [(k, *x.values()) for k, x in enumerate(replies.artifacts_of(r))])


def verdicts(answers: DataFrame) -> DataFrame:
    """(id, relation, label): a judge's relation and a gap's label of replies (id, reply); null where a reply has none."""

    def read(reply):
        verdict = replies.verdict_of(reply) or {}
        relation = verdict.get("relation")
        return [(relation if isinstance(relation, str) else None, replies.gap_label_of(reply))]

    return rows_of(answers, ["id"], ["reply"], T.StructType().add("relation", "string").add("label", "string"), read)


def paraphrased(artifacts: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``paraphrased``: whether under ``least`` of the distinctive tokens of the text are in its window. artifacts: (id, text, window)."""
    from loamwork.functions.text import distinctive_tokens

    own = distinctive_tokens(F.coalesce("text", F.lit("")))
    share = F.size(F.array_intersect(own, distinctive_tokens(F.coalesce("window", F.lit(""))))) / F.size(own)
    return artifacts.withColumn("paraphrased", F.when(F.size(own) > 0, share < least).otherwise(False))


#: Signs that lead an item in an export, besides those of private areas, as bullets of symbol fonts come out.
BULLETS = "•‣⁃∙·▪▫■○●◦"
_BULLET = rf"(?U)^\s*[{BULLETS}\p{{Co}}]"
_MARKED = r"^(#|\||```|~~~|> |[-*+] |[0-9]+\. )"


def normal_exports(docs: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, text) of exported documents with their list items as such.

    A bullet in front of a text makes an item; one on a line of its own goes to the next text, across one blank line at most, unless that
    begins with a mark of markdown. Between two texts one blank line stays of any number since the last bullet, and none between two items that no two blank lines part.

    In columns alone: lines are text (t), a lone bullet (m) or blank (b), and what lies between two texts is a run of m and b.
    """
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    kind = lambda x: F.when(x == "", "b").when(x.rlike(_BULLET + "$"), "m").otherwise("t")
    of = docs.select(F.col(id_col), lines.alias("lines")).withColumn("kinds", F.array_join(F.transform("lines", kind), ""))
    said = lambda x: F.regexp_replace(x, rf"(?U)^\s*([{BULLETS}\p{{Co}}]\s+)?", "")
    item = lambda x, gap: x.rlike(_BULLET + r"\s") | (gap.rlike("mb?t$") & ~said(x).rlike(_MARKED))
    of = of.select(id_col, F.filter("lines", lambda x: kind(x) == "t").alias("t"), F.regexp_extract_all("kinds", F.lit("([bm]*t)"), 1).alias("gaps"))
    of = of.withColumn("items", F.zip_with("t", "gaps", item))

    def put(x, k):
        gap, mine = F.get("gaps", k), F.get("items", k)
        joined = mine & F.get("items", k - 1) & ~gap.contains("bb")
        blank = (k > 0) & gap.endswith("bt") & ~joined
        return F.concat(F.when(blank, "\n").otherwise(""), F.regexp_extract(x, r"(?U)^(\s*)", 1), F.when(mine, "- ").otherwise(""), said(x), F.lit("\n"))

    whole = F.array_join(F.transform("t", put), "")
    return of.select(id_col, F.when(F.size("t") == 0, "\n").otherwise(whole).alias("text"))


def headed(docs: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """(id, text) with underlined headings marked in front."""
    return rows_of(docs, [id_col], [text], T.StructType().add("text", "string"), lambda t: [(replies.marked_headings(t or ""),)])
