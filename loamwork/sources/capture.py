"""Reading and writing the tables of a base."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.functions.replies import marked_headings
from loamwork.functions.text import plain_html
from loamwork.operators.guards import rows_of

ARTIFACTS = "id string, source string, text string, title string, category string, tags array<string>"
PAIRS = "query string, expect string, note string"
QUESTIONS = "id string, question string, verdict string, expect array<string>, note string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def captured_pages(pages: DataFrame, least: int = 200) -> DataFrame:
    """(page_id, url, text, n_chars) of web pages over http or https with ``least`` characters of text or more."""
    fetched = pages.where(F.lower("url").rlike("^https?://[^/]"))
    out = fetched.select("page_id", "url", plain_html(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.where(F.col("n_chars") >= least)


class _Markdown(HTMLParser):
    """A page's text with markdown marks: headings, lists, quotes, code, emphasis and links."""

    SKIPPED = frozenset("script style noscript template svg head".split())
    BLOCKS = frozenset("p div section article main header footer aside nav ul ol table tr blockquote form figure body".split())
    AROUND = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}  # noqa: RUF012

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.skipped = self.fenced = self.quoted = 0
        self.lists: list[int] = []
        self.targets: list[str | None] = []
        self.lead = ""

    def cut(self, gap: bool = True) -> None:
        text = "".join(self.line).strip("\n") if self.fenced else " ".join("".join(self.line).split())
        if text:
            lead = "> " * self.quoted + self.lead
            self.out.append(text if self.fenced else lead + text)
            self.lead = ""
        self.line = []
        if gap and self.out and self.out[-1]:
            self.out.append("")

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skipped += 1
        elif tag[0] == "h" and tag[1:].isdigit():
            self.cut()
            self.lead = "#" * min(6, max(1, int(tag[1:]))) + " "
        elif tag == "li":
            self.cut(gap=False)
            depth = max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1] >= 0:
                self.lists[-1] += 1
            self.lead = "  " * depth + (f"{self.lists[-1]}. " if self.lists and self.lists[-1] > 0 else "- ")
        elif tag == "pre":
            self.cut()
            self.out.append("```")
            self.fenced += 1
        elif tag == "br":
            self.cut(gap=False)
        elif tag in self.BLOCKS:
            self.cut(gap=not self.lists)
            self.quoted += tag == "blockquote"
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else -1)
        elif tag == "a":
            self.targets.append(dict(attrs).get("href"))
            if self.targets[-1]:
                self.line.append("[")
        elif tag in ("td", "th"):
            self.line.append(" ")
        elif not self.fenced:
            self.line.append(self.AROUND.get(tag, ""))

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "pre" and self.fenced:
            self.cut(gap=False)
            self.fenced -= 1
            self.out += ["```", ""]
        elif tag in self.BLOCKS or tag == "li" or (tag[0] == "h" and tag[1:].isdigit()):
            self.cut(gap=tag != "li" and len(self.lists) <= (tag in ("ul", "ol")))
            self.quoted = max(0, self.quoted - (tag == "blockquote"))
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag == "a" and self.targets:
            target = self.targets.pop()
            if target:
                self.line.append(f"]({target})")
        elif not self.fenced:
            self.line.append(self.AROUND.get(tag, ""))

    def handle_data(self, data):
        if not self.skipped:
            self.line.append(data)


def markdown_of(page: str | None) -> str:
    read = _Markdown()
    read.feed(page or "")
    read.close()
    read.cut()
    return marked_headings("\n".join(read.out).strip())


def page_markdown(pages: DataFrame, least: int = 200) -> DataFrame:
    """(page_id, url, text) of web pages over http or https as markdown; pages of less than ``least`` characters of it are left out."""
    fetched = pages.where(F.lower("url").rlike("^https?://[^/]"))
    made = rows_of(fetched, ["page_id", "url"], ["html"], T.StructType().add("text", "string"), lambda h: [(markdown_of(h),)])
    return made.where(F.char_length("text") >= least)


def text_files(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """(id, path, text) of whole files."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return files.select(F.sha2(F.input_file_name(), 256).alias("id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def export_evaluation(art: DataFrame, pairs: DataFrame, questions: DataFrame, folder: str) -> None:
    """Active artifacts, and the judged pairs and questions whose expected artifacts still live, as JSON lines."""
    live = art.where(F.coalesce("status", F.lit("active")) == "active")
    ids = live.select(F.col("id").alias("expect"))
    live.drop("status").write.mode("overwrite").json(f"{folder}/artifacts.json")
    pairs.join(ids, "expect", "left_semi").write.mode("overwrite").json(f"{folder}/pairs.json")
    alive = questions.select("id", F.explode("expect").alias("expect")).join(ids, "expect", "left_semi").select("id").distinct()
    unasked = questions.where(F.size("expect") == 0)
    questions.join(alive, "id", "left_semi").unionByName(unasked).write.mode("overwrite").json(f"{folder}/questions.json")


def load_evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.schema(s).json(f"{folder}/{n}.json") for n, s in (("artifacts", ARTIFACTS), ("pairs", PAIRS), ("questions", QUESTIONS)))
