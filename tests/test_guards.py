"""What is read out of replies, and how texts are held against their sources."""

import pytest

from loamwork.functions import replies
from loamwork.operators import guards
from loamwork.sources.capture import markdown_of, page_markdown

WINDOW = "# Title\n\nThe quick brown\nfox jumps over\n\nthe lazy dog today\nand  Runs `make all`\n"


@pytest.mark.parametrize(
    "text, want",
    [
        ("the quick brown fox jumps", (10, 11)), ("FOX JUMPS OVER the lazy", (11, 13)), ("short", None), ("not in there at all", None), ("and runs `make all`\nthe quick brown", (10, 14)), ("the quick brownx", None), ("he quick brown fox jum", (10, 11)), ("runs `make", (14, 14)), ("", None), (None, None),
    ],
)
def test_spans_are_found_across_line_breaks(text, want):
    assert replies.located_span(text, WINDOW, 8) == want


def test_literals_without_support():
    excerpts = ["run `make all` with --force", "see /etc/hosts.conf"]
    answer = "Use `make all` and --force, or --dry-run on /etc/hosts.conf.\n    - a nested bullet of prose\n    1. another one\n    code = 1\n"
    assert replies.unsupported_literals(answer, excerpts) == ["--dry-run", "code = 1"]
    assert replies.unsupported_literals(answer, []) == [] == replies.unsupported_literals(None, excerpts)


def test_replies():
    assert replies.plan_of('Well: {"need": [" a ", "A", "", 3, "b", "c", "d"]} ok') == ["a", "b", "c"]
    assert replies.plan_of('{"need": "one"}') == ["one"] and [replies.plan_of(x) for x in (None, "", "no", "{}", '{"need": {}}', "[1]")] == [[]] * 6
    assert replies.gap_label_of('```json\n{"label": " \\"Disks.\\" "}\n```') == "Disks" and replies.gap_label_of('{"label": "."}') is None
    assert replies.verdict_of('{"verdict": {"relation": "x"}}') == {"relation": "x"} == replies.verdict_of('so {"relation": "x"}') and replies.verdict_of("x") is None
    whole = '{"artifacts": [{"text": " one ", "title": "", "corpus_lines": [1, 2], "caveats": ["a", " ", "b", "c", "d"]}, {"text": " "}, {"text": "two {x} \\"q\\"", "category": "Concept"}, {"text": "thr'
    first = {"text": "one", "title": None, "category": None, "lines": [1, 2], "caveats": ["a", "b", "c"]}
    got = replies.artifacts_of(whole)
    assert got[0] == first and [x["text"] for x in got] == ["one", 'two {x} "q"']
    assert [x["text"] for x in replies.artifacts_of(whole + 'ee"}]}')] == ["one", 'two {x} "q"', "three"]
    assert replies.artifacts_of('{"artifacts": [{"text": "a" "b"}, {"text": "ok"}]}')[-1]["text"] == "ok"
    assert [replies.artifacts_of(x) for x in (None, "", "{}", '{"artifacts": 3}')] == [[]] * 4


def test_exports(spark):
    text = "\uf0b7 one\n\n• two\n\n\nprose\n•\n\nthree\n•\n## Head\n  ▪ in\nword\n"
    more = [text, "", None, "•", "a\r\n\r\n\r\nb", "•\n\n\nfar", "▪ x\n\n\n▪ y\n\n• z", "•\n- own\n\uf0b7\n\n\uf0b7\nlast", "·word stays\n\n·\n > quote\n\n\U000f0001\tq  "]
    want = ["- one\n- two\n\nprose\n\n- three\n## Head\n  - in\nword\n", "\n", "\n", "\n", "a\n\nb\n", "far\n", "- x\n\n- y\n- z\n", "- own\n- last\n", "·word stays\n > quote\n\n- q\n"]
    docs = spark.createDataFrame([*enumerate(more)], "id int, text string")
    assert [r.text for r in sorted(guards.normal_exports(docs).collect())] == want
    long = "\n" * 30_000 + "•\n" * 30_000 + "x"
    assert guards.normal_exports(spark.createDataFrame([(1, long)], "id int, text string")).first().text == "- x\n"
    text = "Top\n===\nx\n\n---\n```\nA\n---\n~~~\n```\nSub\n--\n- a\n-\n"
    assert replies.marked_headings(text) == "# Top\nx\n\n---\n```\nA\n---\n~~~\n```\n## Sub\n- a\n-"


def test_markdown():
    page = "<head><title>no</title></head><body><h2>A <em>b</em></h2><p>x&amp;y<br>z</p><script>no</script><ul><li>one <a href='/u'>two</a></li><li><p>three</p></li></ul><pre>a\n  b</pre><table><tr><td>1</td><td>2</td></tr></table>"
    assert markdown_of(page) == "## A *b*\n\nx&y\nz\n\n- one [two](/u)\n- three\n\n```\na\n  b\n```\n\n1 2"
    assert [markdown_of(x) for x in (None, "", "<p>", "</ul></pre></h1>")] == [""] * 4


def test_column_forms(spark):
    df = spark.createDataFrame([(1, '{"need": ["a"]}'), (2, None), (2, None)], "id long, reply string")
    assert sorted((r.id, tuple(r.plan)) for r in guards.plans(df).collect()) == [(1, ("a",)), (2, ()), (2, ())]
    assert guards.proposals(df).collect() == [] and guards.plans(df.where("false")).collect() == []
    assert {(r.id, r.relation, r.label) for r in guards.verdicts(df).collect()} == {(1, None, None), (2, None, None)}
    arts = spark.createDataFrame([(1, "the quick brown fox jumps", WINDOW, 8), (2, "nowhere in there", WINDOW, 8), (3, None, None, 1)], "id long, text string, window string, first_line long")
    assert [tuple(r) for r in guards.located(arts).collect()] == [(1, 10, 11)]
    assert {r.id: r.paraphrased for r in guards.paraphrased(arts).collect()} == {1: False, 2: True, 3: False}
    answers = spark.createDataFrame([(1, "use --x-y", ["none"]), (2, "use --x-y", []), (3, None, None)], "id long, answer string, excerpts array<string>")
    assert [tuple(r) for r in guards.unsupported(answers).collect()] == [(1, "--x-y")]
    pages = spark.createDataFrame([(1, "http://a/b", "<h1>T</h1>" + "<p>text</p>" * 60), (2, "ftp://a", "<p>x</p>" * 99), (3, "https://a", "<p>x</p>"), (4, None, None)], "page_id long, url string, html string")
    (row,) = page_markdown(pages).collect()
    assert row.page_id == 1 and row.text.startswith("# T\n\ntext")
