import hashlib
import random
import re
import time

import pytest

from loamwork.llm.pii import detect_pii, emails, find_pii, written


def plain(text):
    """The four patterns, as written."""
    n = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(n(m[0])) <= 19 and luhn(n(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(n(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def test_plain_spans_match_the_patterns():
    rng = random.Random(8)
    pool = ["a", "b.c", "@", "@@", "x@y.z", ".", "-", "+", "+44", " ", "12", "255", "1.2.3.4", "4845168114407329", "4111 1111 1111 1111", "(20)", "é", "\n", "300", "0001"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))
        base, every = find_pii(text)
        assert base == plain(text), text
        assert set(base) <= set(every)
    assert emails("a@b@c.d.e@f.g") == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "a@b@c.d.e@f.g")]


DISGUISED = [
    ("email", "jane.doe [at] example [dot] com"),
    ("email", "jane (at) mail.example.org"),
    ("email", "jane dot doe at example dot co dot uk"),
    ("email", "jane_doe AT example DOT com"),
    ("email", "jane{at}example{dot}net"),
    ("email", "jane-at-example-dot-net"),
    ("email", "mary-ann [at] example [dot] com"),
    ("email", "mary-ann@example[dot]com"),
    ("email", "mary-ann-at-example-dot-net"),
    ("email", "a dot b dot c dot d dot e dot f dot g at example dot com"),
    ("email", "jane [at] a [dot] b [dot] c [dot] d [dot] e [dot] f [dot] g [dot] com"),
    ("email", "jane @ example . com".replace(" . ", ".")),
    ("email", "jаne@exаmple.com"),
    ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("email", "ja​ne@exam​ple.com"),
    ("phone", "plus four four two zero seven nine four six zero nine five eight"),
    ("phone", "+four four two zero seven nine four six zero nine five eight"),
    ("phone", "＋４４ ２０ ７９４６ ０９５８"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "４１１１ １１１１ １１１１ １１１１"),
    ("ip", "192 dot 168 dot 10 dot 7"),
    ("ip", "192[.]168[.]10[.]7"),
    ("ip", "１９２.１６８.１０.７"),
]


@pytest.mark.parametrize("kind, text", DISGUISED)
def test_disguises_map_back(kind, text):
    for before, after in (("", ""), ("Wörter davor, ", " und danach."), ("é\n", "\nfin")):
        base, every = find_pii(before + text + after)
        spans = [s for s in every if s not in base]
        assert (kind, len(before), len(before) + len(text)) in spans, (every, base)


CLEAN = [
    "We met at noon. The dot on the map is at the centre.",
    "Look at example text. It is not an address at all.",
    "one two three ducks, uno dos tres amigos, un deux trois soleil",
    "The un of the six. Des un de la seis.",
    "version 1.2.3, at 10.30, page (at) the end",
    "un un un un un un un un un un un un",
]


@pytest.mark.parametrize("text", CLEAN)
def test_prose_is_left_alone(text):
    assert find_pii(text) == ([], [])


def test_column_form(spark):
    texts = [None, "", "x@y.zz and a [at] b [dot] cc", "x@y.zz", "x@y.zz", "w " * 60_000 + "1.2.3.4"]
    docs = spark.createDataFrame([(k, t, "s", 9) for k, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip int")
    for r in detect_pii(docs).collect():
        text = texts[r.doc_id] or ""
        base, every = find_pii(text)
        assert r.spans == written(every) and r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert [f.text for f in r.found] == [text[a:b] for _, a, b in every]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
    assert detect_pii(docs.where("false")).collect() == []


@pytest.mark.parametrize("mark", "-*_/|~")
@pytest.mark.parametrize("at", ["at", "AT", "arroba", "arobase", "ät", "chez"])
def test_the_gate_opens_for_signed_forms(mark, at):
    text = f"jane{mark}{at}{mark}example.com"
    alone, beside = find_pii(text)[1], find_pii(text + ", a dot")[1]
    assert alone == beside and any(s[0] == "email" for s in alone)


@pytest.mark.parametrize("unit", ["1", "1.", "1 ", "a dot ", "mary dot ", "one ", "a@", "+1", "a at ", "a-at-", "a" + " " * 5000, "one" + " " * 5000, "а", "%@%.", "x@y."])
def test_long_odd_texts_take_little_time(unit):
    began = time.time()
    find_pii(unit * (300_000 // len(unit)))
    assert time.time() - began < 5


def test_addresses_match_within_long_digit_runs():
    text = "9" * 1000 + ".1.2.3 and 1.2.3.4.5.6.7.8 x1.2.3.4y 256.1.1.1 0001.2.3.4"
    want = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [(a, b) for k, a, b in find_pii(text)[0] if k == "ip"] == want


def test_numbers_in_prose_are_no_labels():
    for text in ("meet at two three four five dot com", "we meet at one two three four dot org soon", "Treffen at eins zwei drei vier punkt de"):
        assert find_pii(text)[1] == []
    assert [text[a:b] for text in ("write to jo at 163 dot com", "jo [at] one two three four dot com", "jo at mail one dot com") for _, a, b in find_pii(text)[1]][:2] == ["jo at 163 dot com", "jo [at] one two three four dot com"]
