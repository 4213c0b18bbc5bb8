import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cytoplane.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split("."))
                or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 9 <= len(digits) <= 15
            )
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@1234567890 -+(é%_", max_size=60))
def test_plain_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text,found", [
    ("mail jane.doe [at] example [dot] com now", "email:5:36"),
    ("jane at example dot co dot uk", "email:0:29"),
    ("user(at)mail.example.org", "email:0:24"),
    ("foo＠bar.com", "email:0:11"),
    ("jоhn@example.com", "email:0:16,email:2:16"),
    ("１９２.168.0.1", "ip:0:11"),
    ("192 dot 168 dot 1 dot 1 x", "ip:0:23"),
    ("one nine two dot one six eight dot zero dot one", "ip:0:47"),
    ("call plus four four two zero seven nine four six zero nine five eight", "phone:5:69"),
    ("4111 1111 1111 111１ ok", "card:0:19"),
    ("he was at work dot it was fun", ""),
    ("sat at desk dot in pen", ""),
    ("look at the dot com crash", ""),
    ("meet me at the dot com bubble", ""),
    ("see section 4 dot 1 dot 2 dot 3", ""),
    ("jane@example dot com", "email:0:20"),
    ("mail jane at example dot it, please", "email:5:27"),
    ("jan\u200be@exam\u00adple.com", "email:0:18"),
    ("so \u200djane@example.com", "email:4:20"),
    ("\u200b jane \u2060 at", ""),
    ("look at the dot and see", ""),
    ("we met at noon dot", ""),
    ("one two three four steps", ""),
    ("é, ñ and ½ of 3 [at] home", ""),
])
def test_disguises(text, found):
    assert pii.listed(pii.find_spans(text)[1]) == found


@pytest.mark.parametrize("text,found", [
    ("jane [at] example dot com", "email:0:25"),
    ("mail jane at example [dot] com now", "email:5:30"),
    ("jane at example [dot] app", "email:0:25"),
    ("jane at mail dot example [dot] pl", "email:0:33"),
    ("jane [at] mail dot example dot dev", "email:0:34"),
    ("plus one 415 five five five 0123", "phone:0:32"),
    ("call +1 four one five 555 0123 now", "phone:5:30"),
    ("4111 one one one one 1111 1111", "card:0:30"),
    ("192 dot one six eight dot 1 dot 1", "ip:0:33"),
    ("jane at example dot app", "email:0:23"),
    ("jane at example dot pl", "email:0:22"),
    ("jane at example dot ai", "email:0:22"),
    ("+1 415 555 0123 one of us", "phone:0:15"),
    ("one of 20 and two of 30", ""),
    ("in 2019 one 415 and nine", ""),
])
def test_mixed_disguises(text, found):
    assert pii.listed(pii.find_spans(text)[1]) == found


def test_mixed_runs_take_linear_time():
    for text in ("one 1 " * 50_000, "a at b dot " * 30_000 + "[at]", "1 one. " * 50_000, "a [at] b dot " * 30_000):
        pii.find_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, " " * 300_000 + "[at]", "(at) " * 30_000, "+1(" * 50_000, "a@" * 50_000, "one " * 50_000):
        pii.find_spans(text)


def test_rows(make, odd):
    texts = [*odd, "a@b.co and +1 (555) 123-4567", "x [at] y.org"]
    rows = {r.doc_id: r for r in pii.find_pii(make(texts)).collect()}
    assert len(rows) == len(texts)
    assert (rows[10].n_email, rows[10].n_phone, rows[11].n_email, rows[0].n_card, rows[0].spans) == (1, 1, 1, 0, "")
    hidden = {r.doc_id: r for r in pii.redact(make(texts)).collect()}
    assert hidden[10].text == "<EMAIL> and <PHONE>" and hidden[10].n_chars == 19
    assert hidden[0].text is None and hidden[3].text == "a" and hidden[10].row == "clash"
    assert pii.find_pii(make([])).count() == 0 and pii.redact(make([])).count() == 0


def test_plain_and_disguised_together_take_linear_time():
    from time import perf_counter

    text = "jane@example.com and jane [at] example [dot] com; "
    start = perf_counter()
    pii.find_spans(text * 2_000)
    small = perf_counter() - start
    start = perf_counter()
    assert [len(x) for x in pii.find_spans(text * 20_000)] == [20_000, 40_000]
    assert perf_counter() - start < 25 * small + 1
