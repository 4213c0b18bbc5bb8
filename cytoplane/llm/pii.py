"""Personal data in plain and disguised form, with offsets in the source.

Plain identifiers are found in the text itself. Disguised ones are found in a normalised copy: small transducers rewrite
look-alike letters and digits, spelled digits, and "at" / "dot" in brackets or words, and note for every character they
write which source characters it stands for. Spans found there are mapped back; those that touch no rewritten character
are plain ones and were found already.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

_DOMAIN = regex.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits cannot be entered in its middle, so the look-behind changes no match and keeps long runs linear.
_IP = regex.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = regex.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = regex.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        else:
            free = max(free, at + 1)  # no later match can begin before this sign
        at = text.find("@", max(free, at + 1))


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Plain identifiers, by start and then kind."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


# Look-alikes of Latin letters in Cyrillic and Greek, in natural order.
_LOOKALIKES = dict(zip(
    "АВЕКМНОРСТХаеорсухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧορν",
    "ABEKMHOPCTXaeopcyxijsdABEZHIKMNOPTYXopv",
))
_DIGIT_WORDS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SIGN_WORDS = {"plus": "+"}
# Top-level domains that may end an address in words ("at the dot" is ordinary prose).
_TOP_LEVEL = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|app|dev|xyz|online|site|tech|store|shop|blog|cloud|eu|"
    "a[cdefgilmoqrtuwxz]|b[abdefghijmnorstvwyz]|c[acdfghiklmnoruvwxyz]|d[ejkmoz]|e[cegrst]|f[ijkmor]|g[abdefghilmnpqrstuwy]|"
    "h[kmnrtu]|i[delmnoqrst]|j[emop]|k[eghimnprwyz]|l[abcikrstuvy]|m[acdeghklmnopqrstuvwxyz]|n[acefgilopruz]|om|p[aefghklmnrstwy]|"
    "qa|r[eosuw]|s[abcdeghiklmnorstuvxyz]|t[cdfghjklmnortvwz]|u[agksyz]|v[aceginu]|w[fs]|y[et]|z[amw]"
)
#: What may be rewritten at all; texts without it need no second look.
_HIDDEN_SIGN = regex.compile(
    r"(?:(?<!\s)\s++)?[\[({<]\s*(?:(?P<at>at|@)|(?P<dot>dot|punkt|punto|point|\.))\s*[\])}>]\s*"
    r"|(?<=[A-Za-z0-9])\s++(?:(?P<wat>at)|(?P<wdot>dot))\s++(?=[A-Za-z0-9])",
    regex.I,
)
_SPELLED = regex.compile(r"\b(?:(?:plus|oh|zero|one|two|three|four|five|six|seven|eight|nine|dot|point)\b[\x20,-]*){4,}", regex.I)
# Spelled and written digits in one run, which counts if it holds both and digits enough for an identifier.
_DIGITS = r"(?:(?:plus|oh|zero|one|two|three|four|five|six|seven|eight|nine|dot|point)\b|\+?[0-9]++(?![A-Za-z_]))"
_MIXED = regex.compile(rf"(?<![A-Za-z0-9_]){_DIGITS}(?:[\x20,.()-]*+(?<![A-Za-z_]){_DIGITS})++", regex.I)
_MIXED_TOKEN = regex.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
_TOKEN = regex.compile(r"[A-Za-z]+|[^A-Za-z]+")
_BRACKETED = regex.compile(r"[\[({<]\s*(?:at|@|dot|punkt|punto|point|\.)\s*[\])}>]", regex.I)
# Top-level domains that are words, which end an address only where no other word follows, and words that
# stand before a place or a numbered part of a text.
_ALSO_WORDS = "am|as|at|be|by|do|in|info|is|it|me|my|name|net|no|online|shop|site|so|store|to|us"
_DETERMINERS = "a|an|her|his|its|my|our|that|the|their|this|your"
_NUMBERED = "appendix|article|chapter|clause|figure|item|paragraph|part|release|rule|section|step|table|version"
_END = rf"\s++dot\s++(?!(?:{_ALSO_WORDS})\s++[A-Za-z])(?:{_TOP_LEVEL})(?![A-Za-z0-9-])"
_WORDED = regex.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s++at\s++(?!(?:{_DETERMINERS})\s)|@)[A-Za-z0-9-]++(?:\s++dot\s++[A-Za-z0-9-]++)*{_END}"
    rf"|(?<![0-9])(?<!\b(?:{_NUMBERED})\s)[0-9]{{1,3}}(?:\s++dot\s++[0-9]{{1,3}}){{3}}(?![0-9])",
    regex.I,
)
_LABEL = regex.compile(r"[A-Za-z0-9._%+-]++")
_DOT_WORD = re.compile(r"\s[dD][oO][tT]\s")


class Normal:
    """A rewritten text; ``source[k]`` is where character k comes from, and ``changed[k]`` whether it was rewritten."""

    def __init__(self, text: str):
        self.chars = list(text)
        self.source = [(k, k + 1) for k in range(len(text))]
        self.changed = [False] * len(text)

    @property
    def text(self) -> str:
        return "".join(self.chars)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put ``new`` for characters start..end; edits are in order and apart."""
        chars, source, changed, at = [], [], [], 0
        for a, b, new in edits:
            chars += self.chars[at:a] + list(new)
            span = (self.source[a][0], self.source[b - 1][1])
            source += self.source[at:a] + [span] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            at = b
        self.chars, self.source, self.changed = chars + self.chars[at:], source + self.source[at:], changed + self.changed[at:]


def _plain_letter(c: str) -> str:
    """The ASCII character that ``c`` looks like: a table entry, or its compatibility form (full width, mathematical)."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain.isascii() and plain.isprintable() and not plain.isspace():
        return plain
    if c.isdigit() and (d := unicodedata.digit(c, -1)) >= 0 and unicodedata.category(c) == "Nd":
        return str(d)
    return c


_PLAIN_CACHE: dict[str, str] = {}
#: Characters of identifiers, within which format characters are left out.
_IN_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.@_%+-")


def _look_alikes(normal: Normal) -> None:
    """Homoglyphs, one character for one; invisible format characters within a word are left out.

    What follows such a character counts as rewritten, so that the identifier around it does.
    """
    edits, chars, k = [], normal.chars, 0
    while k < len(chars):
        c, end = chars[k], k + 1
        if c >= "\x80":
            while end < len(chars) and unicodedata.category(chars[end - 1]) == "Cf":
                end += 1
            if end > k + 1 and k and chars[end - 1] in _IN_WORD and chars[k - 1] in _IN_WORD:
                edits.append((k, end, chars[end - 1]))
            else:
                end = k + 1
                new = _PLAIN_CACHE.get(c)
                if new is None:
                    new = _PLAIN_CACHE[c] = _plain_letter(c)
                if new != c:
                    edits.append((k, end, new))
        k = end
    normal.rewrite(edits)


def _spelled_digits(normal: Normal) -> None:
    edits = []
    for m in _SPELLED.finditer(normal.text):
        for t in _TOKEN.finditer(m.group()):
            word, a, b = t.group().lower(), m.start() + t.start(), m.start() + t.end()
            new = _DIGIT_WORDS.get(word) or _SIGN_WORDS.get(word)
            if word in ("dot", "point"):
                new = "."
            if new is None and not word.isalpha() and b < m.end():
                new = ""  # what separates spelled digits
            if new is not None and not (new == "" and a == b):
                edits.append((a, b, new))
    normal.rewrite(edits)


def _mixed_digits(normal: Normal) -> None:
    """Spelled digits among written ones; what stands between written digits stays."""
    edits = []
    for m in _MIXED.finditer(normal.text):
        tokens = [(t.group().lower(), m.start() + t.start(), m.start() + t.end()) for t in _MIXED_TOKEN.finditer(m.group())]
        size = sum(len(w) if w.isdigit() else w in _DIGIT_WORDS for w, _, _ in tokens)
        ip = sum("." in w or w in ("dot", "point") for w, _, _ in tokens) >= 3
        if not (any(w in _DIGIT_WORDS or w in _SIGN_WORDS for w, _, _ in tokens) and (size >= 9 or ip)):
            continue
        if sum(w in _DIGIT_WORDS for w, _, _ in tokens) < 2 and base_spans(m.group()):
            continue  # a plain number next to a word of the sentence ("+1 415 555 0123 one of us")
        for k, (w, a, b) in enumerate(tokens):
            if w.isalpha():
                edits.append((a, b, "." if w in ("dot", "point") else _DIGIT_WORDS.get(w) or _SIGN_WORDS[w]))
            elif not w.isdigit() and "." not in w and "+" not in w and (tokens[k - 1][0].isalpha() or tokens[k + 1][0].isalpha()) and k:
                edits.append((a, b, ""))
    normal.rewrite(edits)


def _signs(normal: Normal) -> None:
    text = normal.text
    edits = [(m.start(), m.end(), "@" if m["at"] or m["wat"] else ".") for m in _HIDDEN_SIGN.finditer(text)]
    # A bare "at" counts only together with a bare "dot" after the next word.
    worded = [(m.start(), m.end()) for m in _WORDED.finditer(text)]
    bracketed = [(m.start(), m.end()) for m in _BRACKETED.finditer(text)]
    starts, marks = [x for x, _ in worded], [x for x, _ in bracketed]

    def counts(a: int, b: int) -> bool:
        k = bisect_right(starts, a) - 1
        if k >= 0 and b <= worded[k][1]:
            return True
        k = bisect_left(marks, a)
        return k < len(marks) and bracketed[k][1] <= b

    # A bracketed sign licenses the bare ones of the same address: those that are one label away, and so on from there.
    licensed = [counts(a, b) for a, b, _ in edits]
    marked = [k < len(marks) and bracketed[k][1] <= b for (a, b, _), k in ((x, bisect_left(marks, x[0])) for x in edits)]
    for steps in (range(1, len(edits)), range(len(edits) - 2, -1, -1)):
        for k in steps:
            other = k - 1 if steps.step > 0 else k + 1
            low, high = min(k, other), max(k, other)
            if marked[other] and not licensed[k] and edits[low][2] + edits[high][2] != "@@" and _LABEL.fullmatch(text, edits[low][1], edits[high][0]):
                licensed[k] = marked[k] = True
    normal.rewrite([x for x, ok in zip(edits, licensed) if ok])


def hidden_spans(text: str) -> list[Span]:
    """Disguised identifiers, as spans of the source; none of them lies on rewritten-free text."""
    odd = not text.isascii() and any(_odd(c) for c in set(text) if c >= "\x80")
    low = text.lower()
    spelled = any(w in low for w in _DIGIT_WORDS) and _SPELLED.search(text)
    mixed = any(w in low for w in _DIGIT_WORDS) and _DIGIT.search(text) and _MIXED.search(text)
    if not (odd or spelled or mixed or _BRACKETED.search(text) or _DOT_WORD.search(text) and _WORDED.search(text)):
        return []
    normal = Normal(text)
    if odd:
        _look_alikes(normal)
    _mixed_digits(normal)
    _spelled_digits(normal)
    _signs(normal)
    return [
        (normal.source[a][0], normal.source[b - 1][1], kind)
        for a, b, kind in base_spans(normal.text)
        if any(normal.changed[a:b])
    ]


def _odd(c: str) -> bool:
    new = _PLAIN_CACHE.get(c)
    if new is None:
        new = _PLAIN_CACHE[c] = _plain_letter(c)
    return new != c or unicodedata.category(c) == "Cf"


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: a disguised one is added unless a plain one of its kind covers it."""
    base = base_spans(text)
    # Plain spans of a kind lie apart and in order, so the last one that begins no later is the only one that can cover.
    plain = [[x for x in base if x[2] == k] for k in range(len(KINDS))]
    starts = [[a for a, _, _ in spans] for spans in plain]

    def covered(a: int, b: int, kind: int) -> bool:
        at = bisect_right(starts[kind], a) - 1
        return at >= 0 and b <= plain[kind][at][1]

    more = [x for x in hidden_spans(text) if not covered(*x)]
    return base, sorted({*base, *more}, key=lambda x: (x[0], x[2], x[1]))


def listed(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span (overlapping ones together) as its kind in angle brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; null texts count as empty.

    Counts and ``spans`` hold all spans; ``base_sha256`` digests the plain ones. Offsets are code points.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found = [find_spans(x) for x in texts]
                n = [[sum(s[2] == k for s in every) for _, every in found] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in n),
                     pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                     pa.array([listed(every) for _, every in found], pa.string())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        find, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with identifiers in the text replaced by their kind, and ``chars_col`` (if there) counted anew."""

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                known = part.column(text_col).is_valid().to_pylist()
                new = [mask(x, find_spans(x)[1]) if ok else None for x, ok in zip(texts, known)]
                at = part.schema.get_field_index(text_col)
                part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                if chars_col in part.schema.names:
                    at = part.schema.get_field_index(chars_col)
                    size = pa.array([None if x is None else len(x) for x in new], part.schema.field(at).type)
                    part = part.set_column(at, part.schema.field(at), size)
                yield part

    return docs.mapInArrow(hide, docs.schema)
