"""Personal data in whole texts, plain and disguised, with spans of the source text.

Plain detection per kind, leftmost and without overlap: email, ip, card (13 to 19 digits that pass the Luhn test) and phone
(9 to 15 digits). Each finder takes time in proportion to the text, whatever the text.

Disguised detection runs the same finders on a normalised text. Transducers rewrite

* characters that look like ASCII ones (compatibility forms by rule, and a table of Cyrillic and Greek ones) and drop invisible ones;
* digits spelled in English, German, French or Spanish along with the blanks between them, where a chain of digits, marks and blanks holds
  as many digits as the shortest finding;
* ``[at]``, ``(dot)`` and the like in brackets, bare ``at`` and ``dot`` words of these languages, in any mixture with brackets and real marks,
  where what they join parses as an address, and bare ``dot`` words between digits;

and note for each rewritten part where it came from. A finding that touches a rewritten part is mapped back to the source characters and
added, unless it lies within a plain finding of its kind. Plain findings always stay. Texts are searched with and without their spelled
digits rewritten; fewer than ``SPELLED_RUN`` of those do not extend what is found without them.

A bare ``at`` needs a host of which no label but the last is a function word, and a last label of letters that is none either, unless it is an
ending too (``it``, ``at``, ``de``). Such an ending, and a host with real dots only, need a local part that is no function word.

Spans count code points, the end is exclusive. Null texts count as empty. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from huntframe.llm.arrow_text import keyed, map_rows

KINDS = ("email", "ip", "card", "phone")
SPELLED_RUN = 3
SHORTEST = 4  # digits of an ip

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterable[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
        if domain and start < at:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterable[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterable[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterable[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: list(find(text)) for kind, find in FINDERS.items()}


# Cyrillic and Greek letters that look like ASCII ones, and marks that look like "@", "." and "-".
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y",
    "ԝ": "w", "х": "x", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i",
    "ɑ": "a", "ɡ": "g", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
# Spelled digits.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8",
    "nine": "9", "null": "0", "un": "1", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9",
}
# Words of disguised addresses.
AT_WORDS = ("at", "arobase", "arroba", "klammeraffe")
DOT_WORDS = ("dot", "punkt", "point", "punto")
# Function words, and which of those are endings of hosts, too.
FUNCTION_WORDS = frozenset(
    """a an the this that these those some any each every no which what one i you he she it we they me him her us them my your his its our
    their and or but nor if of in on at to for from by with as into onto over under than then so not is are was were be been am has had do
    does did when where who how there here der die das den dem des ein eine einen einem einer und oder aber wenn von im am um zu zum zur mit
    für auf aus bei nach ist sind war sich nicht er sie es wir ihr ich du le la les un une et ou mais si de du au aux en dans sur par pour avec
    sans ce cet cette ces est sont je tu il elle nous vous ils elles ne pas que qui el los las una y o pero del al con sin por para se su sus
    lo esto este esta ese esa""".split()
) | {*AT_WORDS, *DOT_WORDS}
ENDINGS = frozenset("ai al am an as at au be by de do es in is it la me my ne no se si so st su to us".split())


def _lookalikes() -> dict[str, str]:
    """Compatibility forms of single printable ASCII characters, invisible characters (to nothing), and the table above."""
    found = {}
    for code in [*range(0x80, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and "!" <= plain <= "~":
            found[c] = plain
    return found | dict.fromkeys("­​‌‍⁠﻿", "") | {k: v for k, v in LOOKALIKES.items()}


HOMOGLYPHS = _lookalikes()
_DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_ATS, _DOTS = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_BLANKS = r"[^\S\n]*+\n?+[^\S\n]*+"
_GAP = rf"(?=\s){_BLANKS}"
_LABEL = r"[A-Za-z0-9_%+-]"
_BRACKET = re.compile(rf"[\[({{<]\s*+(?:(?P<at>{_ATS}|@)|(?:{_DOTS}|\.))\s*+[\])}}>]", re.I)
_BARE_AT = re.compile(rf"(?<={_LABEL}){_GAP}(?:{_ATS}){_GAP}(?={_LABEL})", re.I)
_BARE_DOT = re.compile(rf"(?<={_LABEL}){_GAP}(?:{_DOTS}){_GAP}(?={_LABEL})", re.I)
_DOT = re.compile(rf"\.|{_BLANKS}[\[({{<]\s*+(?:{_DOTS}|\.)\s*+[\])}}>]{_BLANKS}|{_GAP}(?:{_DOTS}){_GAP}", re.I)
_HOST_LABEL = re.compile(r"[A-Za-z0-9-]++")
_ITEM = rf"(?:[0-9]++|(?<![^\W_]){_DIGIT_WORD}(?![^\W_]))"
_CHAIN = re.compile(rf"{_ITEM}(?:(?:[\s().-]|(?<=\s)(?:{_DOTS})(?=\s)|[\[{{<]|(?<=[\[({{<])(?:{_DOTS})(?=[\])}}>])|[\]}}>])*+{_ITEM})*", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_SIGN = re.compile("@")
_PLUS = re.compile(r"\bplus[ ](?=[0-9])", re.I)


class Aligned:
    """A text under rewriting. ``starts`` are positions of its parts, ``sources`` their source spans, ``made`` marks rewritten ones."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.sources, self.made = [0], [(0, len(text))], [False]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the present text, and whether it holds rewritten parts."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, b = self.sources[first][0], self.sources[last][1]
        if not self.made[first]:
            a += start - self.starts[first]
        if not self.made[last]:
            b = self.sources[last][0] + end - self.starts[last]
        return a, b, b - a != end - start or any(self.made[first : last + 1])  # dropped characters have no part

    def digits(self, start: int, end: int) -> int:
        """How many spelled digits a span of the present text holds."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1)
        return sum(self.made[k] and self.sources[k][1] - self.sources[k][0] > 1 and self.text[self.starts[k]].isdigit() for k in range(first, last))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the present text, given in order and without overlap."""
        if not edits:
            return
        out, starts, sources, made, size = [], [], [], [], 0

        def put(part: str, source: tuple[int, int], new: bool) -> None:
            nonlocal size
            if part:
                out.append(part)
                starts.append(size)
                sources.append(source)
                made.append(new)
                size += len(part)

        def copy(start: int, end: int) -> None:
            k = bisect_right(self.starts, start) - 1
            while start < end:
                stop = min(end, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                if self.made[k]:
                    put(self.text[start:stop], self.sources[k], True)
                else:
                    first = self.sources[k][0] + start - self.starts[k]
                    put(self.text[start:stop], (first, first + stop - start), False)
                start, k = stop, k + 1

        at = 0
        for start, end, new in edits:
            copy(at, start)
            a, b, _ = self.source(start, end)
            put(new, (a, b), True)
            at = end
        copy(at, len(self.text))
        self.text = "".join(out)
        self.starts, self.sources, self.made = starts or [0], sources or [(0, 0)], made or [False]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits of chains that hold enough digits for a finding, each with the blanks up to the next spelled one."""
    known = sum(map(SPELLED.__contains__, _WORDS.findall(text.lower())))
    if not known or known < SHORTEST and known + sum(map(str.isdigit, text)) < SHORTEST:
        return []
    edits = []
    for chain in _CHAIN.finditer(text):
        words = [w for w in _WORDS.finditer(text, *chain.span()) if w[0].lower() in SPELLED]
        if words and len(words) + sum(map(str.isdigit, chain[0])) >= SHORTEST:
            for w, after in zip(words, [*words[1:], None], strict=True):
                joined = after is not None and not text[w.end() : after.start()].strip(" -")
                edits.append((w.start(), after.start() if joined else w.end(), SPELLED[w[0].lower()]))
    return edits


def _host_end(text: str, start: int, bare_at: bool, local: str) -> int:
    """End of the longest host at ``start`` whose labels may stand in an address, or -1."""
    label = _HOST_LABEL.match(text, start)
    if not label:
        return -1
    best, real, weak_local = -1, True, local.lower() in FUNCTION_WORDS
    while dot := _DOT.match(text, label.end()):
        if bare_at and label[0].lower() in FUNCTION_WORDS:
            break
        if not (label := _HOST_LABEL.match(text, dot.end())):
            break
        real = real and dot[0] == "."
        last = label[0].lower()
        stray = last in FUNCTION_WORDS and last not in ENDINGS
        if bare_at:
            stray = stray or not (last.isalpha() and len(last) > 1) or weak_local and (real or last in FUNCTION_WORDS)
        if dot[0] == "." and not bare_at or not stray:
            best = label.end()
    return best


def _mark_edits(text: str) -> list[tuple[int, int, str]]:
    """Marks in brackets, bare words that are marks of an address, and bare dots between digits."""
    edits, dots, ats, last = {}, {}, [], 0
    if any(c in text for c in "[({<"):
        for m in _BRACKET.finditer(text):
            start, end = m.start(), m.end()
            while start > last and text[start - 1].isspace():
                start -= 1
            while end < len(text) and text[end].isspace():
                end += 1
            last = end
            edits[start] = (start, end, "@" if m["at"] else ".")
            if m["at"]:
                ats.append((start, end, False))
            else:
                dots[end] = start
    low = text.lower()
    bare = {m.start(): m.end() for m in _BARE_DOT.finditer(text)} if any(w in low for w in DOT_WORDS) else {}
    dots.update((end, start) for start, end in bare.items())
    for start, end in bare.items():
        if text[start - 1].isdigit() and text[end].isdigit():
            edits[start] = (start, end, ".")
    ats += [(*m.span(), True) for m in _BARE_AT.finditer(text)]
    if bare:
        ats += [(m.start(), m.end(), False) for m in _SIGN.finditer(text)]
    starts, done = list(bare), 0
    for start, end, bare_at in sorted(ats):
        if start < done:
            continue
        first = start
        while first > done:
            if text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in "._%+-"):
                first -= 1
            elif first < start and dots.get(first, -1) >= done:
                first = dots[first]
            else:
                break
        near = start
        while near > first and text[near - 1] not in "." and not text[near - 1].isspace():
            near -= 1
        if first == start or (stop := _host_end(text, end, bare_at, text[near:start])) < 0:
            continue
        if bare_at:
            edits[start] = (start, end, "@")
        for a in starts[bisect_left(starts, first) : bisect_left(starts, stop)]:
            edits[a] = (a, bare[a], ".")
        done = stop
    return sorted(edits.values())


def _plain_letters(text: str) -> Aligned:
    """The text with look-alikes rewritten."""
    a = Aligned(text)
    found = () if text.isascii() else HOMOGLYPHS.keys() & set(text)
    if found:
        glyph = re.compile("[" + "".join(map(re.escape, sorted(found))) + "]")
        a.rewrite([(m.start(), m.end(), HOMOGLYPHS[m[0]]) for m in glyph.finditer(text)])
    return a


def normalise(text: str) -> Aligned | None:
    """The rewritten text with its alignment, or None where there is nothing to rewrite."""
    a = _plain_letters(text)
    if edits := _spelled_edits(a.text):
        a.rewrite(edits)
        a.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(a.text)])
    a.rewrite(_mark_edits(a.text))
    return a if a.text != text else None


def find_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Plain spans by kind, and those that only the normalised texts show, by kind."""
    plain = plain_spans(text)
    added = {kind: [] for kind in KINDS}
    marked = _plain_letters(text)
    spelled = normalise(text) if _spelled_edits(marked.text) else None
    marked.rewrite(_mark_edits(marked.text))
    if marked.text != text:
        for kind, find in FINDERS.items():
            for start, end in find(marked.text):
                a, b, made = marked.source(start, end)
                if made and not _within(plain[kind], a, b):
                    added[kind].append((a, b))
    if spelled is not None:
        for kind, find in FINDERS.items():
            known, more = added[kind], []
            for start, end in find(spelled.text):
                a, b, made = spelled.source(start, end)
                if not made or _within(plain[kind], a, b) or _within(known, a, b):
                    continue
                if spelled.digits(start, end) >= SPELLED_RUN or not (_meets(plain[kind], a, b) or _meets(known, a, b)):
                    more.append((a, b))
            added[kind] = sorted([s for s in known if not _within(more, *s)] + more)
    return plain, added


def _meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the given spans, in order and apart, shares a place with a to b."""
    k = bisect_left(spans, (b, b)) - 1
    return k >= 0 and spans[k][1] > a


def _within(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a single one of the given spans, in order and apart, holds all of a to b."""
    k = bisect_right(spans, (a, 1 << 60)) - 1
    return k >= 0 and b <= spans[k][1]


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def detect_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of plain findings by kind, ``n_added``, ``base_sha256`` of the plain spans, and ``spans`` of all.

    An empty table gives an empty one; an output that is named like the key gets a ``_`` at its end.
    """

    def rows(key, text):
        for k, t in zip(key, text, strict=True):
            plain, added = find_spans(t or "")
            both = {kind: plain[kind] + added[kind] for kind in KINDS}
            yield (
                k, *(len(plain[kind]) for kind in KINDS), sum(map(len, added.values())),
                hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(both),
            )

    counts = {f"n_{kind}": T.LongType() for kind in (*KINDS, "added")}
    schema = keyed(df, key, **counts, base_sha256=T.StringType(), spans=T.StringType())
    return map_rows(df, {"key": key, "text": text}, schema, rows)


def redact(text: str) -> str:
    """The text with a mark in place of each finding; overlapping ones share the first one's mark."""
    plain, added = find_spans(text)
    spans = sorted((a, b, kind) for kind in KINDS for a, b in plain[kind] + added[kind])
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, findings in ``text`` replaced by marks. Null texts stay null."""
    from huntframe.llm.arrow_text import replace_column

    return replace_column(df, text, lambda values: [None if v is None else redact(v) for v in values])


def op5_pii_spans(spark, sf_dir: str) -> DataFrame:
    return detect_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
