"""Personal data: plain identifiers, and identifiers in disguise found by normalising the
text with a map back to its characters."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from gridweave.llm.common import map_arrow, texts

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def find_emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @, domain with a dot. Works from each @ outwards, as
    a scan from every letter would be slow on long runs of letters."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def find_ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find_cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def find_phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {
    "email": find_emails,
    "ip": find_ips,
    "card": find_cards,
    "phone": find_phones,
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plain identifiers, by kind, then start."""
    wanted = [("email", "@" in text), ("phone", "+" in text)]
    has_digit = _DIGIT.search(text) is not None
    use = dict(wanted, ip=has_digit, card=has_digit)
    return [(kind, *span) for kind in KINDS if use[kind] for span in FINDERS[kind](text)]


# --- Normalising with a map to the source ------------------------------------------------

# Letters of other alphabets that look like an ASCII letter.
HOMOGLYPHS = str.maketrans(
    "АВЕЅІЈКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρτυικ",
    "ABESIJKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXaovptuik",
)
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
# Number words, in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Number words in a row that stand for a number without digits or a plus sign next to
# them; one alone is a word of the language.
LEAST_DIGIT_WORDS = 3

# The last part of a domain whose dots are spelled without brackets. Codes of
# countries that are words of the corpus' languages, such as "it" or "no", are not among them.
TOP_DOMAINS = frozenset(
    "com net org edu gov mil int info biz name pro io ai app dev cloud online site shop store blog tech "
    "test example invalid local ac at au be br ca ch cl cn co cz de dk ee es eu fi fr gr hk hr hu ie il "
    "jp kr lt lu lv mx nl nz pe pl pt ro ru se sg sk tr tw ua uk za".split()
)


def _compatible() -> dict[int, str]:
    """Digits of other scripts, and letters and digits in another font, width or circle, with
    the ASCII ones they stand for."""
    out = {}
    for c in map(chr, range(0x250, 0x20000)):
        kind = unicodedata.decomposition(c).partition(" ")[0]
        if (digit := unicodedata.decimal(c, None)) is not None:
            out[ord(c)] = str(digit)
        elif kind in ("<font>", "<wide>", "<circle>"):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and (plain.isalpha() or kind != "<circle>"):
                out[ord(c)] = plain
    return out


LOOKALIKES = _compatible() | {c: chr(by) for c, by in HOMOGLYPHS.items()} | dict.fromkeys(map(ord, INVISIBLE), "")

_ASCII_ONLY = re.compile(r"[\x00-\x7f]*\Z")
# Those beyond U+FFFF as one range, as a class of many such characters is gone through one by one.
_LOOKALIKE = re.compile("[" + "".join(chr(c) for c in LOOKALIKES if c < 0x10000) + "\U00010000-\U0001ffff]")
_BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}
_SIGNS = {"at": "@", "dot": ".", "punkt": ".", "point": ".", "punto": ".", "arroba": "@", "arobase": "@"}
_WORDS = "|".join(_SIGNS)
_BRACKETED = re.compile(rf"[\[({{<]\s*({_WORDS}|@|\.)\s*[\])}}>]\s*", re.IGNORECASE)
_DOT = "(?:dot|punkt|point|punto)"
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])[ ]+(?:at|arroba|arobase)[ ]+(?=[A-Za-z0-9])", re.IGNORECASE)
_SPACED_DOT = re.compile(rf"[ ]+{_DOT}[ ]+(?=[A-Za-z0-9-])", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z0-9-]+")
_DOT_BEFORE = re.compile(rf"(?<=[ ]){_DOT}\Z", re.IGNORECASE)
_NUMBER_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_NUMBER_PART = re.compile(rf"(?<!\w)(?:({_NUMBER_WORD})|[0-9]+)(?!\w)", re.IGNORECASE)
_NUMBER_GAP = " .()+-"
_PLUS_WORD = re.compile(rf"\+[ (]*(?:{_NUMBER_WORD})(?!\w)", re.IGNORECASE)
_NUMBER_BYTES = frozenset(
    form.encode().lower() for w in DIGIT_WORDS for form in (w, w.upper(), w.capitalize())
)
_TO_SPACES = bytes.maketrans(b".()+-", b"     ")
_IP_PART = rf"(?:[0-9]{{1,3}}|(?:{_NUMBER_WORD})(?:[ -](?:{_NUMBER_WORD})){{0,2}})(?!\w)"
_SPELLED_IP = re.compile(rf"(?<!\w){_IP_PART}(?:(?:[ ]{_DOT}[ ]|\.){_IP_PART}){{3}}", re.IGNORECASE)
_IP_DOT = re.compile(rf"[ ]{_DOT}[ ](?=(?:[0-9]|{_NUMBER_WORD}))", re.IGNORECASE)
_SPELLED_DOTS = (" dot ", " punkt ", " point ", " punto ")
# Characters of a spelled address of numbers, at most.
_IP_LENGTH = 160
_PLUS = re.compile(r"(?<!\w)plus[ ]+(?=\(?[0-9])", re.IGNORECASE)


class Normalized:
    """A text after some rewriting, with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.pieces: list[tuple[int, int, int, int]] = []  # new start, new end, old start, old end
        self.starts: list[int] = []  # the new starts alone

    def rewrite(self, changes: list[tuple[int, int, str]]) -> Normalized:
        """Replace ranges of this text, in order and not overlapping; map through."""
        out, pieces, at, new = [], [], 0, 0
        for start, end, by in changes:
            if start < at:
                continue
            out += [self.text[at:start], by]
            new += start - at
            pieces.append((new, new + len(by), start, end))
            new, at = new + len(by), end
        out.append(self.text[at:])
        after = Normalized("".join(out))
        after.pieces, after.starts, after.before = pieces, [p[0] for p in pieces], self
        return after

    def source(self, start: int, end: int) -> Span:
        """The source range of a range of this text."""
        if not hasattr(self, "before"):
            return start, end
        return self.before.source(self._old(start, False), self._old(end, True))

    def _old(self, at: int, is_end: bool) -> int:
        """Where a place between characters was. Inside a replacement: its nearer edge
        outwards. A removed range belongs to neither neighbour."""
        i = bisect_left(self.starts, at if is_end else at + 1)
        if not i:
            return at
        new_start, new_end, old_start, old_end = self.pieces[i - 1]
        if at >= new_end and not (is_end and at == new_end == new_start):
            return old_end + at - new_end
        return old_end if is_end else old_start


def _lookalikes(text: str) -> list[tuple[int, int, str]]:
    return [
        (m.start(), m.end(), LOOKALIKES[ord(m[0])]) for m in _LOOKALIKE.finditer(text) if ord(m[0]) in LOOKALIKES
    ]


def _has_number_run(text: str) -> bool:
    words = list(filter(None, text.encode().lower().translate(_TO_SPACES).split(b" ")))
    is_word = bytes(map(_NUMBER_BYTES.__contains__, words))
    if b"\1" * LEAST_DIGIT_WORDS in is_word:
        return True
    at = is_word.find(1)
    while at >= 0:
        if words[at - 1 : at] and words[at - 1].isdigit() or words[at + 1 : at + 2] and words[at + 1].isdigit():
            return True
        at = is_word.find(1, at + 1)
    return "+" in text and _PLUS_WORD.search(text) is not None


def _number_runs(text: str) -> Iterator[list[re.Match]]:
    """Runs of number words and groups of digits, with nothing but _NUMBER_GAP between."""
    run: list[re.Match] = []
    for part in _NUMBER_PART.finditer(text):
        if run and text[run[-1].end() : part.start()].strip(_NUMBER_GAP):
            yield run
            run = []
        run.append(part)
    if run:
        yield run


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Number words of a run become digits, and what separates two of them goes, so that
    the run reads as a number; brackets, dots and plus signs stay. Fewer words than
    LEAST_DIGIT_WORDS do so next to digits, unless a sentence ends between, or a plus sign."""
    changes = []
    for run in _number_runs(text):
        at = 0
        while at < len(run):
            if not run[at][1]:
                at += 1
                continue
            end = at
            while end < len(run) and run[end][1]:
                end += 1
            before = text[run[at - 1].end() : run[at].start()] if at else None
            after = text[run[end - 1].end() : run[end].start()] if end < len(run) else None
            if (
                end - at >= LEAST_DIGIT_WORDS
                or (before is not None and ". " not in before)
                or (after is not None and ". " not in after)
                or text[max(0, run[at].start() - 9) : run[at].start()].rstrip(" (").endswith("+")
            ):
                if before and len(before) > 1 and not before.strip(" -"):
                    changes.append((run[at - 1].end(), run[at].start(), " "))
                for word, following in zip(run[at:end], [*run[at + 1 : end], None], strict=True):
                    stop = word.end()
                    if following and not text[stop : following.start()].strip(" -"):
                        stop = following.start()
                    changes.append((word.start(), stop, DIGIT_WORDS[word[1].lower()]))
                if after and len(after) > 1 and not after.strip(" -"):
                    changes.append((run[end - 1].end(), run[end].start(), " "))
            at = end
    return changes


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Signs in brackets, with the white space around. Works from each bracket backwards, as
    a scan from every blank would be slow on long runs of blanks."""
    changes, last = [], 0
    for m in _BRACKETED.finditer(text):
        start = m.start()
        while start > last and text[start - 1].isspace():
            start -= 1
        changes.append((start, m.end(), _SIGNS.get(m[1].lower(), m[1])))
        last = m.end()
    return changes


def normalize(text: str) -> Normalized | None:
    """The text without disguises, or None if it has none.

    In turn: look-alike letters and digits become ASCII and invisible characters go;
    spelled dots between the four parts of an address of numbers become dots; runs of
    number words, or of digits and such words, become digits, "plus" before a digit a plus
    sign; "at" and "dot" become signs in brackets, or as words if what follows "at" is
    names with a spelled dot, the last one of TOP_DOMAINS; "dot" also between names before
    an at sign.
    """
    now = Normalized(text)
    if not _ASCII_ONLY.match(text):
        if changes := _lookalikes(text):
            now = now.rewrite(changes)
    low = now.text.lower()
    if any(dot in low for dot in _SPELLED_DOTS) and (changes := _ip_dots(now.text)):
        now = now.rewrite(changes)
    if _has_number_run(now.text) and (changes := _numbers(now.text)):
        now = now.rewrite(changes)
    if "plus" in (low := now.text.lower()) and (changes := [(m.start(), m.end(), "+") for m in _PLUS.finditer(now.text)]):
        now = now.rewrite(changes)
    if any(b in low for b in _BRACKETS) and (changes := _signs(now.text)):
        now = now.rewrite(changes)
    if (" at " in low or " arroba " in low or " arobase " in low) and (changes := _spaced_ats(now.text)):
        now = now.rewrite(changes)
    if "@" in now.text and (changes := _domain_dots(now.text)):
        now = now.rewrite(changes)
    if "@" in now.text and (changes := _local_dots(now.text)):
        now = now.rewrite(changes)
    return now if hasattr(now, "before") else None


def _ip_dots(text: str) -> list[tuple[int, int, str]]:
    """Spelled dots of addresses of numbers. Looks around spelled dots before a number only."""
    changes, last = [], 0
    for dot in _IP_DOT.finditer(text):
        if dot.start() < last:
            continue
        whole = _SPELLED_IP.search(text, max(last, dot.start() - _IP_LENGTH), dot.end() + _IP_LENGTH)
        if whole:
            last = whole.end()
            changes += [(m.start(), m.end(), ".") for m in _IP_DOT.finditer(text, whole.start(), last)]
    return changes


def _spelled_dots(text: str, at: int) -> list[Span]:
    """Spelled dots of the domain that begins at a place: those before its last name that is
    a top domain. Names are parted by dots, plain or spelled."""
    dots: list[Span] = []
    sure = 0
    name = _NAME.match(text, at)
    while name:
        if dots and name[0].lower() in TOP_DOMAINS:
            sure = len(dots)
        end = name.end()
        if text[end : end + 1] == ".":
            name = _NAME.match(text, end + 1)
        elif dot := _SPACED_DOT.match(text, end):
            dots.append(dot.span())
            name = _NAME.match(text, dot.end())
        else:
            break
    return dots[:sure]


def _spaced_ats(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(text) if _spelled_dots(text, m.end())]


def _domain_dots(text: str) -> list[tuple[int, int, str]]:
    """Spelled dots inside a domain, after an at sign."""
    changes, at = [], text.find("@")
    while at >= 0:
        changes += [(*dot, ".") for dot in _spelled_dots(text, at + 1)]
        at = text.find("@", at + 1)
    return changes


def _local_dots(text: str) -> list[tuple[int, int, str]]:
    """Spelled dots between names, directly before an at sign. Works from each @ backwards,
    as `find_emails` does."""
    changes, at = [], text.find("@")
    while at >= 0:
        found, start = [], at
        while True:
            name = start
            while start and text[start - 1] in _LOCAL:
                start -= 1
            gap = start
            while gap and start < name and text[gap - 1] == " ":
                gap -= 1
            word = gap < start and _DOT_BEFORE.search(text, max(0, gap - 6), gap)
            end = word and word.start()
            while end and text[end - 1] == " ":
                end -= 1
            if not word or end == word.start() or not end or text[end - 1] not in _LOCAL:
                break
            found.append((end, start, "."))
            start = end
        changes += reversed(found)
        at = text.find("@", at + 1)
    return changes


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain identifiers, all identifiers), each by kind, then start.

    What the normalised text shows is added unless a span of its kind already covers it.
    """
    if not text:
        return [], []
    base = base_spans(text)
    clear = normalize(text)
    if clear is None:
        return base, base
    every = list(base)
    starts = {kind: [s for k, s, _ in base if k == kind] for kind in KINDS}
    ends = {kind: [e for k, _, e in base if k == kind] for kind in KINDS}
    last: dict[str, Span] = {}
    for kind, start, end in base_spans(clear.text):
        start, end = clear.source(start, end)
        # spans of a kind come in order, plain ones and added ones alike, so that only the
        # last to begin before this one can cover it
        at = bisect_right(starts[kind], start)
        plain = at > 0 and end <= ends[kind][at - 1]
        added = kind in last and last[kind][0] <= start and end <= last[kind][1]
        if start < end and not plain and not added:
            every.append((kind, start, end))
            last[kind] = (start, end)
    every.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return base, every


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row.

    Counts and digest are of plain identifiers; `spans` lists all, those in disguise
    too. Offsets are code points, the end exclusive. Null and empty texts have none.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans, number = [], [], []
        for t in texts(batch):
            base, every = find_spans(t.decode() if t else None)
            for kind, column in counts.items():
                column.append(sum(k == kind for k, _, _ in base))
            digests.append(sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
            number.append(len(every))
        columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS)]
        return pa.record_batch(
            [*columns, pa.array(digests), pa.array(spans), pa.array(number, pa.int64())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"],
        )

    return map_arrow(
        docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")),
        rows,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long",
    )


def redacted(text: str | None) -> str | None:
    """The text with a label such as [EMAIL] for each identifier. Of overlapping ones the
    first, or the longer, gives the label, and the label covers them all."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in find_spans(text)[1]), key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `docs`, with redacted texts and their new lengths."""

    @F.pandas_udf(StringType())
    def clean(column):
        return column.map(redacted, na_action="ignore")

    out = docs.withColumn(text, clean(F.col(text).cast("string")))
    if length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(dict(docs.dtypes)[length]))
    return out
