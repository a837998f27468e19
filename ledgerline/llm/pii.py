"""PII (1): offset-preserving deobfuscation.

Plain identifiers (e-mail, IP and card numbers, phone numbers) are found in the
text as it is: the base spans. Then a chain of transducers rewrites a copy of
the text and keeps, for every character it writes, the source characters it
stands for: look-alike letters and digits of other scripts become ASCII ones,
invisible characters vanish, bracketed "at" and "dot" become @ and ., spelled
ones do in addresses and between four or more numbers, whose spelled digits are
joined; runs of spelled digits become digits, a spelled "plus" before digits
becomes +. The same detectors run on the copy, and each span found there that
holds rewritten characters is mapped back to the source and added unless it
lies inside a base span of its kind.

Detection takes linear time: e-mails are looked for around each @, numbers only
where a digit run starts, without backtracking.

Rows: a null text is empty and has no spans; texts are whole and of any length;
ids may repeat or be null; an empty table gives an empty result. Offsets count
code points, ends are exclusive; spans are ordered by start, then kind, then
end. Only the id and the text column are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a digit run starts: one that starts later in a run could start earlier.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> list[Span]:
    """Spans of local@domain.domain, leftmost first: the longest local part before each @ that has a domain."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        low = found.end() if found else at + 1
        at = text.find("@", low)
    return out


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def numbers(text: str, pattern: re.Pattern, holds: Callable[[str], bool]) -> list[Span]:
    return [m.span() for m in pattern.finditer(text) if holds(m.group())]


def is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def is_card(found: str) -> bool:
    digits = NOT_DIGIT.sub("", found)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", found)) <= 15


DIGIT = re.compile("[0-9]")


def detect(text: str) -> dict[str, list[Span]]:
    """The spans of each kind, in order."""
    digits = DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": numbers(text, IP, is_ip) if digits and "." in text else [],
        "card": numbers(text, CARD, is_card) if digits else [],
        "phone": numbers(text, PHONE, is_phone) if digits and "+" in text else [],
    }


# --- transducers ---------------------------------------------------------------------------------------------------

# Letters of other scripts that look like the ASCII letter below them.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТХУІЈЅаеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ",
    "ABEKMHOPCTXYIJSaeopcyxijsdqwhABEZHIKMNOPTYXaivopu"))
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
# Digits, "at", "dot" and "plus" as spelled in the four languages.
SPELLED = [
    ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"],
    ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"],
    ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"],
    ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
]
AT, DOT, PLUS = "at|arobase|arroba|klammeraffe", "dot|point|punkt|punto", "plus|más"
DIGIT_OF = {word: str(i) for words in SPELLED for i, word in enumerate(words)}


def _ascii_of(code: int) -> str | None:
    """The ASCII letter, digit or mark that a compatibility form or a digit of another script stands for."""
    c = chr(code)
    plain = unicodedata.normalize("NFKC", c)
    if len(plain) == 1 and plain.isascii() and plain.isprintable() and plain != " ":
        return plain
    digit = unicodedata.decimal(c, None)
    return None if digit is None else str(digit)


def homoglyphs() -> dict[int, str]:
    """Code point -> ASCII: compatibility forms and other scripts' digits by rule, look-alike letters as listed."""
    blocks = [(0x0660, 0x1000), (0x1000, 0x1C60), (0x2000, 0x2200), (0x2460, 0x2500), (0xA620, 0xABFA), (0xFE30, 0xFFF0), (0x10400, 0x11E00), (0x1D400, 0x1D800), (0x1F100, 0x1FBFA)]
    found = {c: a for low, high in blocks for c in range(low, high) if (a := _ascii_of(c))}
    found |= {ord(k): v for k, v in LOOK_ALIKES.items()}
    return found


HOMOGLYPHS = homoglyphs()
_digit = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
_run = rf"(?<!\w)(?:{_digit}|[0-9])(?:[\s,-]++(?:{_digit}|[0-9])(?!\w)){{2,}}"
_word = r"[A-Za-z0-9._%+-]++"
_label = r"[A-Za-z0-9-]+"
_mark = rf"[\[({{<]\s*+(?:({AT}|@)|({DOT}|\.))\s*+[\])}}>]"
SPELLED_RUN = re.compile(_run, re.I)
SPELLED_DIGIT = re.compile(rf"(?<!\w)(?:{_digit})(?!\w)", re.I)
SPELLED_PLUS = re.compile(rf"(?<!\w)(?:{PLUS})\s++(?=[0-9])", re.I)
GAP = re.compile(r"(?<=[0-9])[\s,-]++(?=[0-9])")
BRACKETED = re.compile(rf"(?<!\s)\s*+{_mark}\s*+", re.I)
# From the last word of the local part, so that a search does not run through a long row of dots from each of its
# words; mail_spans adds the words before it.
SPELLED_MAIL = re.compile(rf"(?<![\w.%+-]){_word}\s++(?:{AT}|@)\s++{_label}(?:\s++(?:{DOT}|\.)\s++{_label})+(?!\w)"
                          rf"|(?<![\w.%+-]){_word}\s++(?:{AT})\s++{_label}(?:\.{_label})+(?!\w)"
                          rf"|(?<![\w.%+-])[A-Za-z0-9._%+-]+@{_label}(?:\s++(?:{DOT})\s++{_label})+(?!\w)", re.I)
EARLIER = re.compile(rf"(?:\s++(?:{'|'.join(w[::-1] for w in DOT.split('|'))})\s++{_word}(?!\w))++", re.I)  # over the reversed text
_number = rf"(?:(?:{_digit})(?!\w)|[0-9]++)"
_between = rf"(?:\s++(?:{DOT}|\.)\s++|\.)"
# A whole row of numbers at once, each search going on behind it.
NUMBER_ROW = re.compile(rf"(?<!\w){_number}(?:(?:{_between}|[\s,-]++){_number})*+", re.I)
BETWEEN = re.compile(_between, re.I)
OCTET = re.compile(rf"(?<!\w)(?:{_digit})(?:[\s,-]++(?:{_digit})(?!\w))*+(?!\w)", re.I)
INNER = re.compile(rf"\s++(?:({AT}|@)|({DOT}|\.))\s++", re.I)
#: Without any of these no transducer changes a text (Latin letters with accents are not homoglyphs).
HINT = re.compile(rf"[^\x00-ɏ]|\xad|{_mark}|\s(?:{DOT}|\.)\s|@|\s(?:{AT})\s++{_label}\.[A-Za-z0-9-]|{_run}"
                  rf"|(?<!\w)(?:{PLUS})\s++[0-9]|(?<=[0-9])(?!\x20[0-9])[\s,-]++[0-9]"
                  rf"|(?<!\w)(?:{_digit})\.[0-9]|\.(?:{_digit})(?!\w)", re.I)


class Traced:
    """A rewritten text: for each character the source span it stands for, and whether it was rewritten."""

    def __init__(self, text: str):
        plain = text.translate(HOMOGLYPHS)
        seen = [i for i, c in enumerate(plain) if c not in INVISIBLE]
        self.text = "".join([plain[i] for i in seen])
        self.start, self.end = seen, [i + 1 for i in seen]
        self.new = [text[i] != plain[i] or (k > 0 and seen[k - 1] != i - 1) for k, i in enumerate(seen)]

    def rewrite(self, pattern: re.Pattern, made: Callable[[re.Match], str], within: list[Span] | None = None) -> None:
        """Replace each match (inside the spans of ``within``) by ``made(match)``; what is written stands for the whole match."""
        places = [(0, len(self.text))] if within is None else within
        text, start, end, new, at = [], [], [], [], 0
        for m in chain.from_iterable(pattern.finditer(self.text, *place) for place in places):
            a, b = m.span()
            put = made(m)
            if put == m.group():
                continue
            text += [self.text[at:a], put]
            start += self.start[at:a] + [self.start[a]] * len(put)
            end += self.end[at:a] + [self.end[b - 1]] * len(put)
            new += self.new[at:a] + [True] * len(put)
            at = b
        if at:
            self.text = "".join([*text, self.text[at:]])
            self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]


def mail_spans(text: str) -> list[Span]:
    """Spelled e-mails with their whole local parts, each walked left from its match up to the one before."""
    out, low, back = [], 0, None
    for m in SPELLED_MAIL.finditer(text):
        back = text[::-1] if back is None else back
        more = EARLIER.match(back, len(text) - m.start(), len(text) - low)
        out.append((len(text) - more.end() if more else m.start(), m.end()))
        low = m.end()
    return out


def address_spans(text: str) -> list[Span]:
    """Rows of numbers with three or more dots, plain or spelled."""
    return [m.span() for m in NUMBER_ROW.finditer(text) if len(BETWEEN.findall(m.group())) >= 3]


def normalise(text: str) -> Traced:
    """The transducers in turn."""
    out = Traced(text)

    def mark(m: re.Match) -> str:
        return "@" if m.group(1) else "."

    def digit(m: re.Match) -> str:
        return DIGIT_OF.get(m.group().casefold(), m.group())  # ignoring case also takes letters such as the long s

    def joined(m: re.Match) -> str:
        return "".join(map(digit, SPELLED_DIGIT.finditer(m.group())))

    out.rewrite(BRACKETED, mark)
    out.rewrite(INNER, mark, mail_spans(out.text))
    out.rewrite(OCTET, joined, address_spans(out.text))
    out.rewrite(INNER, mark, address_spans(out.text))
    out.rewrite(SPELLED_DIGIT, digit, [m.span() for m in SPELLED_RUN.finditer(out.text)])
    out.rewrite(SPELLED_PLUS, lambda m: "+")
    out.rewrite(GAP, lambda m: " ")
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) as (start, kind number, end) in order."""
    base = detect(text)
    plain = sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in base[kind])
    if not HINT.search(text):
        return plain, []
    copy, added = normalise(text), set()
    if copy.text != text:
        for k, kind in enumerate(KINDS):
            for a, b in detect(copy.text)[kind]:
                start, end = copy.start[a], copy.end[b - 1]
                if any(copy.new[a:b]) and not any(x <= start and end <= y for x, y in base[kind]):
                    added.add((start, k, end))
    return plain, sorted(added)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, spans), spans an array of (kind, start, end, base) in order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for text in part.column("text").to_pylist():
                    base, added = find(text) if text else ([], [])
                    every = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: s[:3])
                    found.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in every])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, shape)], names=["id", "spans"])

    return rows.mapInArrow(released(run), f"id {kind}, spans array<struct<kind string, start long, end long, base boolean>>")
