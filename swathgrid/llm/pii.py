"""Personal data: plain patterns, and disguised identifiers found after transduction.

`transduce` is a chain of small transducers that each read text and write text, and keep for every
written character the source span it came from:

1. characters: homoglyphs and full-width or styled forms become ASCII, invisible characters vanish;
2. brackets: `[at]`, `(dot)` and the like become `@` and `.`;
3. speech: what is left of `name at host dot tld`, and ` dot ` between the four numbers of an IP, becomes `@` and `.`;
4. spelled digits: three or more digit words in a row become digits, `plus` before them `+`.

The plain patterns then run on the output. A find that uses at least one rewritten character
and does not lie within a plain find is mapped back to the source characters and added; it may contain or overlap plain ones.
All scans are linear in the text, so very long texts cost no more per character.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathgrid.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# Scanning from each @ leftwards gives the leftmost match without retrying every start.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Digit runs are possessive: a shorter run never helps, as a digit would follow it.
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
IP_START = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = free = m.end()
            found.append((start, end, "email"))
        else:
            # What lies before this @ can belong to no later find.
            free = max(free, at + 1)
        at = text.find("@", end)
    return found


def ips(text: str) -> list[Span]:
    """Runs are read once: a run of dotted numbers is cut into fours from its start."""
    found, at = [], 0
    while m := IP_START.search(text, at):
        at = m.end()
        parts = m[0].split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in parts):
            found.append((m.start(), m.end(), "ip"))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    return found


def phones(text: str) -> list[Span]:
    found = []
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


def plain(text: str) -> list[Span]:
    return emails(text) + ips(text) + cards(text) + phones(text)


# Letters of other scripts that look like Latin ones.
CONFUSABLES = dict(
    zip(
        "аеорсухіјѕԁԛԝһАВЕКМНОРСТУХІЈЅοανρυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijsdqwhABEKMHOPCTYXIJSoavpuikABEZHIKMNOPTYX",
        strict=True,
    )
)
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
DIGIT_WORDS = dict(zero="0", oh="0", one="1", two="2", three="3", four="4", five="5", six="6", seven="7", eight="8", nine="9")


@lru_cache(1)
def characters() -> tuple[dict[str, str], re.Pattern]:
    """The character transducer: confusables, compatibility forms of one ASCII character, digits."""
    table = dict(CONFUSABLES) | dict.fromkeys(INVISIBLE, "")
    for code in [*range(0x2000, 0x2E80), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        flat = unicodedata.normalize("NFKC", c)
        if len(flat) == 1 and "!" <= flat <= "~":
            table.setdefault(c, flat)
    for code in range(0x0660, 0x1000):
        if (d := unicodedata.digit(chr(code), None)) is not None:
            table[chr(code)] = str(d)
    return table, re.compile("[" + "".join(map(re.escape, table)) + "]")


BRACKETED = re.compile(r"\s{0,3}[\[({<]\s{0,3}(?:(at|@)|(dot|\.))\s{0,3}[\])}>]\s{0,3}", re.I)
# Endings that spoken addresses must have if neither @ nor a bracket shows them, as `at` and `dot` are words of prose too.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|eu|uk|us|ca|au|de|fr|es|it|nl|ch|at|be|pl|ru|jp|cn|in|br|mx"
ENDINGS += "|online|site|shop|store|tech|xyz|cloud|club|blog|live|news|pro|name|email|me|tv|se|no|dk|fi|ie|pt|gr|cz|nz|za|kr"
SPOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})(\sat\s|@)[A-Za-z0-9-]{1,63}+"
    r"((?:(?:\sdot\s|\.)[A-Za-z0-9-]{1,63}+(?![A-Za-z0-9-])){1,9}+)",
    re.I,
)
SPOKEN_LABEL = re.compile(r"(\sdot\s|\.)([A-Za-z0-9-]+)", re.I)
SPOKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\sdot\s|\.)[0-9]{1,3}){3}(?![0-9])", re.I)
SPOKEN_DOT = re.compile(r"\sdot\s", re.I)
# On lower case: where an address with a spoken `at` could be.
SPOKEN_AT = re.compile(r"at\s[a-z0-9-]{1,63}+(?:\.[a-z0-9-]|\sdot\s)")
ENDING = re.compile(ENDINGS, re.I)
# Words that stand before `at example.com` in prose; names of mailboxes are not among them.
PROSE = frozenset(
    "a an the me us it is are was were be been him her them you i we he she they and or not but that this so as of to in on look looked "
    "looking here there found available online hosted located visit more live only posted published buy sold read see seen start page "
    "site website blog arrive arrived stay stayed work works worked meet met stop".split()
)
_digit = "(?:" + "|".join(DIGIT_WORDS) + ")"
DIGIT_RUN = re.compile(rf"(?<![A-Za-z])(?:plus[\s,-]{{1,3}}|\+\s?)?{_digit}(?:[\s,-]{{1,3}}(?:{_digit}|[0-9]+)){{2,}}(?![A-Za-z])", re.I)
# On lower case: two items next to each other, as any run has.
DIGIT_PAIR = re.compile("(?:" + "|".join(DIGIT_WORDS) + r")[\s,-]{1,3}(?:[0-9]|" + "|".join(DIGIT_WORDS) + ")")
DIGIT_ITEM = re.compile(rf"plus|\+|{_digit}|[0-9]+", re.I)

Rewrite = tuple[int, int, str]


def character_rewrites(text: str) -> list[Rewrite]:
    table, pattern = characters()
    return [(m.start(), m.end(), table[m[0]]) for m in pattern.finditer(text)]


def bracket_rewrites(text: str) -> list[Rewrite]:
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(text)]


def spoken_rewrites(text: str, new: bytearray) -> list[Rewrite]:
    """`new` marks characters that were rewritten before: such a dot shows that an address is meant, as @ does."""
    out = []
    for m in SPOKEN.finditer(text):
        labels = list(SPOKEN_LABEL.finditer(text, m.start(3), m.end()))
        shown = m[2] == "@" or any(new[x.start(1)] for x in labels)
        known = [i for i, x in enumerate(labels, 1) if ENDING.fullmatch(x[2])]
        # Up to the last known ending, as prose can go on with ` dot `.
        labels = labels[: known[-1]] if known else labels if shown else []
        dots = [(x.start(1), x.end(1), ".") for x in labels if x[1] != "."]
        if m[2] != "@" and labels and not dots:
            # With plain dots alone, `at` is often prose, and so is a sentence that starts without a blank.
            last = labels[-1][2]
            if m[1].lower() in PROSE or (last[:1].isupper() and not last.isupper()):
                continue
        if labels and m[2] != "@":
            out.append((m.start(2), m.end(2), "@"))
        out += dots
    if SPOKEN_DOT.search(text):
        for m in SPOKEN_IP.finditer(text):
            out += [(m.start() + d.start(), m.start() + d.end(), ".") for d in SPOKEN_DOT.finditer(m[0])]
    return sorted(set(out))


def digit_rewrites(text: str) -> list[Rewrite]:
    out = []
    for m in DIGIT_RUN.finditer(text):
        # Each item takes the separator before it, so that items join up.
        last = m.start()
        for d in DIGIT_ITEM.finditer(text, m.start(), m.end()):
            word = d[0].lower()
            out.append((last, d.end(), "+" if word in ("plus", "+") else DIGIT_WORDS.get(word, word)))
            last = d.end()
    return out


class Mapped:
    """A text with, for each of its characters, the source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def apply(self, rewrites: list[Rewrite]) -> None:
        if not rewrites:
            return
        text, starts, ends, new, at = [], [], [], bytearray(), 0
        for s, e, put in rewrites:
            if s < at:
                continue
            text.append(self.text[at:s])
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            new += self.new[at:s]
            text.append(put)
            starts += [self.starts[s]] * len(put)
            ends += [self.ends[e - 1]] * len(put)
            new += b"\1" * len(put)
            at = e
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        new += self.new[at:]
        self.text, self.starts, self.ends, self.new = "".join(text), starts, ends, new


def disguised(text: str) -> bool:
    """Whether any transducer could rewrite something; cheap substring tests only."""
    if not text.isascii() and characters()[1].search(text):
        return True
    low = text.lower()
    if ("dot" in low or "." in low) and (" dot " in low or BRACKETED.search(text) or SPOKEN_DOT.search(text)):
        return True
    if "." in low and SPOKEN_AT.search(low):
        return True
    return DIGIT_PAIR.search(low) is not None and DIGIT_RUN.search(text) is not None


def transduce(text: str) -> Mapped:
    out = Mapped(text)
    out.apply(character_rewrites(out.text))
    out.apply(bracket_rewrites(out.text))
    out.apply(spoken_rewrites(out.text, out.new))
    out.apply(digit_rewrites(out.text))
    return out


def hidden(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the transduced text shows, as spans of the source."""
    if not disguised(text):
        return []
    out = transduce(text)
    # Plain finds by start, with the furthest end so far: a find lies within one if that end reaches its own.
    taken = sorted((s, e) for s, e, _ in base)
    begins, reach, found = [s for s, _ in taken], list(accumulate((e for _, e in taken), max)), []
    for start, end, kind in plain(out.text):
        if not any(out.new[start:end]):
            # A deleted character inside also counts as rewritten.
            if out.ends[end - 1] - out.starts[start] == end - start:
                continue
        s, e = out.starts[start], out.ends[end - 1]
        before = bisect_right(begins, s)
        if not before or reach[before - 1] < e:
            found.append((s, e, kind))
    return found


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, base (plain spans), spans (all), as `kind:start:end` joined by commas, and counts.

    n_email, n_ip, n_card and n_phone count plain finds, n_hidden those that the transducers add.
    Null text is empty; it and any text without finds give empty strings and zeros. Repeated rows
    give repeated results, ids may be null, other columns are not read, an empty table gives none.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                t = t.as_py()
                base = plain(t)
                more = hidden(t, base)
                kinds = [k for _, _, k in base]
                rows.append((joined(base), joined(base + more), *map(kinds.count, KINDS), len(more)))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(c, pa.string()) for c in columns[:2]]
                + [pa.array(c, pa.int64()) for c in columns[2:]],
                names=["doc_id", "base", "spans", *(f"n_{k}" for k in KINDS), "n_hidden"],
            )

    counts = ", ".join(f"n_{k} long" for k in (*KINDS, "hidden"))
    return id_and_text(docs, key, text).mapInArrow(scan, f"doc_id long, base string, spans string, {counts}")


def masked(text: str) -> str:
    """The text with every find, plain or hidden, replaced by its kind in brackets."""
    base = plain(text)
    spans = sorted(base + hidden(text, base))
    out, at = [], 0
    for s, e, kind in spans:
        if s < at:
            at = max(at, e)
            continue
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]]) if out else text


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in `text` replaced; null text stays null."""

    @F.pandas_udf("string")
    def mask(column: pd.Series) -> pd.Series:
        return column.map(lambda t: masked(t) if t is not None else None)

    return docs.withColumn(text, mask(F.col(text)))
