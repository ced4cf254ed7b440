"""Text that was decoded with a wrong encoding: finding it, and restoring it by round trips.

A stretch is encoded again under a candidate legacy encoding and decoded strictly as the encoding it was written in,
mostly UTF-8. The result is accepted when a garbling cost drops, and the round trip is repeated for nested layers. The
cost of a character says how unusual it is in written language, with a surcharge for letter cases that don't go
together. Text that was put in lower or upper case after the damage is met by reading lead bytes in the other case.
Damage that can't be undone (replacement characters) is reported and left as it is; what stands between is restored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.sources.tables import spread

#: Encodings that UTF-8 text is often read in, most frequent first; the first also stands for Latin-1.
WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp866", "cp1251", "koi8_r", "cp1250", "cp1254", "iso8859_2", "cp1253")
#: (read as, written in, least drop) of texts of one byte a letter; the drop adds up over the words of a text.
SINGLE = (
    ("mac_roman", "cp1252", 1.5), ("cp437", "cp1252", 1.5), ("cp850", "cp1252", 1.5), ("cp1250", "cp1252", 1.0), ("iso8859_2", "cp1252", 1.0),
        ("cp1251", "cp1252", 1.5), ("cp1253", "cp1252", 1.5),
    ("cp1252", "iso8859_2", 2.0), ("cp1252", "cp1250", 2.0), ("cp1252", "mac_roman", 2.0), ("cp1252", "cp437", 2.0), ("cp1252", "cp850", 2.0),
    ("cp1252", "cp1251", 3.0), ("cp1252", "koi8_r", 3.0), ("cp1252", "cp866", 3.0), ("cp1251", "koi8_r", 3.0), ("koi8_r", "cp1251", 3.0),
        ("cp866", "cp1251", 3.0), ("cp1251", "cp866", 3.0), ("koi8_r", "cp866", 3.0), ("mac_roman", "cp1251", 3.0),
)
#: Letters beyond ASCII of the languages texts are expected in and of their neighbours.
LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœąćęłńśźż"
#: Cost of Russian letters, by how frequent they are.
RUSSIAN = {c: cost for letters, cost in (("оеаин", 0.6), ("тсрвлкмдпу", 0.8), ("яыьгзбчй", 1.1), ("хжшюцщэфъё", 1.6)) for c in letters}
#: Signs that often end a word, so that they follow a letter in sound text too.
CLOSING = "“”‘’…–—«»„‚‹›°ºª™®"
_SEQUENCE = "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}"
_UTF8 = re.compile(f"(?:{_SEQUENCE})+")
_LOWERED = re.compile(f"(?:{_SEQUENCE}|[\xe2-\xff][\x80-\xbf](?![\x80-\xbf]))+")
_RAISED = re.compile(f"(?:[\xc1-\xcf][\x80-\xbf]{{2}}|[\xd0-\xd4][\x80-\xbf]{{3}}|{_SEQUENCE})+")
_ONE_LOWERED = re.compile(f"({_SEQUENCE})|([\xe2-\xff])([\x80-\xbf])")
_ONE_RAISED = re.compile(f"([\xc1-\xd4])([\x80-\xbf]{{2,3}})|({_SEQUENCE})")
_HIGH = re.compile(r"[^\x00-\x7f]{2,}")
#: Two-byte letters whose second byte was a kind of blank or hyphen and has been replaced or dropped since.
_STRIPPED = ((re.compile(r"(?<![A-ZÀ-Þ])Ã (?=[a-zà-ÿ])"), "à "), (re.compile(r"(?<=[a-z])Ã(?=[a-z])"), "í"))
_FAR = "Ā"


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[int, str]:
    """Code point -> the character whose number is its byte; what the encoding lacks becomes a character beyond bytes."""
    table = {}
    for b in range(0x80, 0x100):
        if encoding == "cp1252":
            table[b] = chr(b)
        try:
            table[ord(bytes([b]).decode(encoding))] = chr(b)
        except UnicodeDecodeError:
            table.setdefault(b, chr(b))
    return table


class _Table(dict):
    def __missing__(self, point: int) -> str | int:
        self[point] = value = point if point < 0x80 else _FAR
        return value


_TABLES = {e: _Table(_bytes_of(e)) for e in WRONG}


@lru_cache(maxsize=65536)
def _char_cost(c: str) -> float:
    n = ord(c)
    if n < 0x80:
        return 0.0 if n >= 32 or c in "\t\n\r" else 2.0
    if n < 0xA0:
        return 4.0
    if c.lower() in LATIN:
        return 1.0
    if n < 0x100:
        return 1.5 if c in "\xa0\xad«»¡¿·°§" else 2.0
    if n < 0x180:
        return 2.0
    if 0x300 <= n < 0x370:
        return 1.0
    if 0x370 <= n < 0x400:
        return 1.5 if 0x391 <= n <= 0x3C9 else 3.0
    if 0x400 <= n < 0x530:
        if not (0x410 <= n <= 0x44F or c in "Ёё"):
            return 2.5
        return RUSSIAN[c.lower()] + (0.2 if c.isupper() else 0.0)
    if 0x2000 <= n < 0x2070 or c == "€":
        return 1.0 if c not in "†‡‰‹›" else 2.0
    if 0x2190 <= n < 0x2500 or 0x2070 <= n < 0x2190:
        return 2.0
    if 0x2500 <= n < 0x25A0:
        return 2.5
    if 0x25A0 <= n < 0x2800 or 0xFE00 <= n < 0xFE10:
        return 1.0
    if 0x3000 <= n < 0x3100 or 0x4E00 <= n < 0xA000 or 0xFF00 <= n < 0xFFF0 or 0x1F000 <= n < 0x1FB00:
        return 1.0
    if n == 0xFFFD or unicodedata.category(c) in ("Co", "Cn", "Cs"):
        return 5.0
    return 3.0


@lru_cache(maxsize=65536)
def garbling_cost(text: str, before: str = "") -> float:
    """How unlike written language the text is; 0 for ASCII, about 1 for each usual other character."""
    cost, last, sign = 0.0, before, False
    for c in text:
        if c >= "\x80":
            cost += _char_cost(c)
            if c.isupper() and last.islower():
                cost += 1.5
            if "\xc0" <= c <= "\xff" and "\xc0" <= last <= "\xff":
                cost += 0.5
        if c >= "\x80" or last >= "\x80":
            if last >= "\x80" and c < "\x80" and c.isupper() and last.islower():
                cost += 1.0
            if c.isalpha() and last.isalpha() and _script(c) != _script(last):
                cost += 1.0
            if sign and c.isalpha():
                cost += 1.0
        sign = c >= "\x80" and c not in "\xa0\xad" and last.isalpha() and not c.isalpha() and _char_cost(c) >= 1.5
        last = c
    return cost


def _script(c: str) -> int:
    n = ord(c)
    return 0 if n < 0x250 else 1 if n < 0x400 else 2 if n < 0x530 else 3


def _utf8(s: str) -> str | None:
    try:
        return s.encode("latin-1").decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return None


def _lowered(s: str) -> str | None:
    fixed = _utf8(_ONE_LOWERED.sub(lambda m: m[1] or chr(ord(m[2]) - 0x20) + m[3], s))
    return fixed and fixed.lower()


def _raised(s: str) -> str | None:
    return _utf8(_ONE_RAISED.sub(lambda m: chr(ord(m[1]) + 0x20) + m[2] if m[1] else m[3], s))


def _ambiguous(text: str, a: int, b: int, case: str) -> bool:
    """Whether the stretch may as well be a letter and the sign that closes its word."""
    if b - a != 2 or text[b - 1] not in CLOSING or (b < len(text) and text[b].isalpha()):
        return False
    return case != "as is" or (a > 0 and text[a - 1].isupper()) or (a > 0 and not text[a - 1].isalpha() and text[a].isupper() and text[b - 1] in "»”’")


_SOUND = re.compile("[А-яЁё]+")
_BOXES = re.compile("[\u2500-\u259f]+")


def _drawn(text: str, a: int, b: int, fixed: str) -> bool:
    """Whether a stretch of box characters is part of a drawing."""
    if not _BOXES.fullmatch(text, a, b):
        return False
    beside = text[max(0, a - 1) : a] + text[b : b + 1]
    return bool(_BOXES.search(beside)) or any(_char_cost(c) > 1.5 for c in fixed)


def _replaced(text: str, seen: str, pattern: re.Pattern, decode, case: str) -> tuple[str, float]:
    """The text after one round trip of every stretch whose cost drops, and the whole drop."""
    out, at, drop, doubtful = [], 0, 0.0, []
    for m in pattern.finditer(seen):
        a, b = m.span()
        fixed = None if _SOUND.fullmatch(text, a, b) else decode(m[0])
        if fixed is None or _drawn(text, a, b, fixed):
            continue
        last = text[a - 1] if a else ""
        after = text[b] if b < len(text) and text[b].isupper() else ""
        less = garbling_cost(text[a:b] + after, last) - garbling_cost(fixed + after, last)
        if less < 1:
            continue
        if _ambiguous(text, a, b, case):
            doubtful.append(less)
        else:
            drop += less
        out += (text[at:a], fixed)
        at = b
    if not drop:
        return text, 0.0
    return "".join(out) + text[at:], drop + sum(doubtful)


def _written_in(encoding: str):
    def decode(run: str) -> str | None:
        try:
            return run.encode("latin-1").decode(encoding)
        except (UnicodeDecodeError, UnicodeEncodeError):
            return None

    return decode


#: (read as, written in, what a run of it looks like in bytes) of text of two bytes a letter.
_DOUBLE = [
    ("cp1252", "shift_jis", re.compile("(?:[\x81-\x9f\xe0-\xef][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]){5,}")),
    ("cp1252", "euc_jp", re.compile("(?:[\xa1-\xfe][\xa1-\xfe]){4,}")),
]
_LATIN_RUN = re.compile("[\x80-\xff\u0152-\u02dc\u2013-\u2122][^\\s]{0,2}[\x80-\xff\u0152-\u02dc\u2013-\u2122][^\\s]{0,2}[\x80-\xff\u0152-\u02dc\u2013-\u2122][^\\s]{0,2}[\x80-\xff\u0152-\u02dc\u2013-\u2122]")
_WRITTEN_IN = {e: _written_in(e) for _, e, _ in _DOUBLE}
_WORDS = re.compile(r"[^\s]+")
#: Something that sound words don't have: letters of other alphabets, signs or capitals inside, lone signs of drawing.
_ODD = re.compile(
    "[a-zà-öø-ÿœąćęłńśźż][À-ÖØ-Þ]|[à-öø-ÿ][A-Z]|[A-Za-zÀ-ÿ][\u0370-\u052f]|[\u0370-\u052f][A-Za-zÀ-ÿ]|[а-яё][А-ЯЁ]|[À-ÿ]{4}"
    "|[A-Za-zÀ-ÿ][^\\w\\s\x00-\x7f“”‘’…–—«»„‚‹›·•\u0300-\u036f\u200b-\u200f\xad\xa0\ufffd\ufe00-\ufe0f\U0001f000-\U0001ffff]|[^\\w\\s\x00-\x7f“”‘’…–—«»„‹›¿¡€•\u0300-\u036f\u200b-\u200f\xad\xa0\ufffd\U0001f000-\U0001ffff][A-Za-zÀ-ÿ]|[\x80-\x9f\u207f"
    + "".join(chr(n) for n in range(0x100, 0x250) if chr(n).lower() not in LATIN)
    + "]"
)


@lru_cache(maxsize=None)
def _swaps(wrong: str, intended: str) -> dict[int, str]:
    """Code point as read -> character as written, where they differ."""
    out = {}
    for point, byte in _bytes_of(wrong).items():
        try:
            c = byte.encode("latin-1").decode(intended)
        except UnicodeDecodeError:
            continue
        if ord(c) != point and point not in (0xA0, 0xAD):
            out[point] = c
    return out


#: Words that may have been read in another one-byte encoding: (start, end, word, its cost), by line.
_Lines = list[list[tuple[int, int, str, float]]]


def _candidates(text: str) -> _Lines:
    """The words of each line that hold other characters than ASCII, but for drawings and words of one letter.

    A word with a lost character keeps its rest, which is the remains of longer sequences mostly.
    """
    out: _Lines = []
    at = 0
    for line in text.split("\n"):
        if not line.isascii():
            words = [(at + m.start(), at + m.end(), m[0]) for m in _WORDS.finditer(line) if not m[0].isascii()]
            out.append([(a, b, w, garbling_cost(w)) for a, b, w in words if "�" not in w and sum(map(str.isalpha, w)) >= 2 and not _DRAWING.search(w)])
        at += len(line) + 1
    return out


def _single(text: str, lines: _Lines, wrong: str, intended: str) -> tuple[str, float]:
    """The text with the words whose cost drops read in the other encoding, and the whole drop.

    A line in which that happens also has those of its words changed that cost the same.
    """
    swaps = _swaps(wrong, intended)
    changes, whole = [], 0.0
    for words in lines:
        changed, drop = [], 0.0
        for a, b, word, cost in words:
            fixed = word.translate(swaps)
            if fixed == word:
                continue
            less = cost - garbling_cost(fixed)
            if less >= 1:
                drop += less
                changed.append((a, b, fixed))
            elif less >= 0 and not any(c in CLOSING for c in word):
                changed.append((a, b, fixed))
        if drop:
            whole += drop
            changes += changed
    if not changes:
        return text, 0.0
    out, at = [], 0
    for a, b, fixed in changes:
        out += (text[at:a], fixed)
        at = b
    return "".join(out) + text[at:], whole


_DRAWING = re.compile("[\u2500-\u259f]{2}")


@lru_cache(maxsize=1)
def _starts() -> dict[str, int]:
    """Two characters that begin a UTF-8 sequence in some encoding -> bits of those encodings; plain Cyrillic is none."""
    out: dict[str, int] = {}
    for bit, encoding in enumerate(WRONG):
        by: dict[int, list[str]] = {}
        for point, byte in _bytes_of(encoding).items():
            by.setdefault(ord(byte) >> 6, []).append(chr(point))
        for a in by.get(3, ()):
            for b in by.get(2, ()):
                if not _SOUND.fullmatch(a + b):
                    out[a + b] = out.get(a + b, 0) | 1 << bit
    return out


@lru_cache(maxsize=65536)
def _possible_in(run: str) -> int:
    starts, bits = _starts(), 0
    for n in range(len(run) - 1):
        bits |= starts.get(run[n : n + 2], 0)
    return bits


def _possible(runs: frozenset[str]) -> int:
    """Bits of the encodings in which a text with these runs of characters beyond ASCII may be UTF-8 in places."""
    bits = 0
    for run in runs:
        bits |= _possible_in(run)
    return bits


@lru_cache(maxsize=65536)
def _may_be_utf8(run: str, encoding: str) -> bool:
    """Whether some stretch of the run, read in the encoding, has the bytes of UTF-8 in either case."""
    seen = run.translate(_TABLES[encoding])
    patterns = (_UTF8, _LOWERED, _RAISED) if encoding == "cp1252" else (_UTF8,)
    return any(p.search(seen) for p in patterns)


def _round_trips(text: str) -> Iterator[tuple[str, float, str, float]]:
    """(name, least drop to accept, text after the round trip, drop) of each candidate."""
    runs = frozenset(_HIGH.findall(text))
    done, possible = False, _possible(runs)
    for bit, encoding in enumerate(WRONG):
        if not possible >> bit & 1 or not any(_may_be_utf8(run, encoding) for run in runs):
            continue
        seen = text.translate(_TABLES[encoding])
        least = 1.0 if encoding in ("cp1252", "cp437", "cp850") else 2.0
        fixed, drop = _replaced(text, seen, _UTF8, _utf8, "as is")
        done |= drop >= least
        yield encoding, least, fixed, drop
        if encoding == "cp1252" and drop < least:
            fixed, drop = _replaced(text, seen, _LOWERED, _lowered, "lower")
            done |= drop >= least
            yield encoding, least, fixed, drop
            if text.isupper():
                yield encoding, 2 * least, *_replaced(text, seen, _RAISED, _raised, "upper")
    if done:  # other readings only of what is not UTF-8
        return
    for encoding, intended, runs in _DOUBLE if _LATIN_RUN.search(text) else ():
        yield encoding + intended, 3.0, *_replaced(text, text.translate(_TABLES[encoding]), runs, _WRITTEN_IN[intended], "as is")
    if _odd(text):
        lines = _candidates(text)
        for wrong, intended, least in SINGLE:
            yield wrong + intended, least, *_single(text, lines, wrong, intended)


_BEYOND = re.compile(r"[^\x00-\x7f]+")


def _odd(text: str) -> bool:
    """Whether the text has something that sound words don't have; only characters beyond ASCII and those beside them tell."""
    beside = {text[max(0, m.start() - 1) : m.end() + 1] for m in _BEYOND.finditer(text)}
    return bool(beside) and _ODD.search("\n".join(beside)) is not None


def _undone(text: str) -> tuple[str, int]:
    """The text after as many round trips as lower its cost, the best of each layer first; their number.

    There is no bound on the layers: undoing one of several bytes a letter shortens the text, and a reading that
    doesn't is taken once, so it comes to an end.
    """
    layers, used = 0, set()
    while _HIGH.search(text) or _odd(text):
        tried = [(drop, fixed, name) for name, least, fixed, drop in _round_trips(text) if drop >= least and (len(fixed) < len(text) or name not in used)]
        if not tried:
            break
        _, fixed, name = max(tried, key=lambda x: x[0])
        if len(fixed) >= len(text):
            used.add(name)
        text, layers = fixed, layers + 1
    return text, layers


def _lines(text: str) -> list[str]:
    *whole, last = text.split("\n")
    return [*(x + "\n" for x in whole), last]


def restored(text: str | None) -> tuple[str | None, int, bool]:
    """(text with its garbled stretches restored, layers undone, whether garbled characters remain).

    Null and empty texts are as they are. References to characters are resolved first only to look for damage: sound
    text with references isn't changed. The text comes back as it was if no round trip lowers its cost.
    """
    if not text or text.isascii() and "&" not in text:
        return text, 0, False
    lost = "�" in text or "&#65533;" in text
    now = text
    if "&" in text and (resolved := html.unescape(text)) != text:
        now = resolved
    layers = 0
    if not now.isascii():
        if not unicodedata.is_normalized("NFC", now) and re.search("[AaIiOo]\u0303|[AaOo]\u0302|\u0308|\u030a", now):
            now = unicodedata.normalize("NFC", now)
        now, layers = _undone(now)
        for pattern, sound in _STRIPPED if "Ã" in now else ():
            if pattern.search(now):
                now, layers = pattern.sub(sound, now), max(layers, 1)
        parts = [_undone(x) if x.isupper() and not x.isascii() else (x, 0) for x in _lines(now)] if not text.isupper() else []
        if any(n for _, n in parts):
            now, layers = "".join(x for x, _ in parts), max(layers, *(n for _, n in parts))
    remains = lost or bool(re.search("[\x80-\x84\x86-\x9f]", now))
    return (now, layers, remains) if layers else (text, 0, remains)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        kept, fixed, layers, left = [], [], [], []
        for i, text in enumerate(texts):
            now, n, remains = restored(text)
            if n or remains:
                kept.append(i)
                fixed.append(now)
                layers.append(n)
                left.append(remains)
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept, pa.int64())), pa.array(fixed, pa.string()), pa.array(layers, pa.int32()),
            pa.array(left, pa.bool_())], names=["key", "text", "layers", "remains"])


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, layers, remains) of the rows whose text is garbled; other rows are left out.

    `layers` counts the round trips undone, `remains` says that characters are lost or garbled still. One narrow pass:
    no shuffle but of a table with fewer splits than cores, and nothing is kept but the batch in work. Copies of a row are told apart by nothing and all come out.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    out = spread(rows).mapInArrow(_run, f"key {kind}, text string, layers int, remains boolean")
    return out.select(F.col("key").alias(key), F.col("text").alias("restored"), "layers", "remains")
