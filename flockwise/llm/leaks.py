"""Passages of held-out items inside a corpus, by pigeonhole pieces and bit-parallel edit distance.

Both sides become plain words (encoding damage undone, markup, invisible characters, accents and case removed). Of a
window of L passage words at most L // 6 may be wrong, so, cut into budget + 1 pieces, one piece is intact: every
qualifying window has an intact run of at least four words. All runs of four passage words are the pieces.

The documents are read once, however many passages there are. Each task looks its runs of four words up in a filter of
the pieces, a bit table of bounded size that is sent to all executors; an error spoils at most four runs, so a
qualifying window has three pieces within LEAST_SPAN words, and only what stands around three such hits is kept. These
stretches meet the pieces in a hashed join, and the pairs of stretch and passage with three hits or more are verified
with Myers' bit-parallel algorithm, words being its symbols. A full filter lets more stretches through and loses none.
"""

from __future__ import annotations

import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.llm.garbled import restored
from flockwise.session import checkpoint_dir
from flockwise.sources.tables import spread

PIECE = 4
MIN_WORDS = 15
#: One wrong word in so many.
ERRORS_IN = 6
#: Places by which words of a window may be shifted against the piece that was hit.
SLIP = 6
#: Pieces of a qualifying window that are found within so many words, at least.
LEAST_HITS, LEAST_SPAN = 3, 24
#: Bits of the filter for each piece, and bits of the filter at most (32 MB).
PIECE_BITS, FILTER_BITS = 32, 1 << 28
#: Bits of the filter that are built together, and words a task keeps the numbers of.
_SLICE_BITS, _KEPT_WORDS = 1 << 19, 500_000
_INVISIBLE = re.compile("[\xad͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_BREAK_TAG = re.compile(r"<\s*+/?\s*+(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|blockquote|hr|table)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_HYPHENATED = re.compile(r"[-‐‑](?<=\w.)\s*\n[\s>*|#]*(?=\w)")
_COUNTER = re.compile(r"(?<!\S)\(?\d{1,3}/\d{1,3}\)?(?!\S)")
_QUOTE = re.compile(r"\n[ \t]*(?:[>|*#+-]+[ \t]*)+")
_QUOTES = "'’ʼ`´‘′"
_APOSTROPHE = re.compile(f"[{_QUOTES}](?<=\\w.)(?=\\w)")
_WORD = re.compile("[a-z0-9]+")
#: Letters that don't decompose, and what they are taken for.
_PLAIN = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "�": ""}


_BEYOND = re.compile(r"[^\x00-\x7f]+")
_INVISIBLES = frozenset(chr(n) for n in range(0x80, 0x10000) if _INVISIBLE.match(chr(n)))


def _seen(text: str) -> str:
    """The text, restored, without characters that can't be seen."""
    text = restored(text)[0]
    return text if _INVISIBLES.isdisjoint("".join(_BEYOND.findall(text))) else _INVISIBLE.sub("", text)


class _PlainRuns(dict):
    """A run of characters beyond ASCII, decomposed and in lower case -> what is left of it."""

    def __missing__(self, run: str) -> str:
        if len(self) >= 50_000:
            self.clear()
        self[run] = out = "".join("" if unicodedata.combining(c) else _PLAIN.get(c, "'" if c in _QUOTES else " ") for c in run)
        return out


_plain_runs = _PlainRuns()


def _without_comments(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out.append(text[at:a])
        at = b + 3
    return "".join(out) + text[at:] if out else text


def plain_words(text: str | None) -> list[str]:
    """The words of a text as lower-case ASCII letters and digits; a lost character inside a word is left out."""
    if not text:
        return []
    if not text.isascii():
        text = _seen(text)
    if "&" in text:
        fixed = html.unescape(text)
        text = _seen(fixed) if fixed != text and not fixed.isascii() else fixed
    if "<" in text:
        text = _TAG.sub("", _BREAK_TAG.sub(" ", _without_comments(text)))
    if "\n" in text:
        text = _HYPHENATED.sub("", text)
    text = _QUOTE.sub("\n ", "\n" + text)
    if "/" in text:
        text = _COUNTER.sub(" ", text)
    if text.isascii():
        text = text.lower()
    else:
        text = _BEYOND.sub(lambda m: _plain_runs[m[0]], unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall(_APOSTROPHE.sub("", text.replace("*", "").replace("_", "")))


def lossy_words(text: str | None) -> list[str]:
    """The same words, written without the letters beyond ASCII, as they are left when those are lost."""
    text = _APOSTROPHE.sub("", unicodedata.normalize("NFC", _INVISIBLE.sub("", text or ""))).casefold()
    return [re.sub("[^a-z0-9]", "", w) for w in re.findall(r"[^\W_]+", text)]


def myers(masks: dict[int, int], length: int, words: list[int], budget: int) -> bool:
    """Whether a pattern of `length` words is within `budget` edits of some stretch of `words` (Myers 1999).

    `masks` maps a word to the bits of its places in the pattern.
    """
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    for w in words:
        eq = masks.get(w, 0)
        x = eq | minus
        d = ((plus + (x & plus)) ^ plus) | x
        h_plus = minus | (full & ~(d | plus))
        h_minus = d & plus
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        if score <= budget:
            return True
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(d | h_plus))
        minus = h_plus & d
    return False


def window_lengths(n: int) -> list[tuple[int, int]]:
    """(window, budget): any window of MIN_WORDS words or more with its share of errors holds one of these."""
    first = MIN_WORDS // ERRORS_IN
    return [(MIN_WORDS, first)] + [(ERRORS_IN * k, k) for k in range(first + 1, n // ERRORS_IN + 1)]


def holds(text: list[int], words: list[int], diagonals: list[int]) -> bool:
    """Whether a qualifying window of a passage lies in the words, near the diagonals (place in words less place in passage, by fours).

    A window can only qualify if enough of its words stand within SLIP places of the diagonal; that count is
    necessary, cheap and leaves few windows to verify.
    """
    n = len(text)
    lengths = [x for x in window_lengths(n) if x[0] <= n]
    for diagonal in sorted(diagonals):
        place = diagonal * 4
        low = place - SLIP
        sums = [0]
        for j, w in enumerate(text):
            a = low + j
            sums.append(sums[-1] + (w in words[a if a > 0 else 0 : max(0, a + 2 * SLIP + 4)]))
        if sums[n] < MIN_WORDS - MIN_WORDS // ERRORS_IN:
            continue
        for length, budget in lengths:
            for start in range(n - length + 1):
                if sums[start + length] - sums[start] < length - budget:
                    continue
                masks: dict[int, int] = {}
                for b, w in enumerate(text[start : start + length]):
                    masks[w] = masks.get(w, 0) | 1 << b
                at = place + start
                if myers(masks, length, words[max(0, at - 2 * SLIP) : max(0, at + length + 2 * SLIP + 4)], budget):
                    return True
    return False


class _Numbers(dict):
    """Word -> its number, a hash; starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word)
        return n


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def piece_numbers(words: np.ndarray) -> np.ndarray:
    """A number for each run of PIECE words, from the words' numbers."""
    n = max(0, len(words) - PIECE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(PIECE):
        x = (words[k : k + n] ^ (words[k : k + n] >> np.uint64(29))) * _FACTORS[k]
        out += x ^ (x >> np.uint64(32))
    return out


def _slots(pieces: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each piece in a table of a power of two of bits."""
    mask = np.uint64(bits - 1)
    return (pieces & mask).astype(np.int64), ((pieces * _FACTORS[0]) >> np.uint64(20) & mask).astype(np.int64)


def _in_table(table: np.ndarray, pieces: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(pieces), bool)
    for at in _slots(pieces, bits):
        found &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, words, lossy) of each passage of MIN_WORDS words or more."""
    number = _Numbers()
    for batch in batches:
        at, plain, lossy = [], [], []
        for n, text in enumerate(batch.column(1).to_pylist()):
            words = plain_words(text)
            if len(words) < MIN_WORDS:
                continue
            own = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
            left = lossy_words(text)
            same = len(left) == len(words)
            other = np.array([number[w] if w else int(o) for w, o in zip(left, own)], np.uint64) if same else own
            at.append(n), plain.append(own.tobytes()), lossy.append(other.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(plain, pa.binary()), pa.array(lossy, pa.binary())],
            names=["p", "plain", "lossy"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, h, k): the number and the place of each piece, with any of its words spelled either way."""
    for batch in batches:
        for n in range(batch.num_rows):
            plain, lossy = (np.frombuffer(batch.column(c)[n].as_py(), np.uint64) for c in (1, 2))
            found = {(int(h), k) for k, h in enumerate(piece_numbers(plain))}
            for k in sorted({k for j in np.nonzero(plain != lossy)[0].tolist() for k in range(max(0, j - PIECE + 1), min(j, len(plain) - PIECE) + 1)}):
                ways = [(plain[j], lossy[j]) if plain[j] != lossy[j] else (plain[j],) for j in range(k, k + PIECE)]
                found |= {(int(piece_numbers(np.array(way, np.uint64))[0]), k) for way in itertools.product(*ways)}
            h, k = zip(*sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[n].as_py()] * len(h), pa.string()), pa.array(np.array(h, np.uint64).view(np.int64)),
                pa.array(k, pa.int32())], names=["p", "h", "k"])


def _filter(pieces: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """The bit table of all pieces and its bits: built by slices in tasks; to the driver come at most `most_bits`."""
    n = pieces.count()
    bits = min(most_bits, max(1 << 10, 1 << (n * PIECE_BITS - 1).bit_length()))
    width = min(bits, _SLICE_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32))], names=["slice", "at"])

    def packed(table: pa.Table) -> pa.Table:
        flags = np.zeros(width, np.uint8)
        flags[table["at"].to_numpy()] = 1
        return pa.table({"slice": table["slice"][:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    # a slice has at most `width` places, so a group is bounded
    slices = pieces.select("h").mapInArrow(places, "slice int, at int").distinct().groupBy("slice").applyInArrow(packed, "slice int, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for r in slices.collect():
        table[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = np.frombuffer(r["bits"], np.uint8)
    return table, bits


def _stretches(hits: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> Iterator[tuple[int, int, int]]:
    """(document, from, to) of what stands within `reach` words of three hits that are near each other.

    `hits` are places in the words of all documents; a document's words are those from `first` to `last`.
    """
    doc = np.searchsorted(first, hits, side="right") - 1
    near = np.nonzero((hits[LEAST_HITS - 1 :] - hits[: 1 - LEAST_HITS] <= LEAST_SPAN) & (doc[LEAST_HITS - 1 :] == doc[: 1 - LEAST_HITS]))[0]
    now: tuple[int, int, int] | None = None
    for n in near.tolist():
        d = int(doc[n])
        a, b = max(int(first[d]), int(hits[n]) - reach), min(int(last[d]), int(hits[n + LEAST_HITS - 1]) + PIECE + reach)
        if now and now[0] == d and a <= now[2]:
            now = (d, now[1], b)
            continue
        if now:
            yield now
        now = (d, a, b)
    if now:
        yield now


def _searched(table: np.ndarray, bits: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = [plain_words(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                last = np.cumsum(sizes)
                first = last - sizes
                words = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.uint64, int(last[-1]))
                numbers = piece_numbers(words)
                inside = np.repeat(last, sizes)[: len(numbers)] - np.arange(len(numbers)) >= PIECE
                hits = np.nonzero(inside & _in_table(table, numbers, bits))[0]
                rows, name, held, pieces, places = [], [], [], [], []
                for d, a, b in _stretches(hits, first, last, reach) if len(hits) >= LEAST_HITS else ():
                    own = hits[np.searchsorted(hits, a) : np.searchsorted(hits, b - PIECE, side="right")]
                    raw = words[a:b].tobytes()
                    rows.append(d), name.append(xxhash.xxh3_128_hexdigest(raw)), held.append(raw)
                    pieces.append(numbers[own].view(np.int64)), places.append((own - a).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(name, pa.string()), pa.array(held, pa.binary()),
                        pa.array(pieces, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                    names=["key", "f", "words", "h", "at"],
                )

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for n in range(batch.num_rows):
            words, plain, lossy = (np.frombuffer(batch.column(c)[n].as_py(), np.uint64).tolist() for c in (2, 3, 4))
            either = {b: a for a, b in zip(plain, lossy) if a != b}
            for a in plain:  # a word of the passage is itself first
                either.pop(a, None)
            if holds(plain, [either.get(w, w) for w in words] if either else words, batch.column(5)[n].as_py()):
                kept.append(n)
        take = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["f", "p"])


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(key, item) of each document that holds at least 15 consecutive passage words with at most one in six wrong.

    One narrow pass over the documents, with a filter of at most `filter_bits` bits (a power of two); what is shuffled
    are the passages and the stretches of documents around hits, equal stretches once. 13 words in a row also count,
    as a window whose last two are dropped. Null, empty and short texts and passages of fewer than 15 words give no
    case; items that share a passage come out each; a null key is kept, a null item isn't. The stretches found are
    written to the checkpoint folder.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    held = items.where(F.col(passage).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"),
        F.col(passage).alias("t")).withColumn("p", F.md5(F.encode("t", "UTF-8")))
    passages = held.groupBy("p").agg(F.first("t").alias("t")).select("p", "t").mapInArrow(_indexed, "p string, plain binary, lossy binary").checkpoint()
    pieces = passages.mapInArrow(_pieces, "p string, h long, k int")
    longest = passages.agg(F.coalesce(F.max(F.octet_length("plain")), F.lit(0)).alias("n")).first()["n"] // 8
    table, bits = _filter(pieces, filter_bits)
    sent = spark.sparkContext.broadcast(table)
    reach = longest + longest // ERRORS_IN + 4 * SLIP

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _searched(sent.value, bits, reach)(batches)

    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0))
    found = rows.mapInArrow(search, f"key {kind}, f string, words binary, h array<long>, at array<int>").checkpoint()
    stretches = found.groupBy("f").agg(F.first("words").alias("words"), F.first(F.arrays_zip("h", "at")).alias("hits"))
    hits = stretches.select("f", F.explode("hits").alias("x")).select("f", "x.h", "x.at")
    met = hits.join(pieces, "h").groupBy("f", "p").agg(F.count("*").alias("n"),
        F.collect_set(F.floor((F.col("at") - F.col("k")) / 4).cast("int")).alias("diagonals")).where(F.col("n") >= LEAST_HITS)
    pairs = met.join(stretches.select("f", "words"), "f").join(passages, "p").select("f", "p", "words", "plain", "lossy", "diagonals")
    leaked = pairs.mapInArrow(_verified, "f string, p string")
    out = found.select("key", "f").join(leaked, "f").join(held.select("p", "i"), "p")
    return out.select(F.col("key").alias(key), F.col("i").alias(item)).distinct()
