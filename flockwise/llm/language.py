"""The language of texts and of the one-language segments of mixed texts, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is
the sum over all ways to cut it into pieces, found by the forward algorithm; a sentence's is the product over its
words, so words are scored once and kept in a bounded table per task; a sum goes over the whole word, however long. The piece probabilities are fitted here by
expectation-maximisation (forward and backward sums) on a bounded sample of labelled rows; as labels may be wrong,
the sample's sentences are labelled again by the fitted model and fitted once more.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwise.functions.aggregates import top_k

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "pl", "ru", "ja")
#: Other codes of these languages (fixed values of ISO 639-2 and -3).
CODES = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it",
    "nld": "nl", "dut": "nl", "swe": "sv", "pol": "pl", "rus": "ru", "jpn": "ja",
}
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Labelled rows per language that the model is fitted on.
SAMPLE_ROWS = 800
#: Words of a whole sentence, and letters where words aren't set apart.
MIN_WORDS, MIN_LETTERS = 4, 8
#: Log odds by which a sentence must prefer another language than its text's main one to be a segment of its own.
MARGIN = 3.0
#: Longest word, in bytes, that the model is fitted on; words of any length are scored.
FIT_WORD_BYTES = 512
#: Words of a batch, and words times bytes of the longest.
_BATCH_WORDS, _BATCH_BYTES = 4000, 400_000
#: Score a byte, below the lowest of a thousand sentences of a language in the sample, under which text is of none; and
#: sentences of a language that tell its lowest.
NONE_MARGIN, NONE_SENTENCES = 0.7, 100
NONE = "und"
#: Words a task keeps scores of.
KEPT_WORDS = 200_000
_BACKGROUND = 0.02
_NOISE = re.compile(r"(?:https?://|www\.)\S+|[@#][^\s.,;:!?]\S*|\[[A-Za-z]{2,3}\]")
_TOKEN = re.compile(r"[぀-ゟ]+|[゠-ヺー-ヿ]+|[㐀-鿿々]+|[^\W\d_぀-ヿ㐀-鿿々]+|[.!?…。！？\n“”«»„‹›|/—]")
_ENDS = frozenset(".!?…。！？\n“”«»„‹›|/—")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿々]")


def label_language(label: Column) -> Column:
    """The two-letter code that a label in any notation names; null for none and for codes not known here."""
    code = F.lower(F.regexp_extract(F.trim(label), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    pairs = [F.lit(x) for kv in CODES.items() for x in kv] + [F.lit(x) for c in LANGUAGES for x in (c, c)]
    return F.element_at(F.create_map(*pairs), F.when(code != "", code))


def tokens_of(text: str) -> list[str]:
    """Lower-case words and sentence ends of a text, without links, handles and tags."""
    text = _NOISE.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _TOKEN.findall(text.lower())


def _sentences(text: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens_of(text):
        if t in _ENDS:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if _long(s)]


def _long(words: list[str]) -> bool:
    return len(words) >= MIN_WORDS or sum(len(w) for w in words if _UNSPACED.match(w)) >= MIN_LETTERS


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


class Pieces(dict):
    """Piece -> number, with the number of every beginning of a piece (-1 if it isn't a piece itself)."""

    def __init__(self, pieces: dict[bytes, int]) -> None:
        super().__init__(pieces)
        self.tree: dict[bytes, int] = {}
        for p, n in pieces.items():
            for k in range(1, len(p)):
                self.tree.setdefault(p[:k], -1)
            self.tree[p] = n

    def __reduce__(self):
        return Pieces, (dict(self),)


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """The public vocabulary: piece -> number, all single bytes among them."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    for b in range(256):
        pieces.setdefault(bytes([b]), max(pieces.values()) + 1)
    return Pieces({p: n for n, p in enumerate(pieces)})


class Lattices:
    """All segmentations of a batch of words of any length, as edges: one for each piece that lies in a word.

    Edges are in order of the place where they end, then of the word, so all words go forward together byte by byte.
    """

    def __init__(self, words: list[str], pieces: dict[bytes, int]) -> None:
        get = (pieces if isinstance(pieces, Pieces) else Pieces(pieces)).tree.get
        raw = [b" " + w.encode("utf-8", "replace") for w in words]
        rows, ends, spans, found = array("i"), array("i"), array("i"), array("i")
        for n, s in enumerate(raw):
            size = len(s)
            for a in range(size):
                for b in range(a + 1, size + 1):
                    p = get(s[a:b])
                    if p is None:
                        break
                    if p >= 0:
                        rows.append(n), ends.append(b), spans.append(b - a), found.append(p)
        self.lengths = np.array([len(s) for s in raw], np.int64)
        self.size = int(self.lengths.max(initial=0))
        rows, ends, spans, found = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (rows, ends, spans, found))
        order = np.lexsort((rows, ends))
        self.rows, self.ends, self.spans, self.found = rows[order], ends[order], spans[order], found[order]
        self.at = np.searchsorted(self.ends, np.arange(self.size + 2))
        self.longest = int(self.spans.max(initial=1))

    @staticmethod
    def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, sum of its values), rows being in order."""
        first = np.concatenate([[0], np.nonzero(np.diff(rows))[0] + 1])
        return rows[first], np.add.reduceat(values, first, axis=0)

    def _forward(self, weights: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all paths of each word; weights: (edges, kinds of weight), scaled as it goes."""
        n, kinds, window = len(self.lengths), weights.shape[1], self.longest + 1
        alpha = np.zeros((n, window, kinds))
        alpha[:, 0] = 1
        scale, out = np.zeros((n, kinds)), np.zeros((n, kinds))
        by_length = np.argsort(self.lengths, kind="stable")
        bounds = np.searchsorted(self.lengths[by_length], np.arange(self.size + 2))
        for e in range(1, self.size + 1):
            a, b = self.at[e], self.at[e + 1]
            alpha[:, e % window] = 0
            if b > a:
                rows, sums = self._summed(self.rows[a:b], alpha[self.rows[a:b], (e - self.spans[a:b]) % window] * weights[a:b])
                alpha[rows, e % window] = sums
            done = by_length[bounds[e] : bounds[e + 1]]
            out[done] = np.log(np.maximum(alpha[done, e % window], 1e-300)) + scale[done]
            if e % 8 == 0:
                top = alpha.max(1)
                top[top <= 0] = 1
                alpha /= top[:, None]
                scale += np.log(top)
        return out

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; probs: (pieces or more, languages)."""
        return self._forward(probs[self.found])

    def expected(self, probs: np.ndarray, language: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language, every word taken in its own language, by weight."""
        n, rows, spans, found, langs = len(self.lengths), self.rows, self.spans, self.found, probs.shape[1]
        own = probs[found, language[rows]]
        # a factor for each byte brings a word's whole probability to one, so that sums of long words stay in range
        rate = -self._forward(own[:, None])[:, 0] / np.maximum(self.lengths, 1)
        own = own * np.exp(rate[rows] * spans)
        alpha, beta = np.zeros((n, self.size + 1)), np.zeros((n, self.size + 1))
        alpha[:, 0] = 1
        beta[np.arange(n), self.lengths] = 1
        for e in range(1, self.size + 1):
            a, b = self.at[e], self.at[e + 1]
            if b > a:
                r, sums = self._summed(rows[a:b], alpha[rows[a:b], e - spans[a:b]] * own[a:b])
                alpha[r, e] = sums
        begins = self.ends - spans
        order = np.lexsort((rows, begins))
        at = np.searchsorted(begins[order], np.arange(self.size + 1))
        for s in range(self.size - 1, -1, -1):
            part = order[at[s] : at[s + 1]]
            if len(part):
                r, sums = self._summed(rows[part], beta[rows[part], s + spans[part]] * own[part])
                beta[r, s] += sums
        whole = np.maximum(alpha[np.arange(n), self.lengths], 1e-300)
        share = alpha[rows, begins] * own * beta[rows, self.ends] * (weight / whole)[rows]
        return np.bincount(found.astype(np.int64) * langs + language[rows], weights=share, minlength=probs.size).reshape(probs.shape)


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities by language; a piece a language lacks is equally unlikely in all that lack it."""
    own = counts[:-1] / np.maximum(counts[:-1].sum(0), 1e-9)
    common = own.mean(1) * 0.9 + 0.1 / len(own)
    probs = np.zeros(counts.shape)
    probs[:-1] = (1 - _BACKGROUND) * own + _BACKGROUND * common[:, None]
    return probs


def _batches(words: list[str]) -> Iterator[list[int]]:
    """Words of about the same length together, by number."""
    sizes = [len(w.encode("utf-8", "replace")) for w in words]
    part: list[int] = []
    for n in sorted(range(len(words)), key=sizes.__getitem__):
        if part and (len(part) >= _BATCH_WORDS or (len(part) + 1) * sizes[n] > _BATCH_BYTES):
            yield part
            part = []
        part.append(n)
    if part:
        yield part


def word_scores(words: list[str], pieces: dict[bytes, int], probs: np.ndarray) -> np.ndarray:
    """(words, languages): log probabilities."""
    out = np.zeros((len(words), probs.shape[1]))
    for part in _batches(words):
        out[part] = Lattices([words[n] for n in part], pieces).forward(probs)
    return out


def fit(texts: list[tuple[str, str]], pieces: dict[bytes, int], rounds: int = 2, steps: int = 3) -> np.ndarray:
    """Piece probabilities (pieces + 1, languages) from (language, text) pairs, some of them labelled wrongly.

    Rounds: fit on the labels, label the sentences anew, fit again. Words also count without their accents, by a
    smaller weight. A language without texts keeps the common distribution.
    """
    number = {c: n for n, c in enumerate(LANGUAGES)}
    sentences = [(number[c], s) for c, t in texts for s in _sentences(t)]
    distinct = sorted({w for _, s in sentences for w in s})
    place = {w: n for n, w in enumerate(distinct)}
    probs = np.full((len(pieces) + 1, len(LANGUAGES)), 1 / len(pieces))
    probs[-1] = 0
    for r in range(rounds):
        pairs: Counter = Counter()
        for c, s in sentences:
            for w in s:
                pairs[c, w] += 1.0
                if not w.isascii() and (bare := _bare(w)) != w:
                    pairs[c, bare] += 0.3
        keys = sorted(k for k in pairs if len(k[1].encode("utf-8", "replace")) < FIT_WORD_BYTES)
        words = [w for _, w in keys]
        lang = np.array([c for c, _ in keys], np.int64)
        weight = np.array([pairs[k] for k in keys])
        parts = [(Lattices([words[n] for n in part], pieces), np.array(part)) for part in _batches(words)]
        for _ in range(steps if r == 0 else steps - 1):
            counts = np.zeros(probs.shape)
            for lattices, part in parts:
                counts += lattices.expected(probs, lang[part], weight[part])
            probs = _smoothed(counts)
        if r + 1 < rounds and sentences:
            scores = word_scores(distinct, pieces, probs)
            sentences = [(int(scores[[place[w] for w in s]].sum(0).argmax()), s) for _, s in sentences]
    return probs


def _sizes(words: list[str]) -> np.ndarray:
    return np.array([len(w.encode("utf-8", "replace")) + 1 for w in words], np.int64)


def floors(texts: list[tuple[str, str]], pieces: dict[bytes, int], probs: np.ndarray) -> np.ndarray:
    """For each language the log probability a byte that text of none of the languages is given.

    It lies below the sentences of the fitted texts. A language with few of them takes the lowest of the others.
    """
    sentences = [s for _, t in texts for s in _sentences(t)]
    distinct = sorted({w for s in sentences for w in s})
    place = {w: n for n, w in enumerate(distinct)}
    scores, sizes = word_scores(distinct, pieces, probs), _sizes(distinct)
    held: dict[int, list[float]] = {}
    for s in sentences:
        at = [place[w] for w in s]
        total = scores[at].sum(0)
        held.setdefault(int(total.argmax()), []).append(float(total.max() / sizes[at].sum()))
    known = {c: float(np.quantile(x, 0.001)) - NONE_MARGIN for c, x in held.items() if len(x) >= NONE_SENTENCES}
    return np.array([known.get(c, min(known.values(), default=-np.inf)) for c in range(len(LANGUAGES))])


class Scorer:
    """Scores batches of texts, keeping the scores of words it has met."""

    def __init__(self, pieces: dict[bytes, int], probs: np.ndarray, floor: np.ndarray | None = None) -> None:
        self.pieces, self.probs = pieces, probs
        self.floor = np.full(probs.shape[1], -np.inf) if floor is None else floor
        self.reset()

    def reset(self) -> None:
        self.place = dict.fromkeys(_ENDS, 0)
        self.scores = np.zeros((1, self.probs.shape[1]))
        self.letters, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Adds the words to the table, which starts anew when it is full."""
        if len(self.place) + len(words) > KEPT_WORDS and len(self.place) > len(_ENDS):
            raise OverflowError
        first = len(self.scores)
        self.place.update((w, first + n) for n, w in enumerate(words))
        self.scores = np.concatenate([self.scores, word_scores(words, self.pieces, self.probs)])
        self.letters = np.concatenate([self.letters, [len(w) if _UNSPACED.match(w) else 0 for w in words]])
        self.sizes = np.concatenate([self.sizes, _sizes(words)])

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """Per text its segments in order: (language, confidence, sentences, words).

        Adjoining whole sentences of one language make a segment; shorter stretches belong to none. A segment that is
        less likely in its language than text of none of them has the language -1.
        """
        parts = [tokens_of(t) if t else [] for t in texts]
        new = {w for p in parts for w in p if w not in self.place}
        if new:
            try:
                self.learn(sorted(new))
            except OverflowError:
                self.reset()
                self.learn(sorted({w for p in parts for w in p} - _ENDS))
        get = self.place.__getitem__
        ids = np.array([n for p in parts for n in (*map(get, p), 0)], np.int64)
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        if not len(ids):
            return out
        end = ids == 0
        text_of = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
        starts = np.concatenate([[0], np.nonzero(end)[0][:-1] + 1])
        words = np.add.reduceat((~end).astype(np.int64), starts)
        letters = np.add.reduceat(self.letters[ids], starts)
        keep = (words >= MIN_WORDS) | (letters >= MIN_LETTERS)
        if not keep.any():
            return out
        scores = np.add.reduceat(self.scores[ids], starts, axis=0)[keep]
        text, words, sizes = text_of[starts][keep], words[keep], np.add.reduceat(self.sizes[ids], starts)[keep]
        first = np.concatenate([[0], np.nonzero(np.diff(text))[0] + 1])
        whole = np.add.reduceat(scores, first, axis=0)
        main = np.repeat(whole.argmax(1), np.diff(np.concatenate([first, [len(text)]])))
        own = scores.argmax(1)
        rows = np.arange(len(own))
        own = np.where(scores[rows, own] - scores[rows, main] >= MARGIN, own, main)
        begin = np.concatenate([[0], np.nonzero(np.diff(text) | np.diff(own))[0] + 1])
        total = np.add.reduceat(scores, begin, axis=0)
        lang = own[begin]
        none = self.floor[lang] * np.add.reduceat(sizes, begin)
        best = np.maximum(total[np.arange(len(begin)), lang], none)
        confidence = 1 / (np.exp(np.clip(total - best[:, None], -700, 700)).sum(1) + np.exp(np.clip(none - best, -700, 700)))
        lang = np.where(none > total[np.arange(len(begin)), lang], -1, lang)
        number = np.diff(np.concatenate([begin, [len(text)]]))
        for t, c, p, k, w in zip(text[begin].tolist(), lang.tolist(), confidence.tolist(), number.tolist(), np.add.reduceat(words, begin).tolist()):
            out[t].append((c, p, k, w))
        return out


def labelled_sample(rows: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(language, text) of at most `per_language` labelled rows of each language, those with the largest hash."""
    named = rows.select(label_language(F.col(label)).alias("c"), F.struct(F.xxhash64(key).alias("h"), F.col(text).alias("t")).alias("r"))
    named = named.where(F.col("c").isNotNull() & (F.length("r.t") > 0))
    top = named.groupBy("c").agg(top_k(F.col("r"), per_language).alias("r"))
    return sorted((r["c"], x["t"]) for r in top.collect() for x in r["r"])


SEGMENT = "struct<lang:string,confidence:double,sentences:int,words:int>"


def languages(rows: DataFrame, key: str, text: str, label: str, training: DataFrame | None = None, vocabulary: str = VOCABULARY, per_language: int = SAMPLE_ROWS) -> DataFrame:
    """(key, label, language, confidence, segments): each row's text with its language and its one-language segments.

    `language` is that of the segment with most words, null if the text has no whole sentence (null, empty, or tags,
    links, handles, numbers and short greetings only), and then `segments` is empty, or if that segment, named "und",
    is in none of the languages known here; the confidence is then that it is in none. `label` is the code that the row's
    label names, null for none. The model is fitted on at most `per_language` labelled rows of `training` (the rows
    themselves if none are given) for each language; without any labelled row every language is equally likely and
    the confidence says so. Rows are scored in one narrow pass, whole texts, ties to the language named first.
    """
    spark = rows.sparkSession
    pieces = load_pieces(vocabulary)
    sample = labelled_sample(rows if training is None else training, key, text, label, per_language)
    probs = fit(sample, pieces)
    sent = spark.sparkContext.broadcast((pieces, probs.astype(np.float32), floors(sample, pieces, probs)))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model, floor = sent.value
        names = [*LANGUAGES, NONE]  # -1 is the last
        scorer = Scorer(known, model.astype(float), floor)
        segment = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("words", pa.int32())])
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                found = scorer.segments(part.column(2).to_pylist())
                best = [max(s, key=lambda x: x[3]) if s else None for s in found]
                columns = [
                    part.column(0),
                    part.column(1),
                    pa.array([names[b[0]] if b and b[0] >= 0 else None for b in best], pa.string()),
                    pa.array([b[1] if b else None for b in best], pa.float64()),
                    pa.array([[{"lang": names[c], "confidence": p, "sentences": k, "words": w} for c, p, k, w in s] for s in found], pa.list_(segment)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "label", "language", "confidence", "segments"])

    plain = rows.select(F.col(key).alias("key"), label_language(F.col(label)).alias("label"), F.col(text).alias("text"))
    out = plain.mapInArrow(run, f"key {kind}, label string, language string, confidence double, segments array<{SEGMENT}>")
    return out.select(F.col("key").alias(key), "label", "language", "confidence", "segments")


def label_cases(found: DataFrame, key: str) -> DataFrame:
    """(key, lang) of rows whose label names no language or another one than the text's, or whose text is mixed."""
    langs = F.array_remove(F.array_distinct(F.transform("segments", lambda s: s["lang"])), NONE)
    rows = found.select(key, "label", langs.alias("_langs"))
    case = F.col("label").isNull() | ~F.array_contains("_langs", F.col("label")) | (F.size("_langs") > 1)
    return rows.where((F.size("_langs") > 0) & case).select(key, F.explode("_langs").alias("lang"))
