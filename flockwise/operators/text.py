"""Tokens, phrases and embeddings of post texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Smallest and largest character n-gram of a word.
NGRAMS = (3, 5)


def tokens(text: Column) -> Column:
    """Lower-case words, numbers, tags and smileys; handles are left out and runs of a letter cut to three."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"@[\w.@-]+", " ")
    squeezed = F.regexp_replace(plain, r"(.)\1{2,}", "$1$1$1")
    return F.regexp_extract_all(squeezed, F.lit(r"https?://\S+|#[\p{L}\p{N}_]+|[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*|[:;=]-?[()dp]"), F.lit(0))


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): occurrences of each word; `docs` has (tokens)."""
    return docs.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("c"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(first, second, n): occurrences of each pair of neighbouring words."""
    pair = F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct(F.col("tokens")[i - 1].alias("first"), F.col("tokens")[i].alias("second")))
    return docs.where(F.size("tokens") > 1).select(F.explode(pair).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def scored_phrases(pairs: DataFrame, words: DataFrame, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """(first, second, n, score) of word pairs that stand together more often than apart.

    The score is (n - min_count) * vocabulary / (n of first * n of second) (Mikolov et al. 2013).
    """
    size = words.agg(F.count("*").alias("v")).scalar()
    joined = pairs.where(F.col("n") >= min_count).join(words.select(F.col("w").alias("first"), F.col("c").alias("ca")),
        "first").join(words.select(F.col("w").alias("second"), F.col("c").alias("cb")), "second")
    score = (F.col("n") - min_count) * size / (F.col("ca") * F.col("cb"))
    return joined.select("first", "second", "n", score.cast("double").alias("score")).where(F.col("score") > threshold)


def phrase_scores(docs: DataFrame, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """The phrases of (tokens)."""
    return scored_phrases(pair_counts(docs), word_counts(docs), min_count, threshold)


def added_phrases(old: DataFrame, new: DataFrame) -> DataFrame:
    """(first, second, n): pair counts of two loads added."""
    return old.select("first", "second", "n").unionByName(new.select("first", "second", "n")).groupBy("first", "second").agg(F.sum("n").alias("n"))


#: Phrases that are sent to all tasks, as eight bytes each; more are met in a join.
SENT_PHRASES = 8_000_000


def _phrase_number(first: str, second: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{first}\x00{second}") >> 1


def _greedy(words: list[str], starts) -> list[str]:
    """Words with a pair written as one token wherever it starts at a place in `starts`, from the left."""
    made, at = [], 0
    while at < len(words):
        if at + 1 < len(words) and at in starts:
            made.append(f"{words[at]}_{words[at + 1]}")
            at += 2
        else:
            made.append(words[at])
            at += 1
    return made


def joined_phrases(docs: DataFrame, phrases: DataFrame, key: str = "id", sent: int = SENT_PHRASES) -> DataFrame:
    """Docs with phrases written as one token, a_b, greedily from the left; `docs` has a unique `key` and `tokens`.

    Up to `sent` phrases go to all tasks as numbers (64-bit hashes); of more, each pair of neighbouring tokens meets
    its phrase in a join. Both give the same.
    """
    names, place = docs.columns, docs.columns.index("tokens")
    if phrases.limit(sent + 1).count() <= sent:
        held = np.array(sorted({_phrase_number(r[0], r[1]) for r in phrases.select("first", "second").toLocalIterator()}), np.int64)
        known = docs.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for words in batch.column(place).to_pylist():
                    words = words or []
                    numbers = np.array([_phrase_number(a, b) for a, b in zip(words, words[1:])], np.int64)
                    out.append(_greedy(words, set(np.nonzero(np.isin(numbers, known.value))[0].tolist())))
                columns = [pa.array(out, pa.list_(pa.string())) if n == "tokens" else batch.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return docs.mapInArrow(run, docs.schema)
    pair = F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda i: F.struct((i - 1).alias("at"), F.col("tokens")[i - 1].alias("first"),
        F.col("tokens")[i].alias("second")))
    pairs = docs.where(F.size("tokens") > 1).select(F.col(key).alias("_k"), F.explode(pair).alias("p")).select("_k", "p.*")
    found = pairs.join(phrases.select("first", "second").distinct(), ["first", "second"]).groupBy("_k").agg(F.collect_list("at").alias("_starts"))
    met = docs.join(found, docs[key] == found["_k"], "left").select(*names, F.coalesce("_starts", F.array().cast("array<int>")).alias("_starts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_greedy(w or [], set(s)) for w, s in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = [pa.array(out, pa.list_(pa.string())) if n == "tokens" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return met.mapInArrow(join, docs.schema)


def hashed_embeddings(docs: DataFrame, dims: int = 64, ngrams: tuple[int, int] = NGRAMS) -> DataFrame:
    """(id, embedding): mean of hashed subword vectors, of length one; the same everywhere and without training.

    A word is the sum of its character n-grams, each with two signed places by hash. `docs` has (id, tokens); without
    tokens the embedding comes from the hash of the id. Words are kept in a bounded table per task.
    """
    import xxhash

    low, high = ngrams

    def word_vector(word: str) -> np.ndarray:
        v = np.zeros(dims)
        whole = f"<{word}>"
        for n in range(low, high + 1):
            for a in range(max(1, len(whole) - n + 1)):
                h = xxhash.xxh64_intdigest(whole[a : a + n])
                v[h % dims] += 1 if h >> 63 else -1
                v[(h >> 20) % dims] += 1 if h >> 62 & 1 else -1
        return v / (np.linalg.norm(v) or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dims))
            ids = batch.column(0).to_pylist()
            for n, words in enumerate(batch.column(1).to_pylist()):
                for w in words or ():
                    if w not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[w] = word_vector(w)
                    out[n] += known[w]
                if not out[n].any():
                    out[n] = word_vector(f"\x00{ids[n]}")
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            flat = pa.array(out.astype(np.float32).reshape(-1))
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * dims, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "embedding"])

    return docs.select("id", "tokens").mapInArrow(run, "id long, embedding array<float>")


def word2vec(docs: DataFrame, dims: int = 128, window: int = 3, min_count: int = 10, epochs: int = 5, min_docs: int = 100, seed: int = 1):
    """A trained skip-gram model (pyspark.ml Word2Vec) over (tokens); fewer than `min_docs` texts are an error."""
    from pyspark.ml.feature import Word2Vec

    if docs.limit(min_docs).count() < min_docs:
        raise ValueError(f"training needs at least {min_docs} texts")
    return Word2Vec(vectorSize=dims, windowSize=window, minCount=min_count, maxIter=epochs, numPartitions=max(1, docs.rdd.getNumPartitions()),
        inputCol="tokens", outputCol="embedding", seed=seed).fit(docs)


def trained_embeddings(docs: DataFrame, model, dims: int = 64) -> DataFrame:
    """(id, embedding) by a trained word model: the mean of the words' vectors, of length one; `docs` has (id, tokens).

    Texts without a word that the model knows get the hashed vector of the same length.
    """
    from pyspark.ml.functions import vector_to_array

    from flockwise.functions.vectors import norm, normalised

    size = model.getVectorSize()
    rows = model.setInputCol("tokens").setOutputCol("_v").transform(docs.select("id",
        F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))).select("id", vector_to_array("_v").alias("v"))
    own = rows.where(norm(F.col("v")) > 0).select("id", normalised(F.col("v")).cast("array<float>").alias("embedding"))
    rest = hashed_embeddings(docs.join(own.select("id"), "id", "left_anti"), size)
    return own.unionByName(rest)


def served_embeddings(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch_rows: int = 256, tries: int = 3) -> DataFrame:
    """(id, embedding) from any function of texts, called per sub-batch and retried; `docs` has (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                part = batch.slice(a, batch_rows)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for left in range(tries - 1, -1, -1):
                    try:
                        found = embed(texts)
                        break
                    except OSError:
                        if not left:
                            raise
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float32()))], names=["id", "embedding"])

    return docs.select("id", "text").mapInArrow(run, "id long, embedding array<float>")


def embedding_provider(name: str | None, base_url: str | None) -> str:
    """'local' for no name or a local one, or without an address; else 'served'."""
    return "local" if not base_url or (name or "").strip().lower() in ("", "none", "local", "fasttext", "tfidf", "hashed") else "served"


def to_embed_again(posts: DataFrame, old_signature: str | None, signature: str) -> DataFrame:
    """Posts without their vectors if the model has changed, else those that lack one."""
    if old_signature is not None and old_signature != signature:
        return posts.withColumn("embedding", F.lit(None).cast(posts.schema["embedding"].dataType))
    return posts.where(F.col("embedding").isNull())
