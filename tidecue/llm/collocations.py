"""Collocations: phrases of a few words that occur together more than their parts suggest, by sorted suffixes.

Each word starts a suffix of at most MAX_WORDS words of its piece. Suffixes are dealt by language and first word, where one word
starts very many by the words after it too, sorted in reverse lexicographic order, and the counts of all their prefixes
come from one pass with a stack of open prefixes. Parts are joined afterwards.

A suffix travels as a short key. The most frequent words, TOP of them at most, are two bytes; others are spelled. No code is
the start of another one, so the order of keys keeps suffixes with equal first words together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import bit_filter, forget, materialize, maybe_in, n_parts
from ._tok import Chunk, chunks, mix

#: Words of a phrase, occurrences of a candidate, percent of its occurrences that a longer one explains, rows per language.
MAX_WORDS, MIN_COUNT, COVERED, ROWS = 4, 30, 80, 2000
#: Words with a code of their own, and the bytes of the longest of them.
TOP, TOP_BYTES = 1 << 14, 64
#: Bytes of text that are handled at once; keys that choose the borders of ranges, and the documents they come from.
CHUNK, SAMPLE_KEYS, SAMPLE_DOCS = 1 << 22, 100_000, 20_000
#: Parts that a language's candidates are ranked in before their first rows meet.
SALTS = 64
#: White space between words, marks between pieces (fixed values).
_SPACE, _MARKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_IN_WORD = np.array([c not in _SPACE + _MARKS for c in range(256)])
_BORDER = np.array([c in _MARKS for c in range(256)])
_SPELLED, _TOP_CODE, _END = 1, 128, 10


@dataclass
class Words:
    """The words of a chunk: a dictionary, each word's place in it, language and piece, and a hash of language and word."""

    dictionary: pa.Array
    code: np.ndarray
    lang: np.ndarray
    piece: np.ndarray
    key: np.ndarray


def _words(c: Chunk, lang: np.ndarray, lang_hash: np.ndarray) -> Words:
    """``lang`` has the language of each row of the batch, ``lang_hash`` a number for each language."""
    inside, offsets = _IN_WORD[c.data], np.zeros(len(c.starts) + 1, np.int64)
    np.cumsum(c.ends - c.starts, out=offsets[1:])
    word = pa.Array.from_buffers(pa.large_string(), len(c.starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(c.data[inside]))]).dictionary_encode()
    code, row = np.asarray(word.indices).astype(np.int64), np.repeat(np.arange(c.lo, c.hi), np.diff(c.first))
    hashed = _hashes(word.dictionary)
    # a border between two words, or another row, is another piece
    piece = np.cumsum(_BORDER[c.data])[c.starts] + row if len(row) else row
    return Words(word.dictionary, code, lang[row], piece, mix(hashed[code] ^ lang_hash[lang[row]]) if len(row) else np.zeros(0, np.uint64))


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large string array."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = _bytes(words)
    return Chunk(0, 0, data, offsets, offsets[:-1], offsets[1:], offsets).hashes()


def _languages(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lang = batch.column("lang").dictionary_encode()
    names = lang.dictionary
    return names, np.asarray(lang.indices).astype(np.int64), np.array([zlib.crc32(x.encode()) + 1 for x in names.to_pylist()] or [0], np.uint64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, key, n): occurrences in some documents, still to be added by word. ``key`` is the hash that ``suffixes``
    looks up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang, lang_hash = _languages(batch)
            for c in chunks(batch, lower=True, size=CHUNK, inside=_IN_WORD):
                w = _words(c, lang, lang_hash)
                both, at, n = np.unique(w.lang * max(1, len(w.dictionary)) + w.code, return_index=True, return_counts=True)
                words = w.dictionary.take(pa.array(w.code[at])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names.take(pa.array(w.lang[at])).cast(pa.string()), words, pa.array(w.key[at].view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])

    return docs.mapInArrow(run, "lang string, word string, key long, n long")


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of size[i] numbers each, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _codes(dictionary: pa.Array, top: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each word's code: two bytes from 128 on, or a mark, the word, and an end that no word holds."""
    rank = pc.index_in(dictionary, top)
    spelled = np.asarray(rank.is_null())
    rank = np.asarray(rank.fill_null(0)).astype(np.int64)
    data, offsets = _bytes(dictionary)
    size = np.diff(offsets)
    out_at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(np.where(spelled, size + 2, 2), out=out_at[1:])
    out = np.zeros(int(out_at[-1]), np.uint8)
    begin = out_at[:-1]
    out[begin[~spelled]] = _TOP_CODE + (rank[~spelled] >> 7)
    out[begin[~spelled] + 1] = _TOP_CODE + (rank[~spelled] & 127)
    out[begin[spelled]] = _SPELLED
    out[out_at[1:][spelled] - 1] = _END
    out[_spread(begin[spelled] + 1, size[spelled])] = data[_spread(offsets[:-1][spelled], size[spelled])]
    return out, out_at


def _header(lang: str) -> bytes:
    """A language as the start of a key: it ends where no other one goes on."""
    return lang.replace("\\", "\\\\").replace("\n", "\\n").encode() + bytes([_END])


def _named(header: bytes) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], header[:-1].decode())


def suffixes(docs: DataFrame, frequent: np.ndarray, top: list[str], borders: list[bytes], max_words: int = MAX_WORDS) -> DataFrame:
    """(part, key, n): the suffixes of two words or more of some documents, up to the first word that is not frequent, how often they
    occur there, and the range they belong to. Equal ones of a chunk are one row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((frequent, top, borders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, words, ends = sent.value
        known, limits = pa.array(words, pa.large_string()), np.array(ends, "S64")
        for batch in batches:
            names, lang, lang_hash = _languages(batch)
            headers = [_header(x) for x in names.to_pylist()]
            for c in chunks(batch, lower=True, size=CHUNK, inside=_IN_WORD):
                w = _words(c, lang, lang_hash)
                rows = _suffix_rows(w, maybe_in(bits, w.key.view(np.int64)), max_words)
                if rows is None:
                    continue
                of_lang, parts, n = rows
                data, offsets = _codes(w.dictionary, known)
                # pool: headers, then codes; a place past the end stands for no word
                pool = np.concatenate([np.frombuffer(b"".join(headers), np.uint8), data])
                head_at = np.cumsum([0, *map(len, headers)])
                first = np.concatenate([head_at[of_lang][:, None], np.append(offsets[:-1], 0)[parts] + head_at[-1]], axis=1)
                size = np.concatenate([np.diff(head_at)[of_lang][:, None], np.append(np.diff(offsets), 0)[parts]], axis=1)
                key_at = np.zeros(len(n) + 1, np.int64)
                np.cumsum(size.sum(axis=1), out=key_at[1:])
                spelled = pool[_spread(first.ravel(), size.ravel())]
                keys = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(key_at), pa.py_buffer(spelled)])
                part = np.searchsorted(limits, _starts(spelled, key_at, 64), side="right") if len(limits) else np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), keys.cast(pa.binary()), pa.array(n)], ["part", "key", "n"])

    return docs.mapInArrow(run, "part int, key binary, n long")


def _starts(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first bytes of each key as one array of fixed width."""
    size = np.minimum(np.diff(at), width)
    out = np.zeros((len(size), width), np.uint8)
    out.ravel()[_spread(np.arange(len(size)) * width, size)] = data[_spread(at[:-1], size)]
    return out.view(f"S{width}").ravel()


def _suffix_rows(w: Words, frequent: np.ndarray, max_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(language, places in the dictionary, times) of the distinct suffixes; the place past the dictionary's end is no word."""
    n, size = len(w.code), len(w.dictionary)
    follows = np.zeros(n, bool)
    follows[:-1] = (w.piece[1:] == w.piece[:-1]) & frequent[1:] & frequent[:-1]
    at = np.flatnonzero(follows)
    if not len(at):
        return None
    parts, live = np.full((len(at), max_words), size, np.int64), np.ones(len(at), bool)
    parts[:, 0] = w.code[at]
    for k in range(1, max_words):
        live = live & follows[np.minimum(at + k - 1, n - 1)]
        parts[live, k] = w.code[at[live] + k]
    group = w.lang[at]
    for k in range(max_words):
        # numbered anew after each word, so products stay below (words + 1) times (suffixes)
        group, one = np.unique(group * (size + 1) + parts[:, k], return_inverse=True)
        group, first = one, np.zeros(len(group), np.int64)
    first[group[::-1]] = np.arange(len(at))[::-1]
    return w.lang[at][first], parts[first], np.bincount(group, minlength=len(first)).astype(np.int64)


def _ends(data: np.ndarray, at: np.ndarray, max_words: int) -> np.ndarray:
    """Of keys, the end of the language and of each word, as a matrix (keys, max_words + 1); a word that a key has not is -1."""
    stop, last = np.flatnonzero(data == _END), at[1:]
    out = np.full((len(last), max_words + 1), -1, np.int64)
    if not len(last):
        return out
    p = stop[np.searchsorted(stop, at[:-1])] + 1
    out[:, 0] = p
    for k in range(1, max_words + 1):
        live = np.flatnonzero(p < last)
        here = p[live]
        spelled = data[here] == _SPELLED
        to = here + 2
        to[spelled] = stop[np.searchsorted(stop, here[spelled])] + 1
        p = p.copy()
        p[live] = to
        out[live, k] = to
    return out


def _common(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many first bytes each key shares with the one before it (0 for the first)."""
    size = np.diff(at)
    out = np.zeros(len(size), np.int64)
    live = np.arange(1, len(size))
    most = np.minimum(size[1:], size[:-1])
    step = 0
    while len(live):
        live = live[most[live - 1] > step]
        live = live[data[at[live] + step] == data[at[live - 1] + step]]
        step += 1
        out[live] = step
    return out


def count_prefixes(sorted_suffixes: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """(key, n) of the prefixes of two words or more in each partition of suffixes in reverse order: those that reach
    ``min_count`` there, and those that may go on in a neighbouring partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the stack: the last key's prefixes, what each has counted, and whether it reaches back to the partition's first row
        key, open_n, edge = b"", np.zeros(max_words + 1, np.int64), np.ones(max_words + 1, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at = _bytes(batch.column("key").cast(pa.large_binary()))
            data, at = data[at[0] : at[-1]], at - at[0]
            n = np.asarray(batch.column("n"))
            if key:
                data, at = np.concatenate([np.frombuffer(key, np.uint8), data]), np.concatenate([[0], at + len(key)])
            ends, common = _ends(data, at, max_words), _common(data, at)
            keys, total = [], []
            for k in range(2, max_words + 1):
                has = np.flatnonzero(ends[:, k] >= 0)
                times = np.concatenate([open_n[k : k + 1], n]) if key else n
                if not len(has):
                    continue
                # equal so far if all bytes of this prefix are shared with the row before
                starts = np.flatnonzero(np.append(True, common[has[1:]] < (ends[has, k] - at[has])[1:]))
                sums = np.add.reduceat(times[has], starts)
                group_edge = np.zeros(len(starts), bool)
                group_edge[0] = has[0] == 0 and edge[k]
                still = has[-1] == len(at) - 2
                out = np.flatnonzero(((sums >= min_count) | group_edge)[: len(starts) - still])
                row = has[starts[out]]
                keys += [data[a:e].tobytes() for a, e in zip(at[row].tolist(), ends[row, k].tolist(), strict=True)]
                total.append(sums[out])
                open_n[k] = sums[-1] if still else 0
                edge[k] = group_edge[-1] if still else False
            for k in range(2, max_words + 1):
                if ends[-1, k] < 0:
                    open_n[k], edge[k] = 0, False
            key = data[at[-2] :].tobytes()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(total))], ["key", "n"])
        if key:
            ends = _ends(np.frombuffer(key, np.uint8), np.array([0, len(key)]), max_words)[0]
            live = [k for k in range(2, max_words + 1) if ends[k] >= 0]
            if live:
                yield pa.RecordBatch.from_arrays([pa.array([key[: ends[k]] for k in live], pa.binary()), pa.array(open_n[live])], ["key", "n"])

    return sorted_suffixes.select("key", "n").mapInArrow(run, "key binary, n long")


def _spelled(phrases: DataFrame, top: list[str], max_words: int) -> DataFrame:
    """(lang, words, a) of keys."""
    sent = phrases.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            data, at = _bytes(batch.column("key").cast(pa.large_binary()))
            langs, phrases = [], []
            for lo, ends in zip(at[:-1].tolist(), _ends(data, at, max_words).tolist(), strict=True):
                langs.append(_named(data[lo : ends[0]].tobytes()))
                code = [data[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False) if b >= 0]
                phrases.append([x[1:-1].decode() if x[0] == _SPELLED else words[(x[0] - _TOP_CODE) * 128 + x[1] - _TOP_CODE] for x in code])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.list_(pa.string())), batch.column("n")], ["lang", "words", "a"])

    return phrases.select("key", "n").mapInArrow(run, "lang string, words array<string>, a long")


def _div(top: Column, bottom: Column) -> Column:
    return F.call_function("div", top, bottom)


def collocations(spark: SparkSession, docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered: int = COVERED, rows: int = ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``rows`` phrases.

    Texts (null: empty) are split at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words, A-Z
    lower-cased. Everything is counted per language (null: ``und``): n all words, f(phrase) all its occurrences within pieces.
    Candidates have 2 to ``max_words`` words and a = f(phrase) >= ``min_count``. Of the ways to cut one in two parts that occur l and r
    times, the one with the lowest score floor(2000000 a / (l + r)) counts, of equal ones that with the shortest first part. A
    candidate that lies inside a longer one with at least ``covered`` percent of its occurrences is dropped. Ranks follow score, then a,
    both descending, then the phrase by bytes. Repeated rows count each time, columns besides text and lang play no part,
    languages without candidates give no rows, an empty table none at all. Very long texts are read in one task.

    Words come first: those below ``min_count`` end suffixes, by a filter of fixed size, which lets some through but holds none back.
    Borders of the ranges are quantiles of about SAMPLE_KEYS suffixes of about SAMPLE_DOCS documents; they decide only where a suffix
    is counted. Counts of prefixes that reach over a border are added.
    """
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = word_counts(text).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("key").alias("key"))
    often = F.col("n") >= min_count
    words = counted.groupBy("lang", F.when(often, F.col("word")).alias("word"), F.when(often, F.col("key")).alias("key")).agg(F.sum("n").alias("n"))
    words = materialize(spark, words, "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where("word is not null")
    top = [r["word"] for r in words.where(F.octet_length("word") <= TOP_BYTES).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TOP).collect()]
    frequent = bit_filter(spark, words, "key", hashed=True).value

    n_docs, n_words = docs.count(), words.agg(F.sum("n")).first()[0] or 0
    part_of_docs = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    sample = suffixes(text.sample(part_of_docs, seed=1), frequent, top, [], max_words).sample(min(1.0, SAMPLE_KEYS / max(1.0, n_words * part_of_docs)), seed=2)
    keys, ranges = sorted(bytes(r["key"]) for r in sample.select("key").collect()), n_parts(spark)
    borders = sorted({keys[len(keys) * i // ranges][:64] for i in range(1, ranges)}) if keys else []

    dealt = suffixes(text, frequent, top, borders, max_words).repartitionById(len(borders) + 1, F.col("part"))
    prefixes = count_prefixes(dealt.sortWithinPartitions(F.desc("key")), max_words, min_count)
    prefixes = prefixes.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    candidates = materialize(spark, _spelled(prefixes, top, max_words), "candidates")

    phrase = lambda w: F.array_join(w, " ")
    known = words.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(candidates.select("lang", phrase("words").alias("part"), F.col("a").alias("f")))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", phrase("words").alias("phrase"), "a", "k", phrase(F.slice("words", F.lit(1), F.col("k"))).alias("left"), phrase(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = _div(F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # the contiguous parts of longer candidates, with the most frequent of them
    span = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    inner = candidates.where(F.size("words") > 2).select("lang", F.explode(span).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, x: F.col(c).cast("decimal(20,0)") * x
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(wide("longer", 100) < wide("a", covered), F.lit(True)))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = left.withColumn("place", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best))).where(F.col("place") <= rows).drop("place")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= rows)
    out = materialize(spark, ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    forget(spark, candidates)
    return out
