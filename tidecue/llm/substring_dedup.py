"""Substring deduplication: repeated token k-mers are edges, unbranched paths of them become spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._store import forget, free_name, materialize
from ._tok import binary, chunks, column, ids, mix, runs

WINDOW = 13
#: Words of a seed. A window's smallest seed hash is its minimiser; equal windows have equal minimisers.
SEED = 5
_ROW = 32  # a position holds the row's number among rows of one doc_id above this bit


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, in log2(w) passes."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _minimisers(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    return _sliding_min(runs(h, seed), window - seed + 1)


def _survey(window: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sha, mins = [], [], [], []
            data, offsets = column(batch, "text")
            for c in chunks(batch):
                h = c.hashes()
                m = _minimisers(h, window, seed) if len(h) >= window else h[:0]
                for i in range(c.hi - c.lo):
                    a, b = c.first[i], c.first[i + 1]
                    n.append(b - a)
                    digests.append(_digest(h[a:b]))
                    text = data[offsets[c.lo + i] : offsets[c.lo + i + 1]].tobytes()
                    sha.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
                    mins.append(np.unique(m[a : b - window + 1]).tobytes() if b - a >= window else b"")
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(n, pa.int64()), binary(digests), pa.array(sha, pa.string()), binary(mins)], ["doc_id", "n_words", "digest", "sha", "mins"])

    return run


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            mins = ids(part, "mins").to_pylist()
            doc = np.repeat(np.asarray(ids(part)), [len(x) // 8 for x in mins])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(mins), dtype=np.int64)), pa.array(doc)], ["seed", "doc_id"])


def _row_number(texts: list[bytes] | None, h: np.ndarray) -> int:
    """The row's number among the different texts of its doc_id (0 if there is one text only)."""
    return 0 if texts is None else texts.index(_digest(h))


def _keys_of(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """64-bit keys of the windows that start at the words ``at``."""
    key = np.zeros(len(at), np.uint64)
    for j in range(window):
        key = key * np.uint64(0xA0761D6478BD642F) + h[at + j]
    return mix(key).view(np.int64)


def _edges(window: int, seed: int) -> Callable:
    """The windows whose minimiser is shared with another document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, shared, texts = np.asarray(ids(batch)), ids(batch, "seeds"), ids(batch, "texts")
            for c in chunks(batch):
                h = c.hashes()
                if len(h) < window:
                    continue
                m = _minimisers(h, window, seed)
                where, base = [], []
                for i in range(c.hi - c.lo):
                    a, b = c.first[i], c.first[i + 1]
                    if b - a < window:
                        continue
                    mine = np.asarray(shared[c.lo + i].values).view(np.uint64)
                    at = np.flatnonzero(np.isin(m[a : b - window + 1], mine))
                    where.append(at + a)
                    base.append(at + (_row_number(texts[c.lo + i].as_py(), h[a:b]) << _ROW))
                at = np.concatenate(where) if where else np.zeros(0, np.int64)
                if not len(at):
                    continue
                # a window that a document repeats is one row; the other places are found when it is cut
                row, pos, key = np.searchsorted(c.first, at, side="right") - 1, np.concatenate(base), _keys_of(h, at, window)
                order = np.lexsort((pos, key, row))
                new = np.ones(len(row), bool)
                new[1:] = (np.diff(row[order]) != 0) | (np.diff(key[order]) != 0)
                first = np.sort(order[new])
                row, pos, key = row[first], pos[first], key[first]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[row + c.lo]), pa.array(pos)], ["key", "doc_id", "pos"])

    return run


def _raw(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = column(batch, "text")
    for i in range(batch.num_rows):
        yield data[offsets[i] : offsets[i + 1]].tobytes()


def _words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    return map(bytes.split, _raw(batch))


def _runs_left(raw: bytes, drop: bytearray) -> str:
    """The text between removed words, with its own white space; a space stands for what was removed inside."""
    words, out, i = list(re.finditer(rb"[^\x20\x09-\x0D]+", raw)), [], 0
    while i < len(words):
        j = i
        while j < len(words) and not drop[j]:
            j += 1
        if j > i:
            out.append(raw[words[i].start() : words[j - 1].end()])
        i = j + 1
    return b" ".join(out).decode()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    one = pa.RecordBatch.from_arrays([pa.array([b" ".join(words).decode()])], ["text"])
    return next(chunks(one)).hashes()


def _span_digest(words: list[bytes], a: int, n: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[a : a + n]), digest_size=16).digest()


def _quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands at the source coordinates asked for."""
    for batch in batches:
        doc, at, size, what = [], [], [], []
        for d, words, asked, texts in zip(ids(batch).to_pylist(), _words(batch), ids(batch, "asked").to_pylist(), ids(batch, "texts").to_pylist(), strict=True):
            row = 0 if texts is None else _row_number(texts, _word_hashes(words))
            for x in asked:
                if x["src_pos"] >> _ROW == row:
                    doc.append(d)
                    at.append(x["src_pos"])
                    size.append(x["n"])
                    what.append(_span_digest(words, x["src_pos"] & ((1 << _ROW) - 1), x["n"]))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(size, pa.int64()), binary(what)], ["src_doc", "src_pos", "n", "quote"])


def _same_windows(h: np.ndarray, drop: bytearray, spans: list[tuple[int, int]], window: int) -> None:
    """Also drop the other places of the windows in the spans."""
    key = _keys_of(h, np.arange(len(h) - window + 1), window)
    gone = np.concatenate([key[a : a + n - window + 1] for a, n in spans])
    for a in np.flatnonzero(np.isin(key, gone)).tolist():
        drop[a : a + window] = b"\1" * window


def _cut(full: bool, window: int) -> Callable:
    """Remove the spans that equal their source; ``full`` also gives the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, gone, sha, left = [], [], [], []
            for raw, words, spans, texts in zip(_raw(batch), _words(batch), ids(batch, "spans").to_pylist(), ids(batch, "texts").to_pylist(), strict=True):
                h = _word_hashes(words)
                row, drop = _row_number(texts, h), bytearray(len(words))
                mine = [(x["pos"] & ((1 << _ROW) - 1), x["n"], x["quote"]) for x in spans if x["pos"] >> _ROW == row]
                true = [(a, n) for a, n, quote in mine if _span_digest(words, a, n) == quote]
                if true:
                    _same_windows(h, drop, true, window)
                text = b" ".join(w for w, g in zip(words, drop, strict=True) if not g)
                digests.append(_digest(h))
                gone.append(sum(drop))
                sha.append(hashlib.sha256(text).hexdigest())
                left.append(_runs_left(raw, drop) if full else None)
            arrays = [ids(batch), binary(digests), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(left, pa.string())] if full else arrays, ["doc_id", "digest", "gone", "cut_sha", *["kept_text"] * full])

    return run


def repeated_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; other columns are not read): doc_id, n_words,
    n_removed, kept_sha256, and with ``text`` also kept_text.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id.
    All windows are judged on the input. kept_sha256 is of the kept words joined by one space, in UTF-8;
    kept_text has the text that is left, white space between kept words as it was, and is null where nothing was
    removed (the text stays as it is). Null, empty and blank texts have no
    words. Rows with a null doc_id take no part: nothing is removed from them or because of them. Rows that
    share a doc_id are one document: each is judged by itself, against smaller ids only. An empty table gives
    an empty result.

    Method: only windows whose minimiser (smallest hash of their 5-word seeds) occurs in two documents can
    repeat, so just these become edges. An edge's source is its first occurrence by (doc_id, position). Edges
    that follow each other in a document and in the source without a branch compact into one path, and a path's
    words are compared with those at its source coordinates before they go. Exact copies of whole texts are
    settled before that by digest.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = materialize(spark, docs.mapInArrow(_survey(window, seed), "doc_id long, n_words long, digest binary, sha string, mins binary"), "survey")
    about = materialize(spark, survey.drop("mins"), "about")
    here = about.where("doc_id is not null")
    long = here.where(F.col("n_words") >= window)
    # a table of its own: a join whose sides are plain exchanges can split the rows of a hot text
    first = materialize(spark, long.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "first")
    several = here.groupBy("doc_id").agg(F.sort_array(F.collect_set("digest")).alias("texts")).where("size(texts) > 1")

    seeds = survey.where("doc_id is not null and length(mins) > 0").select("doc_id", "mins").mapInArrow(_seeds, "seed long, doc_id long")
    # minima are aggregated on the map side and joined back, so a seed in a third of all documents is split like any row
    shared = materialize(spark, seeds.groupBy("seed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed"), "shared")
    # a text that is a copy of a smaller document's is gone as a whole: its windows name no source and need none
    firsts = long.join(first, "digest").where("doc_id = first_id").select("doc_id").distinct()
    seeds = seeds.join(shared.hint("shuffle_hash"), "seed", "left_semi").join(firsts, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("seed").alias("seeds"))
    seeds = materialize(spark, seeds.join(several, "doc_id", "left"), "seeds")
    forget(spark, survey, shared)

    texts = docs.where("doc_id is not null")
    edges = materialize(spark, texts.join(seeds, "doc_id").mapInArrow(_edges(window, seed), "key long, doc_id long, pos long"), "edges")
    forget(spark, seeds)
    sources = edges.groupBy("key").agg(F.min("doc_id").alias("src_doc"), F.min_by("pos", "doc_id").alias("src_pos"), F.max("doc_id").alias("last")).where("src_doc < last").drop("last")
    sources = materialize(spark, sources, "sources")
    found, edges = edges, edges.join(sources.hint("shuffle_hash"), "key").where("doc_id > src_doc").select("doc_id", "pos", "src_doc", "src_pos")
    # an unbranched path: both coordinates advance together
    path = W.partitionBy("doc_id", "src_doc", F.col("src_pos") - F.col("pos")).orderBy("pos")
    edges = edges.repartition("doc_id").withColumn("path", F.col("pos") - F.dense_rank().over(path))
    shift = (F.col("src_pos") - F.col("pos")).alias("shift")
    spans = edges.groupBy("doc_id", "src_doc", shift, "path").agg(F.min("pos").alias("pos"), F.min("src_pos").alias("src_pos"), (F.max("pos") - F.min("pos") + window).alias("n"))
    spans = materialize(spark, spans.select("doc_id", "pos", "src_doc", "src_pos", "n"), "spans")
    forget(spark, found, sources)

    asked = spans.groupBy("src_doc", "src_pos", "n").agg(F.lit(1).alias("one")).groupBy(F.col("src_doc").alias("doc_id")).agg(F.collect_list(F.struct("src_pos", "n")).alias("asked"))
    quotes = texts.join(asked.join(several, "doc_id", "left"), "doc_id").mapInArrow(_quote, "src_doc long, src_pos long, n long, quote binary").distinct()
    cuts = spans.join(quotes, ["src_doc", "src_pos", "n"]).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n", "quote")).alias("spans"))
    schema = "doc_id long, digest binary, gone long, cut_sha string" + ", kept_text string" * text
    cut = texts.join(cuts.join(several, "doc_id", "left"), "doc_id").mapInArrow(_cut(text, window), schema).dropDuplicates(["doc_id", "digest"])

    short = about.where(F.col("n_words") < window).withColumn("first_id", F.lit(None).cast("long"))
    known = about.where(F.col("n_words") >= window).join(first, "digest", "left").unionByName(short)
    out = known.join(cut, ["doc_id", "digest"], "left")
    copy = F.col("doc_id") > F.col("first_id")
    kept = {"kept_text": F.when(copy, F.lit("")).otherwise(F.col("kept_text"))} if text else {}
    out = out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        *[c.alias(k) for k, c in kept.items()], *["digest"] * text,
    )
    return out


def _tagged(tag: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = [_digest(h[c.first[i] : c.first[i + 1]]) for c in chunks(batch) for h in [c.hashes()] for i in range(c.hi - c.lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns, binary(tags)], [*batch.schema.names, tag])

    return run


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``; every row and column stays, whatever the columns are called, and a
    text may become empty. Rows are treated as ``repeated_substrings`` says; where nothing was removed, the text stays as
    it is (also null)."""
    tag, of, mark, kept_text = (free_name(docs, x) for x in ("_tag", "_of", "_mark", "_kept"))
    kept = repeated_substrings(spark, docs, window, text=True).where("kept_text is not null").select(F.col("doc_id").alias(of), F.col("digest").alias(mark), F.col("kept_text").alias(kept_text)).distinct()
    kept = materialize(spark, kept, "kept")
    tagged = docs.mapInArrow(_tagged(tag), StructType([*docs.schema.fields, StructField(tag, BinaryType())]))
    both = tagged.join(kept, (F.col("doc_id") == F.col(of)) & (F.col(tag) == F.col(mark)), "left")
    return both.withColumn("text", F.coalesce(kept_text, "text")).select(docs.columns)
