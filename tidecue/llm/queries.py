"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, collocations, licenses, oracles, packing, pattern_packing, pieces, quality, toxicity
from .ann import nearest
from .divergence import MIN_DOCS, TERMS, source_divergence
from .line_dedup import count_repeated_lines
from .near_dedup import near_duplicates
from .substring_dedup import repeated_substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the public vocabulary files are.
TOKENIZERS = "/opt/tokenizers"


#: The part of a melody that op1_audio asks for, and its noise (a tone's standard deviation is 0.7).
EXCERPT, NOISE = slice(10, 54), 0.3


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector played as a melody; noisy excerpts of the rows asked for are looked up among all recordings."""
    rows = _table(spark, sf_dir, "embeddings")
    excerpt = audio.melody("embedding", notes=EXCERPT, noise=NOISE)
    return audio.scan(spark, rows, F.col("rec_id") % 20 == 0, key="vec_id", columns=("embedding",), decode=audio.melody("embedding"), excerpt=excerpt)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nearest(spark, rows, rows.where(F.col("vec_id") % 20 == 0))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", ","))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rated = quality.ratings(_table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    model = quality.fit(spark, docs, rated, grades=3)
    return quality.grade_documents(docs, model).withColumn("held_out", toxicity.held_out())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(spark, docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, _table(spark, sf_dir, "documents"), k=4)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), packing.word_count("text"))


def op8_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_repeated_lines(spark, _table(spark, sf_dir, "documents"), min_words=1)


def op9_pieces(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    # a vocabulary file is part of the installation, and is read once on the driver
    with open(model, "rb") as f:
        loaded = pieces.PieceModel.load(f.read())
    return pieces.digest_documents(_table(spark, sf_dir, "documents"), loaded)


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(spark, _table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark, _table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, _table(spark, sf_dir, "documents"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str, tokenizer: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    with open(tokenizer, encoding="utf-8") as f:
        loaded = f.read()
    return pattern_packing.pack_sequences(spark, _table(spark, sf_dir, "documents"), loaded)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio": op1_audio,
    "op2_nearest": op2_nearest,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_packing": op7_packing,
    "op8_repeated_lines": op8_repeated_lines,
    "op9_pieces": op9_pieces,
    "op10_repeated_substrings": op10_repeated_substrings,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_pattern_packing": op13_pattern_packing,
}
ORACLES: dict[str, str] = {
    "op2_nearest": oracles.nearest(20, 20),
    "op3_licenses": oracles.licenses(licenses.TEMPLATES, licenses.WORD, licenses.SHINGLE, licenses.PERCENT),
    "op6_near_duplicates": oracles.near_duplicates(4, 80),
    "op10_repeated_substrings": oracles.repeated_substrings(13),
    "op11_source_divergence": oracles.divergence(MIN_DOCS, TERMS),
    "op12_collocations": oracles.collocations(collocations.MAX_WORDS, collocations.MIN_COUNT, collocations.COVERED, collocations.ROWS),
}
