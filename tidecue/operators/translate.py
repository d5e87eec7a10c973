"""Translation: what is open, what an earlier run knows, context and budgets, shrinking batches, review edits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import SKIP
from ..functions.text import char_budget, fingerprint, strip
from ..plans.stages import cut
from .lookup import numbered

SIZES = (30, 12, 4, 1)


def worklist(script: DataFrame) -> DataFrame:
    """Lines that are spoken and have no translation yet."""
    return script.where((F.col("speaker") != SKIP) & (F.coalesce("zh", F.lit("")) == ""))


def synthesis_worklist(script: DataFrame) -> DataFrame:
    """Lines to be voiced."""
    return script.where((F.col("speaker") != SKIP) & (F.coalesce("zh", F.lit("")) != "") & ~F.coalesce("fallback", F.lit(False)))


def with_context(script: DataFrame, lines: int = 6) -> DataFrame:
    """Adds the character budget and the lines before as "speaker: text"."""
    w = W.partitionBy("episode_id").orderBy("line_idx").rowsBetween(-lines, -1)
    said = F.concat("speaker", F.lit(": "), "en")
    return script.withColumns({"budget": char_budget("start", "end"), "context": F.array_join(F.collect_list(said).over(w), "\n")})


def reuse_translations(script: DataFrame, old: DataFrame, key: str = "episode_id") -> DataFrame:
    """Fills zh and emo of open lines from earlier ones (key, file, pos, sidx, en, zh, emo): the first by file and place of
    the same script line and text, else the text's only translation; a text that had several is left open."""
    known = old.withColumns({"en": strip("en"), "zh": strip("zh"), "emo": F.coalesce("emo", F.lit(""))}).where("en <> '' and zh <> ''")
    pair = F.struct("zh", "emo")
    by_line = known.where("sidx is not null").groupBy(key, "sidx", "en").agg(F.min_by(pair, F.struct("file", "pos")).alias("__line"))
    by_text = known.groupBy(key, "en").agg(F.min(pair).alias("__text"), F.max(pair).alias("__max")).where(F.col("__text") == F.col("__max")).drop("__max")
    x = script.withColumn("__en", strip(F.coalesce("en", F.lit(""))))
    x = x.join(by_line.withColumnsRenamed({"en": "__en"}), [key, "sidx", "__en"], "left").join(by_text.withColumnRenamed("en", "__en"), [key, "__en"], "left")
    open_ = (F.col("speaker") != SKIP) & (F.coalesce("zh", F.lit("")) == "")
    got = F.coalesce("__line", "__text")
    take = lambda c: F.when(open_ & got.isNotNull(), got[c]).otherwise(F.col(c))
    return x.withColumns({"zh": take("zh"), "emo": take("emo")}).select(*script.columns)


class ReplyLog:
    """What a model has answered, by the hash of the request: one file for each reply, written whole and never changed, in any
    folder that all machines reach. A request that is asked again, by a task that is tried again or by a later run, is answered
    from there."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _at(self, request: list[dict]) -> tuple[fs.FileSystem, str]:
        there, home = fs.FileSystem.from_uri(self.root)
        return there, f"{home.rstrip('/')}/{fingerprint(request)}.json"

    def get(self, request: list[dict]) -> dict[int, dict] | None:
        there, path = self._at(request)
        if there.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with there.open_input_stream(path) as f:
            return {int(k): v for k, v in json.loads(f.read()).items()}

    def put(self, request: list[dict], reply: dict[int, dict]) -> None:
        there, path = self._at(request)
        there.create_dir(path.rsplit("/", 1)[0], recursive=True)
        # under another name first: nobody reads half a reply
        part = f"{path}.{uuid.uuid4().hex}"
        with there.open_output_stream(part) as f:
            f.write(json.dumps({str(k): v for k, v in reply.items()}, ensure_ascii=False).encode())
        there.move(part, path)


def _asked(ask: Callable[[list[dict]], dict[int, dict]], log: ReplyLog | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def reply(request: list[dict]) -> dict[int, dict]:
        got = log.get(request) if log else None
        if got is None:
            try:
                got = ask(request)
            except Exception:  # noqa: BLE001  the next, smaller pass tries again
                return {}
            if log:
                log.put(request, got)
        return got

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("line_idx")
        request = [{k: v.item() if hasattr(v, "item") else v for k, v in r.items()} for r in rows[["line_idx", "speaker", "en", "budget", "context"]].to_dict("records")]
        got = reply(request)
        rows["zh"] = [str(got.get(i, {}).get("zh", "")).strip() for i in rows["line_idx"]]
        rows["emo"] = [str(got.get(i, {}).get("emo", "")) for i in rows["line_idx"]]
        return rows[["episode_id", "line_idx", "zh", "emo"]]

    return run


def translate(spark: SparkSession, script: DataFrame, ask: Callable[[list[dict]], dict[int, dict]], sizes: tuple[int, ...] = SIZES, log: str | None = None) -> DataFrame:
    """Asks a model for the open lines, in smaller and smaller batches until none is left out. ``ask`` gets the lines of a
    batch (line_idx, speaker, en, budget, context) and returns {line_idx: {zh, emo}} for those it managed; it runs on the
    executors, one batch at a time.

    Each pass is cut as it is made: what was asked is not asked again by what reads the result. With ``log``, a folder that all
    machines share, replies are kept there by request; what a lost task or a killed run had got is not paid for twice."""
    kept = ReplyLog(log) if log else None
    for size in sizes:
        todo = worklist(with_context(script))
        todo = numbered(todo, ["episode_id"], ["line_idx"], F.col("line_idx"), "__n").withColumn("batch", F.floor(F.col("__n") / size))
        todo = todo.select("episode_id", "line_idx", "speaker", "en", "budget", "context", "batch")
        done = todo.groupBy("episode_id", "batch").applyInPandas(_asked(ask, kept), "episode_id string, line_idx int, zh string, emo string")
        done = cut(done.where("zh <> ''").withColumnsRenamed({"zh": "__zh", "emo": "__emo"}))
        x = script.join(done, ["episode_id", "line_idx"], "left")
        script = x.withColumns({"zh": F.coalesce("__zh", "zh"), "emo": F.coalesce("__emo", "emo")}).drop("__zh", "__emo")
        if not done.isEmpty() and worklist(script).isEmpty():
            break
    return script


def review_rows(script: DataFrame) -> DataFrame:
    return script.select("episode_id", F.col("line_idx").alias("idx"), F.format_string("%.2f", F.col("start").cast("double")).alias("start"), "speaker", "en", F.coalesce("zh", F.lit("")).alias("zh"))


def apply_review(script: DataFrame, rows: DataFrame, labels: list[str]) -> DataFrame:
    """Edited rows (episode_id, idx, speaker, zh) into the script: a speaker counts if it is a label or occurs in the script
    (in any case of letters), an empty translation only clears a skipped line."""
    known = script.select("speaker").distinct().unionByName(rows.sparkSession.createDataFrame([(x,) for x in labels], "speaker string"))
    known = known.groupBy(F.lower("speaker").alias("__low")).agg(F.max("speaker").alias("__known"))
    edit = rows.select("episode_id", F.col("idx").cast("int").alias("line_idx"), F.lower(strip("speaker")).alias("__low"), strip(F.coalesce("zh", F.lit(""))).alias("__zh"), F.lit(True).alias("__edited"))
    x = script.join(edit.dropDuplicates(["episode_id", "line_idx"]), ["episode_id", "line_idx"], "left").join(known, "__low", "left")
    speaker = F.coalesce("__known", "speaker")
    zh = F.when(F.coalesce("__zh", F.lit("")) != "", F.col("__zh")).when(F.col("__edited") & (speaker == SKIP), "").otherwise(F.col("zh"))
    return x.withColumns({"zh": zh, "speaker": speaker}).select(*script.columns)
