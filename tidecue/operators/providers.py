"""Seams to services outside: speech synthesis, language models, recognition. Only protocols and fakes live here."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Protocol
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_bad_voice, is_chinese, voice_gender


class SpeechProvider(Protocol):
    """What a synthesis service offers. Calls cost money: a provider does its own retries, and is asked once."""

    def check(self) -> bool: ...

    def synthesize(self, text: str, voice: str, emotion: str) -> bytes: ...

    def search(self, words: str) -> list[dict]: ...

    def preview(self, voice: str) -> bytes: ...


class Recogniser(Protocol):
    def transcribe(self, audio: bytes) -> list[dict]: ...


class FakeSpeech:
    """Deterministic stand-in: a clip is the hash of what was asked, and lasts by its characters."""

    def __init__(self, refuse: frozenset[str] = frozenset()) -> None:
        self.refuse = refuse

    def check(self) -> bool:
        return True

    def synthesize(self, text: str, voice: str, emotion: str) -> bytes:
        if voice in self.refuse:
            raise RuntimeError(f"{voice} is unavailable")
        return hashlib.sha1(f"{text}|{voice}|{emotion}".encode()).digest()

    def search(self, words: str) -> list[dict]:
        return [{"title": words, "voice": hashlib.sha1(words.encode()).hexdigest()}]

    def preview(self, voice: str) -> bytes:
        return self.synthesize("", voice, "")


PROVIDERS: dict[str, Callable[[], SpeechProvider]] = {"fake": FakeSpeech}


def provider(name: str) -> SpeechProvider:
    return PROVIDERS[name]()


def retry(call: Callable[[], object], tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The first success of up to ``tries`` calls, with a pause that grows by ``pause`` each time."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            sleep(pause * n)
    raise ValueError("tries has to be positive")


def attempts() -> F.Column:
    """The order in which a line is tried: own voice with emotion, without, then another backup voice with and without."""
    each = [F.struct(F.col(v).alias("voice"), e.alias("emotion"), F.lit(b).alias("backup")) for v, b in (("voice", False), ("backup", True)) for e in (F.coalesce("emo", F.lit("")), F.lit(""))]
    return F.filter(F.array_distinct(F.array(*each)), lambda a: (F.coalesce(a["voice"], F.lit("")) != "") & ~(a["backup"] & a["voice"].eqNullSafe(F.col("voice"))))


def read_page(url: str, timeout: float = 45, opened: Callable = urlopen, sleep: Callable[[float], None] = time.sleep) -> str:
    """The text of a page, tried three times."""

    def get() -> str:
        with opened(url, timeout=timeout) as answer:
            if answer.status != 200:
                raise OSError(f"{url}: status {answer.status}")
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")

    return retry(get, 3, 1.0, sleep)


def file_key(path: str | Path) -> str:
    """SHA-256 of a whole file: equal names or sizes are no proof of equal content."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verified_file(path: str | Path, sha256: str, blocks: Callable[[], Iterable[bytes]]) -> Path:
    """``path`` with the content of that checksum. What is there already is kept; else ``blocks`` brings it, and takes its
    place only if the checksum is right."""
    path = Path(path)
    if path.exists() and file_key(path) == sha256:
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    try:
        with part.open("wb") as f:
            f.writelines(blocks())
        if file_key(part) != sha256:
            raise ValueError(f"{path.name}: the download has another checksum")
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)
    return path


def first_font(fonts: Iterable[tuple[str, str]]) -> tuple[str, str] | None:
    """The first (path, family) of a list of fonts whose file is there."""
    return next(((path, family) for path, family in fonts if Path(path).exists()), None)


def stamp() -> F.Column:
    """Identity of a clip: text, voice, emotion and provider; a clip with the same stamp is not made again."""
    return F.concat_ws("|", "zh", "voice", F.coalesce("emo", F.lit("")), "provider")


def synthesize(lines: DataFrame, make: Callable[[], SpeechProvider], parallel: int = 4, each: int = 2) -> DataFrame:
    """(episode_id, line_idx, clip, used_backup) of lines with zh, emo, voice and backup: each attempt is made ``each`` times
    before the next. ``parallel`` bounds the calls at a time. A failed line has no clip."""

    def run(batches):
        service = make()
        for b in batches:
            clips, backup = [], []
            for text, options in zip(b["zh"], b["attempts"], strict=True):
                clip, used = None, False
                for a in options:
                    try:
                        clip, used = retry(lambda a=a, text=text: service.synthesize(text, a["voice"], a["emotion"]), each, 0.0), a["backup"]
                        break
                    except Exception:  # noqa: BLE001  the next attempt follows
                        continue
                clips.append(clip)
                backup.append(bool(used))
            yield pd.DataFrame({"episode_id": b["episode_id"], "line_idx": b["line_idx"], "clip": clips, "used_backup": backup})

    todo = lines.select("episode_id", "line_idx", "zh", attempts().alias("attempts")).repartition(parallel)
    return todo.mapInPandas(run, "episode_id string, line_idx int, clip binary, used_backup boolean")


def accepted_stamps() -> F.Column:
    """Every stamp that a clip of the line may have: its own voice or the backup, with or without emotion."""
    each = F.transform(attempts(), lambda a: F.concat_ws("|", F.col("zh"), a["voice"], a["emotion"], F.col("provider")))
    return F.array_distinct(each)


def reusable_clips(lines: DataFrame, made: DataFrame) -> DataFrame:
    """(episode_id, line_idx, clip) of the clips made before (episode_id, line_idx, stamp, clip) that are still good for
    their line; of several the one whose stamp comes first."""
    good = lines.select("episode_id", "line_idx", F.explode(accepted_stamps()).alias("stamp"))
    return good.join(made.where("clip is not null"), ["episode_id", "line_idx", "stamp"]).groupBy("episode_id", "line_idx").agg(F.min_by("clip", "stamp").alias("clip"))


#: So many lines are tried before the others.
TRIED = 8


def synthesize_rest(lines: DataFrame, made: DataFrame, make: Callable[[], SpeechProvider], keep: Callable[[DataFrame], DataFrame], parallel: int = 4) -> DataFrame:
    """``synthesize`` for all lines without a reusable clip. The first TRIED of them are tried before the rest: if all of
    them fail the service is down, and the run ends with an error. ``keep`` stores what was tried, so that no call is made
    twice."""
    known = reusable_clips(lines, made).withColumn("used_backup", F.lit(False))
    todo = lines.join(known, ["episode_id", "line_idx"], "left_anti")
    tried = keep(synthesize(todo.orderBy("episode_id", "line_idx").limit(TRIED), make, parallel))
    count, clips = tried.agg(F.count(F.lit(1)), F.count("clip")).first()
    if count == TRIED and not clips:
        raise RuntimeError(f"none of the first {TRIED} lines could be voiced")
    rest = synthesize(todo.join(tried, ["episode_id", "line_idx"], "left_anti"), make, parallel)
    return known.unionByName(tried).unionByName(rest)


def backup_report(clips: DataFrame, script: DataFrame) -> DataFrame:
    """Lines by speaker that only the backup voice could say."""
    used = clips.where("used_backup and clip is not null").join(script.select("episode_id", "line_idx", "speaker"), ["episode_id", "line_idx"])
    return used.groupBy("speaker").agg(F.count(F.lit(1)).alias("lines")).orderBy(F.desc("lines"), "speaker")


class LanguageModel(Protocol):
    def reply(self, system: str, user: str) -> str: ...


class MediaTools(Protocol):
    """Binaries outside: audio from a video, a clip at another tempo, the finished video."""

    def extract_audio(self, video: str) -> tuple[bytes, bytes]: ...

    def at_tempo(self, clip: bytes, tempo: float) -> bytes: ...

    def duration(self, clip: bytes) -> float: ...

    def mux(self, video: str, dub: bytes, subtitles: str, burn: bool) -> str: ...


def fitted(tools: MediaTools, clip: bytes, tempo: float) -> bytes:
    """A clip at a tempo; up to one percent nothing is done."""
    return clip if tempo <= 1.01 else tools.at_tempo(clip, tempo)


def json_reply(model: LanguageModel, system: str, user: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON object of a model's reply, whatever stands around it; asks again if there is none."""

    def ask() -> dict:
        text = model.reply(system, user)
        found = json.loads(text[text.index("{") : text.rindex("}") + 1])
        if not isinstance(found, dict):
            raise ValueError("no object")
        return found

    return retry(ask, tries, 1.0, sleep)


def harvest(page: Callable[[int], list[dict]], most: int = 6) -> list[dict]:
    """The items of up to ``most`` pages; the first empty or failing page ends them, what was there before stays."""
    out: list[dict] = []
    for n in range(1, most + 1):
        try:
            items = page(n)
        except Exception:  # noqa: BLE001
            break
        if not items:
            break
        out += items
    return out


def search_hits(items: DataFrame, most: int = 25) -> DataFrame:
    """The first ``most`` voices by ``pos`` that nothing in their description rules out, as a person picks from them: gender
    is '?' where it is unknown, titles and descriptions are cut to 60 and 80 characters for the screen."""
    about = F.concat_ws(" ", "title", "description")
    gender = F.when(voice_gender(about) != "", voice_gender(about)).otherwise("?")
    short = F.replace(F.substring(F.coalesce("description", F.lit("")), 1, 80), F.lit("\n"), F.lit(" "))
    x = items.where(~is_bad_voice(about)).orderBy("pos").limit(most)
    return x.select("pos", "voice", F.substring("title", 1, 60).alias("title"), short.alias("description"), gender.alias("gender"), F.array_join("languages", ",").alias("languages"))


def ask_genders(model: LanguageModel, names: Iterable[str], most: int = 60) -> dict[str, str]:
    """Genders of the first ``most`` names that a language model knows; without an answer, none."""
    asked = list(names)[:most]
    try:
        found = json_reply(model, 'Reply with JSON only: {"genders": {"<name>": "MALE" or "FEMALE"}}.', "Genders of these characters: " + ", ".join(asked)).get("genders", {})
    except Exception:  # noqa: BLE001  names then go by their endings
        return {}
    return {n: g for n, g in found.items() if g in ("MALE", "FEMALE")}


def voice_candidates(items: DataFrame) -> DataFrame:
    """(pos, gender, voice) of a service's listing (pos, voice, title, description, languages): Mandarin voices of a known
    gender that nothing in their description rules out."""
    about = F.concat_ws(" ", "title", "description")
    x = items.where(is_chinese("languages", "title") & ~is_bad_voice(about)).withColumn("gender", voice_gender(about))
    return x.where("gender <> ''").select("pos", "gender", "voice")
