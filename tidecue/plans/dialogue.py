"""More registered queries with SQL: labels, segments, alignment votes, casting, worklists, subtitles, transcripts.

Users of ``events`` are episodes and their events lines; a label, a cluster and a gender follow from the event's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import align, attribute, identify, providers, segments, subtitles, timeline, translate, vad, voices
from ..sources import transcripts
from ..sources.profiles import Character, Profile

SHOW = Profile("Show", (Character("Ann", ("annie",), "F"), Character("Bob", ("bobby", "robert stone"), "M"), Character("Cid", (), "M")), skip_intro_seconds=0.0, theme_words=("sun", "moon", "star"))
#: Labels as scripts have them.
RAW = (
    "Ann", "BOB (laughs):", "bobby", "Robert  Stone", "robert stone", "Ann and Bob", "Ann, Cid", "everyone", "Ann's mother", "Old Bob", "Zed", "the", "Scene: a park",
    "R2", "..Ann..", "Mr. X", "all & guys", "Cid Stone", "A", "One Two Three Four Five", "", "Mary-Lou O'Neil:", "thank you", "ann/zed", "\"Annie\"", "Closing time", "Bob Q Public", "Zed and Yan",
)
TITLES = ("少女 soft", "deep Male voice", "ASMR whisper girl", "御姐 18+", "Narrator", "温柔 女声", "大叔", "boyfriend", "plain", "woman and man")
EMOTIONS = ("[sad]", " (angry) ", "calm", "", "x" * 31, "[ (very) happy ]", "[]", "tired\nbut ok")
GENDERS = ("MALE", "FEMALE", "", "FEMALE")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], by: str | Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(by) if isinstance(by, str) else by, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(values: tuple[str, ...], by: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({by}) % {len(values)} + 1]"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", _pick(RAW, "c_custkey").alias("raw"), _pick(TITLES, "c_custkey").alias("title"), _pick(EMOTIONS, "c_custkey").alias("emo"), F.col("c_acctbal").alias("bal"))


_NAMES = f"c AS (SELECT c_custkey, {_sql_pick(RAW, 'c_custkey')} AS raw, {_sql_pick(TITLES, 'c_custkey')} AS title, {_sql_pick(EMOTIONS, 'c_custkey')} AS emo, c_acctbal AS bal FROM customer)"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines an hour a second apart: episode_id, line_idx, start, end, en, raw, label, cluster, gender, sidx, zh, speaker, fallback."""
    from .catalog import _events

    e = _events(spark, sf_dir)
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 36000.0
    k = F.col("event_id")
    main = F.when(k % 3 != 0, _pick(("Ann", "Bob", "Ann", "OtherMale", "Skip"), "event_id"))
    return e.select(
        F.col("user_id").cast("string").alias("episode_id"), n.alias("line_idx"), at.alias("start"), (at + F.col("value") / 100).alias("end"), F.concat(F.col("event_type"), F.lit(" sun moon "), F.when(k % 2 == 0, "star").otherwise("sky")).alias("en"),
        _pick(RAW, "event_id").alias("raw"), main.alias("label"), F.when(k % 7 != 0, (k % 4).cast("int")).alias("cluster"), _pick(GENDERS, "event_id").alias("gender"), F.when(k % 5 != 0, (k % 11).cast("int")).alias("sidx"),
        _pick(("你好", "", "再见"), "event_id").alias("zh"), _pick(("Ann", "Skip", "Zed", "OtherMale"), "event_id").alias("speaker"), (k % 6 == 0).alias("fallback"), k.alias("event_id"), F.col("value"),
    )


_LINES = f"""l AS MATERIALIZED (SELECT user_id::VARCHAR AS episode_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS line_idx, epoch_us(ts) / 1e6 / 36000.0 AS start, epoch_us(ts) / 1e6 / 36000.0 + value / 100 AS "end",
  event_type || ' sun moon ' || CASE WHEN event_id % 2 = 0 THEN 'star' ELSE 'sky' END AS en, {_sql_pick(RAW, 'event_id')} AS raw, CASE WHEN event_id % 3 <> 0 THEN {_sql_pick(("Ann", "Bob", "Ann", "OtherMale", "Skip"), 'event_id')} END AS label,
  CASE WHEN event_id % 7 <> 0 THEN (event_id % 4)::INT END AS cluster, {_sql_pick(GENDERS, 'event_id')} AS gender, CASE WHEN event_id % 5 <> 0 THEN (event_id % 11)::INT END AS sidx, {_sql_pick(("你好", "", "再见"), 'event_id')} AS zh,
  {_sql_pick(("Ann", "Skip", "Zed", "OtherMale"), 'event_id')} AS speaker, event_id % 6 = 0 AS fallback, event_id, value FROM events)"""
_ID = '"episode_id", "line_idx"'


def valid_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("c_custkey", labels.valid_speaker("raw").alias("name"))


_NOT = ", ".join("'" + w.replace("'", "''") + "'" for w in labels.NOT_NAMES)
_VALID = rf"""(SELECT CASE WHEN length(t) BETWEEN 2 AND 40 AND NOT regexp_matches(t, '[0-9]') AND NOT regexp_matches(lower(t), '{labels.NOT_SPEAKERS}') AND lower(t) NOT IN ({_NOT})
  AND len(regexp_split_to_array(t, '\s+')) <= 4 AND regexp_matches(t, '[A-Za-z]{{2}}') THEN t END FROM (SELECT {_TRIM.format(r"regexp_replace(" + _TRIM.format(r"regexp_replace(" + _TRIM.format(r"regexp_replace({0}, '\(.*?\)', '', 'g')") + r", '^\.+|\.+$', '', 'g')") + r", ':+$', '')")} AS t))"""
VALID_SQL = f"WITH {_NAMES} SELECT c_custkey, {_VALID.replace('{0}', 'raw')} AS name FROM c"


def canonical_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("c_custkey", labels.canonical_speaker("raw", SHOW).alias("who"))


_ALIAS = "map {'ann': 'Ann', 'annie': 'Ann', 'bob': 'Bob', 'bobby': 'Bob', 'cid': 'Cid'}"
_GROUPS = "[" + ", ".join(f"'{g}'" for g in labels.GROUPS) + "]"
_WHO = rf"""(SELECT CASE WHEN n = '' OR regexp_matches(n, '''s\b|\b(?:{"|".join(labels.OTHER_PERSON)})\b') THEN 'GUEST' WHEN map_contains({_ALIAS}, n) THEN {_ALIAS}[n] WHEN n = 'robert stone' THEN 'Bob' WHEN list_contains({_GROUPS}, n) THEN 'GROUP'
  WHEN len(p) > 1 THEN CASE WHEN len(m) = 1 THEN {_ALIAS}[m[1]] WHEN len(m) > 1 THEN 'GROUP' WHEN len(list_filter(p, lambda x: NOT list_contains({_GROUPS}, x))) = 0 THEN 'GROUP' ELSE 'GUEST' END
  WHEN len(k) <= 3 AND map_contains({_ALIAS}, k[1]) THEN {_ALIAS}[k[1]] ELSE 'GUEST' END
  FROM (SELECT n, p, list_filter(p, lambda x: map_contains({_ALIAS}, x)) AS m, list_filter(regexp_split_to_array(n, '\s+'), lambda x: x <> '') AS k
  FROM (SELECT n, list_filter(list_transform(regexp_split_to_array(n, '\s*(?:,|\band\b|&|\+|/)\s*'), lambda x: trim(x)), lambda x: x <> '') AS p
  FROM (SELECT regexp_replace(regexp_replace(trim(regexp_replace(lower({{0}}), '\(.*?\)', '', 'g')), ':+$', ''), '^[."'']+|[."'']+$', '', 'g') AS n))))"""
CANONICAL_SQL = f"WITH {_NAMES} SELECT c_custkey, {_WHO.replace('{0}', 'raw')} AS who FROM c"


def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _names(spark, sf_dir)
    return x.select("c_custkey", labels.display_name("raw").alias("name"), labels.guest_gender("raw").alias("guest"), labels.role_gender(F.coalesce(labels.canonical_speaker("raw", SHOW), F.lit("")), SHOW).alias("role"), attribute.fallback_speaker("raw", SHOW).alias("fallback"))


_TITLED = r"array_to_string(list_transform(regexp_extract_all(lower({0}), '(\p{L}+|[^\p{L}]+)'), lambda x: upper(x[1:1]) || x[2:]), '')"
_SHOWN = rf"""(SELECT CASE WHEN length(t) BETWEEN 2 AND 30 THEN t END FROM (SELECT {_TITLED.replace("{0}", "u")} AS t FROM (SELECT {_TRIM.format(r"regexp_replace(" + _TRIM.format(r"regexp_replace({0}, '\(.*?\)', '', 'g')") + r", '^:+|:+$', '', 'g')")} AS u)))"""
DISPLAY_SQL = f"""WITH {_NAMES}, d AS (SELECT c_custkey, raw, {_SHOWN.replace('{0}', 'raw')} AS name, {_WHO.replace('{0}', 'raw')} AS who FROM c)
SELECT c_custkey, name, CASE WHEN regexp_matches(lower(raw), '(a|ie|y|elle|ine)$') THEN 'FEMALE' ELSE 'MALE' END AS guest, CASE WHEN who IN ('Bob', 'Cid', 'OtherMale') THEN 'MALE' ELSE 'FEMALE' END AS role,
  CASE WHEN who IN ('Ann', 'Bob', 'Cid') THEN who WHEN who = 'GROUP' THEN 'OtherFemale' ELSE coalesce(name, 'OtherMale') END AS fallback FROM d"""


def voice_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _names(spark, sf_dir).withColumn("f0", F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 500).cast("double"))
    spoken = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("ZH-cn"))).otherwise(F.array(F.lit("en")))
    return x.select("c_custkey", labels.voice_gender("title").alias("gender"), labels.is_bad_voice("title").alias("bad"), labels.has_cjk("title").alias("cjk"), labels.is_chinese(spoken, "title").alias("chinese"), labels.pitch_allowed("f0").alias("allowed"))


def _has(words: tuple[str, ...]) -> str:
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda h: contains(lower(title), h))) > 0"


METADATA_SQL = f"""WITH {_NAMES} SELECT c_custkey, CASE WHEN {_has(labels.FEMALE_HINTS)} THEN 'FEMALE' WHEN {_has(labels.MALE_HINTS)} THEN 'MALE' ELSE '' END AS gender, {_has(labels.DENIED)} AS bad, regexp_matches(title, '[一-鿿]') AS cjk,
  c_custkey % 4 = 0 OR regexp_matches(title, '[一-鿿]') AS chinese, c_custkey % 9 = 0 OR c_custkey % 500 <= 300 AS allowed FROM c"""


def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _names(spark, sf_dir)
    return x.select("c_custkey", text.clean_emotion("emo").alias("emo"), text.clean_script_text(F.concat("raw", F.lit(" [x]  y ("), "title", F.lit(") z"))).alias("said"), text.fit_key("raw", F.lit(1.25)).alias("key"))


CLEAN_SQL = rf"""WITH {_NAMES}, e AS (SELECT *, regexp_replace(replace({_TRIM.format('emo')}, chr(10), ' '), '^[\[\]() ]+|[\[\]() ]+$', '', 'g') AS m FROM c)
SELECT c_custkey, CASE WHEN length(trim(m)) BETWEEN 1 AND 30 THEN '[' || trim(m) || ']' ELSE '' END AS emo, trim(regexp_replace(regexp_replace(regexp_replace(raw || ' [x]  y (' || title || ') z', '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS said,
  substr(sha1(raw || '|1.2500'), 1, 20) AS key FROM e"""


def credible_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir).withColumns({"no_speech_prob": F.col("value") / 100, "compression_ratio": (F.col("event_id") % 40) / 10, "avg_logprob": -(F.col("event_id") % 13) / 10, "en": F.when(F.col("event_id") % 17 != 0, F.col("en")).otherwise("  ")})
    return segments.credible(x).select("episode_id", "line_idx", "event_id")


CREDIBLE_SQL = f"""WITH {_LINES} SELECT {_ID}, event_id FROM l WHERE event_id % 17 <> 0 AND NOT (value / 100 > 0.6 OR ((event_id % 40) / 10 > 2.4 AND -(event_id % 13) / 10 < -0.5))"""


def monotone_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = segments.monotone_times(_lines(spark, sf_dir).select("episode_id", "line_idx", "start", (F.col("start") + F.col("value") * 100).alias("end")))
    return x.select("episode_id", "line_idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


MONOTONE_SQL = f"""WITH RECURSIVE {_LINES}, f AS (SELECT episode_id, line_idx, start AS s, start + value * 100 AS e FROM l WHERE line_idx = 0
  UNION ALL SELECT l.episode_id, l.line_idx, CASE WHEN l.start < f.e THEN f.e ELSE l.start END, CASE WHEN l.start < f.e THEN greatest(l.start + l.value * 100, f.e + 0.3) ELSE l.start + l.value * 100 END FROM f JOIN l ON l.episode_id = f.episode_id AND l.line_idx = f.line_idx + 1)
SELECT {_ID}, round(s, 6) AS start, round(e, 6) AS "end" FROM f"""


def merge_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    x = x.select("episode_id", "line_idx", "start", "end", F.when(F.col("event_id") % 3 == 0, F.concat("en", F.lit("."))).otherwise(F.col("en")).alias("en"), F.lit(None).cast("array<struct<s:double,e:double>>").alias("words"))
    x = segments.merge_utterances(x, most_gap=40.0, most_length=300.0)
    return x.select("episode_id", F.col("line_idx").cast("long").alias("utterance"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "en")


UTTERANCES_SQL = f"""WITH RECURSIVE {_LINES}, x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN en || '.' ELSE en END AS t FROM l),
y AS MATERIALIZED (SELECT *, coalesce(start - lag("end") OVER w <= 40.0 AND NOT (lag(event_id) OVER w % 3 = 0), false) AS near FROM x WINDOW w AS (PARTITION BY episode_id ORDER BY line_idx)),
f AS (SELECT episode_id, line_idx, 0 AS g, start AS s0 FROM y WHERE line_idx = 0
  UNION ALL SELECT y.episode_id, y.line_idx, CASE WHEN near AND y."end" - f.s0 <= 300.0 THEN g ELSE g + 1 END, CASE WHEN near AND y."end" - f.s0 <= 300.0 THEN s0 ELSE y.start END FROM f JOIN y ON y.episode_id = f.episode_id AND y.line_idx = f.line_idx + 1)
SELECT f.episode_id, g::BIGINT AS utterance, round(arg_min(y.start, y.line_idx), 6) AS start, round(arg_max(y."end", y.line_idx), 6) AS "end", string_agg(t, ' ' ORDER BY y.line_idx) AS en FROM f JOIN y ON y.episode_id = f.episode_id AND y.line_idx = f.line_idx GROUP BY 1, 2"""


def word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts as the words of a line."""
    li = _t(spark, sf_dir, "lineitem").withColumns({"s": F.col("l_linenumber") + F.col("l_tax"), "e": F.col("l_linenumber") + F.col("l_discount") * 30 - 0.5})
    li = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("words"))
    x = timeline.raw_windows(li.select("l_orderkey", F.lit(1.0).alias("start"), F.lit(2.0).alias("end"), "words"))
    kept = segments.valid_words("words")
    return x.select("l_orderkey", F.size(kept).cast("long").alias("n_words"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, w: a + w["e"] - w["s"]), 6).alias("spoken"), F.round("onset", 6).alias("onset"), F.round("word_end", 6).alias("word_end"))


WORD_TIMES_SQL = """WITH w AS (SELECT l_orderkey, l_linenumber + l_tax AS s, l_linenumber + l_discount * 30 - 0.5 AS e FROM lineitem), v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e) AS k FROM w WHERE e > s),
p AS (SELECT *, lead(s) OVER (PARTITION BY l_orderkey ORDER BY k) - e > 2.0 AS pause FROM v),
a AS (SELECT l_orderkey, count(*) AS n, sum((floor(e * 1000.0 + 0.5) / 1000.0) - (floor(s * 1000.0 + 0.5) / 1000.0)) AS spoken, min(s) AS o, coalesce(arg_min(e, k) FILTER (pause), arg_max(e, k)) AS x FROM p GROUP BY 1)
SELECT l_orderkey, coalesce(n, 0) AS n_words, round(coalesce(spoken, 0.0), 6) AS spoken, round(coalesce(o, 1.0), 6) AS onset, round(greatest(coalesce(x, 2.0), coalesce(o, 1.0) + 0.3), 6) AS word_end FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN a USING (l_orderkey)"""


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as heard lines; each word names the script line of its length modulo 4."""
    heard = _t(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").cast("int").alias("line_idx"), F.col("text").alias("en"))
    m = heard.select("episode_id", "line_idx", F.posexplode(text.norm_words("en")).alias("k", "w"))
    return heard, m.select("episode_id", "line_idx", (F.length("w") % 4).alias("sidx"), (F.col("line_idx") * 10.0 + F.col("k") * 0.25).alias("s"), (F.col("line_idx") * 10.0 + F.col("k") * 0.25 + 0.2).alias("e"))


_WORDS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z'']+'), lambda x: length(x) > 1)"
_MATCHES = f"""h AS MATERIALIZED (SELECT conv_id::VARCHAR AS episode_id, turn::INT AS line_idx, text AS en, {_WORDS.format("text")} AS w FROM conversations),
m AS MATERIALIZED (SELECT episode_id, line_idx, len(w) AS n, (length(w[i]) % 4)::INT AS sidx, line_idx * 10.0::DOUBLE + (i - 1) * 0.25::DOUBLE AS s, line_idx * 10.0::DOUBLE + (i - 1) * 0.25::DOUBLE + 0.2::DOUBLE AS e FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM h))"""


def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard, m = _matches(spark, sf_dir)
    return align.best_lines(m, heard)


BEST_LINES_SQL = f"""WITH {_MATCHES}, v AS (SELECT episode_id, line_idx, n, sidx, count(*) AS c FROM m GROUP BY ALL)
SELECT {_ID}, sidx FROM v WHERE c / greatest(n, 1) >= 0.34 QUALIFY row_number() OVER (PARTITION BY episode_id, line_idx ORDER BY c DESC, sidx) = 1"""


def anchored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard, m = _matches(spark, sf_dir)
    script = heard.select("episode_id", F.col("line_idx").alias("sidx"), F.col("en").alias("text"))
    return align.anchored_spans(m, script).withColumn("n", F.col("n").cast("long"))


ANCHORED_SQL = f"""WITH {_MATCHES}, r AS (SELECT episode_id, sidx, min(s) AS o, max(e) AS x, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT episode_id, line_idx AS sidx, greatest(len(w), 1) AS k FROM h)
SELECT episode_id, sidx, floor(o * 1000.0 + 0.5) / 1000.0 AS onset, floor(greatest(x, o + 0.3) * 1000.0 + 0.5) / 1000.0 AS "end", n FROM r JOIN t USING (episode_id, sidx) WHERE n / k >= 0.34 AND (n >= 2 OR k <= 4)"""


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir).select("episode_id", F.when(F.col("event_id") % 2 == 0, F.col("sidx")).alias("exact_sidx"), "sidx")
    return identify.match_report(x).withColumn("matched", F.round("matched", 6))


REPORT_SQL = f"""WITH {_LINES}, r AS (SELECT episode_id, count(*) AS lines, count(CASE WHEN event_id % 2 = 0 THEN sidx END) AS exact, count(sidx) AS k FROM l GROUP BY 1)
SELECT episode_id, lines, exact, k - exact AS inferred, round(k / lines, 6) AS matched, k / lines < 0.55 AS doubtful FROM r"""


def script_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    show = Profile("Show", SHOW.characters, skip_intro_seconds=float(2**19) / 11, theme_words=SHOW.theme_words)
    return attribute.script_labels(_lines(spark, sf_dir), show).select("episode_id", "line_idx", "label", "guest")


_CG = "g AS (SELECT episode_id, cluster, CASE WHEN count_if(gender = 'MALE') > count_if(gender = 'FEMALE') THEN 'MALE' WHEN count_if(gender = 'FEMALE') > count_if(gender = 'MALE') THEN 'FEMALE' ELSE '' END AS cg FROM l WHERE cluster IS NOT NULL GROUP BY 1, 2)"
SCRIPT_LABELS_SQL = f"""WITH {_LINES}, {_CG}, x AS (SELECT l.*, CASE WHEN coalesce(cg, '') <> '' THEN cg ELSE gender END AS voice, {_WHO.replace('{0}', 'l.raw')} AS who, {_SHOWN.replace('{0}', 'l.raw')} AS shown FROM l LEFT JOIN g ON g.episode_id = l.episode_id AND g.cluster = l.cluster),
y AS (SELECT *, CASE WHEN voice = 'FEMALE' THEN 'OtherFemale' ELSE 'OtherMale' END AS guest FROM x)
SELECT {_ID}, CASE WHEN start < {float(2**19) / 11} THEN 'Skip' WHEN raw = '' THEN CASE WHEN event_id % 2 = 0 THEN 'Skip' END WHEN who IN ('Ann', 'Bob', 'Cid') THEN who WHEN who = 'GROUP' THEN NULL ELSE coalesce(shown, guest) END AS label, guest FROM y"""


def cluster_genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute.cluster_genders(_lines(spark, sf_dir))


CLUSTER_GENDERS_SQL = f"WITH {_LINES}, {_CG} SELECT episode_id, cluster, cg AS gender FROM g"


def cluster_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open lines by cluster, then the guard that gives a strong cluster's lines to its owner."""
    x = attribute.fill_by_cluster(_lines(spark, sf_dir), SHOW)
    return attribute.correct_by_cluster(x, SHOW).select("episode_id", "line_idx", "label")


def _owner(source: str) -> str:
    return f"""(SELECT episode_id, cluster, label AS owner, n FROM (SELECT episode_id, cluster, label, count(*) AS n, min(line_idx) AS f FROM {source} WHERE label IN ('Ann', 'Bob', 'Cid') AND cluster IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY episode_id, cluster ORDER BY n DESC, f) = 1)"""


CLUSTER_FILL_SQL = f"""WITH {_LINES}, a AS MATERIALIZED (SELECT l.episode_id, l.line_idx, l.cluster, l.gender, coalesce(label, owner) AS label FROM l LEFT JOIN {_owner("l")} o ON o.episode_id = l.episode_id AND o.cluster = l.cluster),
k AS (SELECT episode_id, cluster, count(*) AS members FROM a WHERE cluster IS NOT NULL GROUP BY 1, 2),
s AS (SELECT o.* FROM {_owner("a")} o JOIN k USING (episode_id, cluster) WHERE n >= 4 AND n / members >= 0.8)
SELECT a.episode_id, a.line_idx, CASE WHEN owner IS NOT NULL AND coalesce(label, '') <> 'Skip' AND coalesce(label, '') NOT IN ('Ann', 'Bob', 'Cid') AND (gender = '' OR gender = CASE WHEN owner = 'Ann' THEN 'FEMALE' ELSE 'MALE' END) THEN owner ELSE label END AS label
FROM a LEFT JOIN s ON s.episode_id = a.episode_id AND s.cluster = a.cluster"""


def cluster_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute.cast_tally(attribute.cluster_majority(_lines(spark, sf_dir).withColumn("label", F.coalesce("label", F.lit("Zed")))))


CLUSTER_MAJORITY_SQL = f"""WITH {_LINES}, x AS (SELECT *, coalesce(label, 'Zed') AS lab FROM l),
b AS (SELECT episode_id, cluster, lab AS best FROM (SELECT episode_id, cluster, lab, count(*) AS n, min(line_idx) AS f FROM x WHERE lab <> 'Skip' AND cluster IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY episode_id, cluster ORDER BY n DESC, f) = 1)
SELECT x.episode_id, CASE WHEN lab = 'Skip' THEN 'Skip' ELSE coalesce(best, lab) END AS label, count(*) AS lines FROM x LEFT JOIN b ON b.episode_id = x.episode_id AND b.cluster = x.cluster GROUP BY 1, 2"""


def worklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to translate and lines to voice, with the context that a translator sees."""
    x = translate.with_context(_lines(spark, sf_dir).select("episode_id", "line_idx", "start", "end", "speaker", "en", "zh", "fallback"), 2)
    a = translate.worklist(x).select("episode_id", "line_idx", F.lit("translate").alias("todo"), "budget", "context")
    return a.unionByName(translate.synthesis_worklist(x).select("episode_id", "line_idx", F.lit("voice").alias("todo"), "budget", "context"))


WORKLISTS_SQL = f"""WITH {_LINES}, c AS (SELECT *, concat_ws(chr(10), lag(speaker || ': ' || en, 2) OVER w, lag(speaker || ': ' || en) OVER w) AS context, greatest(floor(greatest("end" - start, 0.6) * 4.6)::INT, 4)::INT AS budget FROM l WINDOW w AS (PARTITION BY episode_id ORDER BY line_idx))
SELECT {_ID}, 'translate' AS todo, budget, context FROM c WHERE speaker <> 'Skip' AND zh = '' UNION ALL SELECT {_ID}, 'voice', budget, context FROM c WHERE speaker <> 'Skip' AND zh <> '' AND NOT fallback"""


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.review_rows(_lines(spark, sf_dir))


REVIEW_SQL = f"""WITH {_LINES} SELECT episode_id, line_idx AS idx, printf('%.2f', start) AS start, speaker, en, zh FROM l"""


def retained_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed lines, then what could not be voiced, in one numbered table."""
    x = _lines(spark, sf_dir)
    placed = x.where("speaker <> 'Skip' and zh <> '' and line_idx % 2 = 0").select("episode_id", "line_idx", "start", "end", "zh")
    out = subtitles.subtitle_table(placed, subtitles.retained(x, placed))
    return out.select("episode_id", F.col("seq").cast("long").alias("seq"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "zh")


RETAINED_SQL = f"""WITH {_LINES}, p AS (SELECT * FROM l WHERE speaker <> 'Skip' AND zh <> '' AND line_idx % 2 = 0),
r AS (SELECT episode_id, start, greatest("end", start + 1.0) AS "end", CASE WHEN zh <> '' THEN zh ELSE en END AS zh FROM l ANTI JOIN p USING (episode_id, line_idx) WHERE speaker <> 'Skip' AND NOT fallback),
u AS (SELECT episode_id, start, "end", zh, 0 AS part FROM p UNION ALL SELECT *, 1 FROM r)
SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY start, part, "end", zh) - 1 AS seq, round(start, 6) AS start, round("end", 6) AS "end", zh FROM u"""


def placed_by_sidx(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = subtitles.placed_by_sidx(_lines(spark, sf_dir))
    return x.select("episode_id", "sidx", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


def voice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = voices.voice_windows(_lines(spark, sf_dir).select("episode_id", "line_idx", F.lit(0.0).alias("start"), (F.col("value") / 20).alias("end")))
    return x.select("episode_id", "line_idx", F.col("win_idx").cast("long").alias("win_idx"), F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


VOICE_WINDOWS_SQL = f"""WITH {_LINES}, w AS (SELECT episode_id, line_idx, value / 20 AS d, unnest(range(0, CASE WHEN value / 20 > 1.5 THEN floor((value / 20 - 1.5) / 0.75)::BIGINT ELSE 0 END + 1)) AS win_idx FROM l WHERE value / 20 >= 0.45)
SELECT {_ID}, win_idx, round(win_idx * 0.75::DOUBLE, 6) AS s, round(least(win_idx * 0.75::DOUBLE + 1.5, d), 6) AS e FROM w WHERE least(win_idx * 0.75::DOUBLE + 1.5, d) - win_idx * 0.75::DOUBLE >= 0.45"""


def sampled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir).where("cluster is not null").select("cluster", F.col("event_id").alias("line_idx"))
    return voices.sample_lines(x)


SAMPLED_SQL = f"""WITH {_LINES}, x AS (SELECT cluster, event_id AS line_idx, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY event_id) - 1 AS k FROM l WHERE cluster IS NOT NULL)
SELECT cluster, line_idx FROM x WHERE k % greatest(n // 16, 1) = 0 AND k / greatest(n // 16, 1) < 16"""


def voice_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first voices of each gender, speakers without a voice, and what stands in for a voice that fails."""
    pool = _names(spark, sf_dir).select(F.col("c_custkey").alias("pos"), labels.voice_gender("title").alias("gender"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("voice")).where("gender <> ''")
    top = voices.top_voices(pool).select(F.lit("pool").alias("kind"), F.col("voice").alias("who"), F.col("gender").alias("what"))
    script = _lines(spark, sf_dir)
    have = spark.createDataFrame([("Ann", "a1"), ("OtherMale", "m1"), ("OtherFemale", "f1")], "speaker string, voice string")
    none = voices.missing_voices(script, have).select(F.lit("missing").alias("kind"), F.col("speaker").alias("who"), F.lit("").alias("what"))
    back = voices.backup_voices(script.select("speaker").distinct(), have, spark.createDataFrame([("Zed", "FEMALE")], "speaker string, gender string"))
    return top.unionByName(none).unionByName(back.select(F.lit("backup").alias("kind"), F.col("speaker").alias("who"), F.col("backup").alias("what")))


VOICE_CHOICE_SQL = f"""WITH {_NAMES}, {_LINES}, g AS (SELECT c_custkey, CASE WHEN {_has(labels.FEMALE_HINTS)} THEN 'FEMALE' WHEN {_has(labels.MALE_HINTS)} THEN 'MALE' ELSE '' END AS gender FROM c)
SELECT 'pool' AS kind, 'v' || c_custkey AS who, gender AS what FROM (SELECT * FROM g WHERE gender <> '' QUALIFY row_number() OVER (PARTITION BY gender ORDER BY c_custkey) <= 20)
UNION ALL SELECT DISTINCT 'missing', speaker, '' FROM l WHERE speaker NOT IN ('Skip', 'Ann', 'OtherMale', 'OtherFemale') AND NOT fallback
UNION ALL SELECT DISTINCT 'backup', speaker, CASE WHEN speaker = 'OtherMale' THEN '' WHEN speaker = 'Zed' OR regexp_matches(lower(speaker), '(a|ie|y|elle|ine)$') THEN 'f1' ELSE 'm1' END FROM l"""


def _transcripts(spark: SparkSession, sf_dir: str, srt: bool) -> DataFrame:
    """A conversation as one text: two of three turns have a name, others go on."""
    c = _t(spark, sf_dir, "conversations")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n\x0B\x0C\x85\x{2028}\x{2029}:&]", " ")
    line = F.when(F.col("turn") % 3 != 2, F.concat(_pick(("Ann: ", "BOB : ", "the: ", "Scene: "), F.col("conv_id") + F.col("turn")), plain)).otherwise(plain)
    if srt:
        line = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), line, F.lit("\n"))
    x = c.groupBy(F.col("conv_id").cast("string").alias("episode_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return x.select("episode_id", F.array_join("l.line", "\n").alias("content"))


_TURNS = r"""c AS (SELECT conv_id::VARCHAR AS episode_id, turn, CASE WHEN turn % 3 <> 2 THEN ['Ann: ', 'BOB : ', 'the: ', 'Scene: '][(conv_id + turn) % 4 + 1] ELSE '' END AS head,
  regexp_replace(coalesce(text, ''), '[\r\n\x0B\x0C\x{85}\x{2028}\x{2029}:&]', ' ', 'g') AS said FROM conversations),
d AS (SELECT episode_id, turn, CASE WHEN head = 'Ann: ' THEN 'Ann' WHEN head = 'BOB : ' THEN 'BOB' END AS speaker, CASE WHEN head IN ('Ann: ', 'BOB : ') THEN said ELSE head || said END AS spoken, head FROM c),
b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(spoken, '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM d)"""


def name_colon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_name_colon(_transcripts(spark, sf_dir, False))


NAME_COLON_SQL = f"""WITH {_TURNS}, s AS (SELECT *, speaker IS NOT NULL AND length(body) >= 2 AS starts FROM b), k AS (SELECT * FROM s WHERE starts OR (speaker IS NULL AND body <> '')),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY episode_id ORDER BY turn) - 1 AS sidx FROM k)
SELECT episode_id, sidx::INT AS sidx, max(speaker) AS speaker, string_agg(body, ' ' ORDER BY turn) AS text FROM n WHERE sidx >= 0 GROUP BY 1, 2"""


def srt_with_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.parse_srt_with_speakers(_transcripts(spark, sf_dir, True))


#: A cue's label goes also where it is no name.
SRT_SQL = f"""WITH {_TURNS.replace("CASE WHEN head IN ('Ann: ', 'BOB : ') THEN said ELSE head || said END", "said")}, k AS (SELECT * FROM b WHERE length(body) >= 2),
n AS (SELECT *, sum((speaker IS NOT NULL)::INT) OVER (PARTITION BY episode_id ORDER BY turn) - 1 AS sidx FROM k)
SELECT episode_id, sidx::INT AS sidx, max(speaker) AS speaker, string_agg(body, ' ' ORDER BY turn) AS text FROM n WHERE sidx >= 0 GROUP BY 1, 2"""


def _clip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to be voiced, and the stamp of the clip that each has from before."""
    x = _lines(spark, sf_dir).withColumns({"voice": F.col("speaker"), "emo": _pick(("", "[sad]"), "event_id"), "backup": _pick(("bak", "", "Ann"), "event_id"), "provider": F.lit("p")})
    old = F.when(F.col("event_id") % 3 == 0, F.col("voice")).when(F.col("event_id") % 3 == 1, "bak").otherwise("old")
    return x.withColumn("stamp", F.concat_ws("|", "zh", old, _pick(("", "[sad]", "[mad]"), F.expr("event_id div 2")), "provider"))


_CLIPS = f"""{_LINES}, k AS (SELECT *, speaker AS voice, {_sql_pick(("", "[sad]"), "event_id")} AS emo, {_sql_pick(("bak", "", "Ann"), "event_id")} AS backup, CASE event_id % 3 WHEN 0 THEN speaker WHEN 1 THEN 'bak' ELSE 'old' END AS old,
  {_sql_pick(("", "[sad]", "[mad]"), "event_id // 2")} AS olde FROM l)"""


def clip_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which voices and emotions are tried for a line."""
    said = F.transform(providers.attempts(), lambda a: F.concat_ws("/", a["voice"], a["emotion"], a["backup"].cast("string")))
    return _clip_lines(spark, sf_dir).select("episode_id", "line_idx", F.array_join(said, ",").alias("attempts"))


ATTEMPTS_SQL = f"""WITH {_CLIPS} SELECT {_ID}, voice || '/' || emo || '/false' || CASE WHEN emo <> '' THEN ',' || voice || '//false' ELSE '' END
  || CASE WHEN backup IN ('', voice) THEN '' ELSE ',' || backup || '/' || emo || '/true' || CASE WHEN emo <> '' THEN ',' || backup || '//true' ELSE '' END END AS attempts FROM k"""


def clip_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips made before that are still good for their line."""
    x = _clip_lines(spark, sf_dir)
    made = x.select("episode_id", "line_idx", "stamp", F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string").cast("binary")).alias("clip"))
    return providers.reusable_clips(x.drop("stamp"), made).withColumn("clip", F.col("clip").cast("string"))


REUSE_SQL = f"WITH {_CLIPS} SELECT {_ID}, event_id::VARCHAR AS clip FROM k WHERE event_id % 5 <> 0 AND old <> '' AND old IN (voice, backup) AND olde IN ('', emo)"


def listed_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search shows of a service's listing, and which listed voices are candidates for guests."""
    x = _names(spark, sf_dir).select(F.col("c_custkey").alias("pos"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("voice"), "title", F.col("emo").alias("description"), F.array(F.when(F.col("c_custkey") % 4 == 0, "ZH-cn").otherwise("en")).alias("languages"))
    hits = providers.search_hits(x).select(F.lit("hit").alias("kind"), "pos", "voice", "gender", "description", "languages")
    return hits.unionByName(providers.voice_candidates(x).select(F.lit("candidate").alias("kind"), "pos", "voice", "gender", F.lit("").alias("description"), F.lit("").alias("languages")))


LISTED_SQL = f"""WITH {_NAMES}, v AS (SELECT c_custkey AS pos, 'v' || c_custkey AS voice, title AS t, title || ' ' || emo AS title, emo, CASE WHEN c_custkey % 4 = 0 THEN 'ZH-cn' ELSE 'en' END AS spoken FROM c),
g AS (SELECT *, CASE WHEN {_has(labels.FEMALE_HINTS)} THEN 'FEMALE' WHEN {_has(labels.MALE_HINTS)} THEN 'MALE' ELSE '' END AS gender FROM v WHERE NOT {_has(labels.DENIED)})
SELECT 'hit' AS kind, pos, voice, CASE WHEN gender = '' THEN '?' ELSE gender END AS gender, replace(substr(emo, 1, 80), chr(10), ' ') AS description, spoken AS languages FROM (SELECT * FROM g ORDER BY pos LIMIT 25)
UNION ALL SELECT 'candidate', pos, voice, gender, '', '' FROM g WHERE gender <> '' AND (spoken = 'ZH-cn' OR regexp_matches(t, '[一-鿿]'))"""


def guest_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices that a user pasted, a gender and an identifier on a line."""
    k = F.col("p_partkey")
    first = F.concat(_pick(("女 ", "Female: ", "male ", "M-", "# f ", "x "), "p_partkey"), F.expr("repeat('a1', int(p_partkey % 20))"))
    text = F.concat(first, F.lit("\n  男 "), F.md5(k.cast("string")), F.lit(" note"))
    return voices.parse_guest_pool(_t(spark, sf_dir, "part").select(text.alias("text")))


GUEST_POOL_SQL = f"""SELECT 0 AS pos, CASE WHEN p_partkey % 6 < 2 THEN 'FEMALE' ELSE 'MALE' END AS gender, repeat('a1', (p_partkey % 20)::INT) AS voice FROM part WHERE p_partkey % 6 < 4 AND p_partkey % 20 >= 12
UNION ALL SELECT 1, 'MALE', md5(p_partkey::VARCHAR) FROM part"""


def enough_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiceprints of the episodes that have enough lines for clusters."""
    return voices.enough_lines(_lines(spark, sf_dir).where("event_id % 5 = 0").select("episode_id", "line_idx"))


ENOUGH_SQL = f"WITH {_LINES}, p AS (SELECT * FROM l WHERE event_id % 5 = 0) SELECT {_ID} FROM p WHERE episode_id IN (SELECT episode_id FROM p GROUP BY 1 HAVING count(DISTINCT line_idx) >= 8)"


def energy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet stretches by energy; suppliers are recordings and their line items frames, loud and quiet in turns. Where a
    model found regions enough, those are taken."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    x = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.row_number().over(order) - 1).alias("frame_idx"), F.col("l_quantity").cast("double").alias("q"))
    frames = x.select(F.col("k").cast("string").alias("episode_id"), "frame_idx", F.when(F.expr("frame_idx div (9 + k % 40) % 2 = 0"), F.col("q") / 1e6).otherwise(F.col("q")).alias("power"))
    found = _t(spark, sf_dir, "supplier").where("s_suppkey % 6 > 0").select(F.col("s_suppkey").cast("string").alias("episode_id"), F.explode(F.expr("sequence(1, int(s_suppkey % 6))")).alias("j"))
    found = found.select("episode_id", F.col("j").cast("double").alias("s"), (F.col("j") + 0.5).alias("e"))
    return vad.choose_regions(found, vad.energy_silences(frames))


def _flipped(source: str, value: str, least: int) -> str:
    return f"""(SELECT episode_id, i, CASE WHEN m = {value} AND count(*) OVER (PARTITION BY episode_id, m, g) < {least} THEN NOT m ELSE m END AS m
  FROM (SELECT *, i - row_number() OVER (PARTITION BY episode_id, m ORDER BY i) AS g FROM {source}))"""


ENERGY_SQL = f"""WITH f AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, l_quantity::DOUBLE AS q FROM lineitem),
p AS (SELECT k::VARCHAR AS episode_id, i, CASE WHEN i // (9 + k % 40) % 2 = 0 THEN q / 1e6 ELSE q END AS power FROM f),
d AS MATERIALIZED (SELECT episode_id, i, 10 * log10((power + coalesce(lag(power) OVER (PARTITION BY episode_id ORDER BY i), 0)) / 2 + 1e-12) AS db FROM p),
v AS (SELECT episode_id, quantile_cont(db, 0.10) AS lo, quantile_cont(db, 0.95) AS hi FROM d GROUP BY 1 HAVING count(*) >= 3 AND quantile_cont(db, 0.95) - quantile_cont(db, 0.10) >= 1e-6),
m AS MATERIALIZED (SELECT episode_id, i, db > lo + {vad.THRESHOLD} * (hi - lo) AS m FROM d JOIN v USING (episode_id)),
c AS MATERIALIZED {_flipped("m", "false", round(vad.CLOSE / vad.FRAME))}, o AS MATERIALIZED {_flipped("c", "true", round(vad.MIN_SPEECH / vad.FRAME))},
q AS (SELECT episode_id, min(i) * {vad.FRAME}::DOUBLE AS s, (max(i) + 1) * {vad.FRAME}::DOUBLE AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY episode_id ORDER BY i) AS g FROM o WHERE NOT m) GROUP BY episode_id, g),
n AS (SELECT s_suppkey::VARCHAR AS episode_id, unnest(range(1, s_suppkey % 6 + 1))::DOUBLE AS s, s_suppkey % 6 AS found FROM supplier)
SELECT episode_id, s, s + 0.5 AS e, 'neural' AS source FROM n WHERE found >= 3
UNION ALL SELECT episode_id, round(s, 3), round(e, 3), 'energy' FROM q WHERE e - s >= {vad.MIN_SILENCE} AND episode_id NOT IN (SELECT episode_id FROM n WHERE found >= 3)"""


#: Recognised lines, some with two voices.
SPOKEN = ("- Abcd. - Efgh?", "just one", "- One. - Two! — Three", "no - split here", "\u2013 Well\u2026 \u2013 no.", "-  alone", "", "A. - B")


def split_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with several voices become lines of their own."""
    words = F.expr("CASE WHEN event_id % 6 > 0 THEN transform(sequence(1, int(event_id % 6)), j -> named_struct('s', start + j * 0.1D, 'e', start + j * 0.1D + 0.05D)) END")
    x = _lines(spark, sf_dir).select("episode_id", "line_idx", "start", "end", _pick(SPOKEN, "event_id").alias("en"), words.alias("words"))
    x = segments.split_merged(x)
    return x.select("episode_id", "line_idx", "part", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), "en", F.size("words").alias("words"))


SPLIT_SQL = rf"""WITH {_LINES}, x AS (SELECT episode_id, line_idx, start, "end" AS fin, (event_id % 6)::INT AS nw,
  regexp_replace(trim({_sql_pick(SPOKEN, 'event_id')}), '^[-–—]\s*', '') AS t FROM l),
p AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(t, '([.?!…"])\s+[-–—]\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS q FROM x),
r AS (SELECT *, CASE WHEN len(q) > 1 THEN q ELSE [t] END AS parts FROM p),
n AS (SELECT *, unnest(range(0, len(parts))) AS part, greatest(length(array_to_string(parts, '')), 1) AS chars FROM r),
k AS (SELECT *, parts[part + 1] AS en, length(array_to_string(parts[1:part], '')) AS gone, coalesce(list_sum(list_transform(parts[1:part], lambda y: round_even(nw * length(y) / chars, 0))), 0)::INT AS taken FROM n),
w AS (SELECT *, greatest(least(nw - taken, CASE WHEN part = len(parts) - 1 THEN nw ELSE round_even(nw * length(en) / chars, 0)::INT END), 0) AS words FROM k),
z AS (SELECT *, CASE WHEN len(parts) = 1 THEN start WHEN words > 0 THEN start + (taken + 1) * 0.1::DOUBLE ELSE round(start + (fin - start) * gone / chars, 3) END AS b FROM w)
SELECT {_ID}, part::INT AS part, round(b, 5) AS start, round(CASE WHEN len(parts) = 1 THEN fin WHEN words > 0 THEN greatest(start + (taken + words) * 0.1::DOUBLE + 0.05::DOUBLE, b + 0.3) ELSE round(start + (fin - start) * (gone + length(en)) / chars, 3) END, 5) AS "end", en, words::INT AS words FROM z"""


_QUERIES: tuple[tuple[Callable[[SparkSession, str], DataFrame], str], ...] = (
    (valid_speaker, VALID_SQL), (canonical_speaker, CANONICAL_SQL), (display_name, DISPLAY_SQL), (voice_metadata, METADATA_SQL), (clean_fields, CLEAN_SQL), (credible_segments, CREDIBLE_SQL),
    (monotone_times, MONOTONE_SQL), (merge_utterances, UTTERANCES_SQL), (word_times, WORD_TIMES_SQL), (best_lines, BEST_LINES_SQL), (anchored_spans, ANCHORED_SQL), (match_report, REPORT_SQL),
    (script_labels, SCRIPT_LABELS_SQL), (cluster_genders, CLUSTER_GENDERS_SQL), (cluster_fill, CLUSTER_FILL_SQL), (cluster_majority, CLUSTER_MAJORITY_SQL), (worklists, WORKLISTS_SQL), (review_rows, REVIEW_SQL),
    (retained_subtitles, RETAINED_SQL), (placed_by_sidx, f'WITH {_LINES} SELECT episode_id, sidx, round(min(start), 6) AS p0, round(max("end"), 6) AS p1 FROM l WHERE sidx IS NOT NULL GROUP BY 1, 2'),
    (voice_windows, VOICE_WINDOWS_SQL), (sampled_lines, SAMPLED_SQL), (voice_choice, VOICE_CHOICE_SQL), (name_colon, NAME_COLON_SQL), (srt_with_speakers, SRT_SQL),
    (clip_attempts, ATTEMPTS_SQL), (clip_reuse, REUSE_SQL), (listed_voices, LISTED_SQL), (guest_pool, GUEST_POOL_SQL), (enough_lines, ENOUGH_SQL), (energy_map, ENERGY_SQL), (split_merged, SPLIT_SQL),
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f, _ in _QUERIES}
ORACLES: dict[str, str] = {f.__name__: sql for f, sql in _QUERIES}
