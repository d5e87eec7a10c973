"""Registered queries over pages, guests and subtitles: dialogue from markup, voices of guests, cues, edited scripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BREAKS
from ..operators import mix, pitch, subtitles, translate, voices
from ..sources import pages
from .catalog import _t
from .dialogue import _LINES, _VALID, _lines

#: Pages made of conversations follow those of the table.
MADE = 1_000_000


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's pages, and one for each conversation: bold labels on even ones, capitals on odd ones."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    bold = F.concat(F.lit("<p><b>"), F.split("text", " ")[0], F.lit(":</b> <i>"), "text", F.lit("</i> (aside) <b>so</b>"), F.when(F.col("turn") % 7 == 3, "[Scene: later] gone").otherwise(""), F.lit("</p>"))
    plain = F.concat(F.lit("<div>"), F.upper("role"), F.lit(": "), "text", F.when(F.col("turn") % 5 == 2, "</div>[pause]<div>lost").otherwise(""), F.lit("</div>"))
    c = c.withColumn("part", F.when(F.col("conv_id") % 2 == 0, bold).otherwise(plain))
    made = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "").alias("html"))
    return _t(spark, sf_dir, "pages").select("page_id", "html").unionByName(made.select((F.col("conv_id") + MADE).alias("page_id"), "html"))


def page_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_dialogue(_pages(spark, sf_dir), ended=True).withColumn("sidx", F.col("sidx").cast("long"))


_UNESCAPE = "replace(replace(replace(replace({0}, '&copy;', '©'), '&quot;', '\"'), '&middot;', '·'), '&amp;', '&')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TIDY = _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(" + _UNESCAPE + r", '\[[^\]]*\]', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')")
PAGES_SQL = rf"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
made AS (SELECT conv_id, string_agg(CASE WHEN conv_id % 2 = 0 THEN '<p><b>' || split_part(text, ' ', 1) || ':</b> <i>' || text || '</i> (aside) <b>so</b>' || CASE WHEN turn % 7 = 3 THEN '[Scene: later] gone' ELSE '' END || '</p>'
  ELSE '<div>' || upper(role) || ': ' || text || CASE WHEN turn % 5 = 2 THEN '</div>[pause]<div>lost' ELSE '' END || '</div>' END, '' ORDER BY turn) AS html FROM c GROUP BY conv_id),
p AS MATERIALIZED (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<script\b.*\z', '', 'g') AS page FROM (SELECT page_id, html FROM pages UNION ALL SELECT conv_id + {MADE}, html FROM made)),
k AS (SELECT page_id, pos, t[pos] AS token FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT page_id, regexp_extract_all(page, '(?s)<!--.*?-->|<[/!?a-zA-Z][^>]*>|[^<]+|<') AS t FROM p))),
s AS (SELECT *, CASE WHEN lower(regexp_extract(token, '^</?([a-zA-Z][^\s/>]*)', 1)) IN ('b', 'strong') THEN CASE WHEN starts_with(token, '</') THEN -1 ELSE 1 END ELSE 0 END AS step FROM k),
t AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM s),
d AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM t),
e AS (SELECT page_id, pos, step = 1 AND depth = 1 AS opens, depth > 0 AS bold, CASE WHEN step <> 0 OR regexp_matches(token, '^<[!?]') THEN NULL WHEN regexp_matches(token, '^</?[a-zA-Z]') THEN ' ' ELSE {_UNESCAPE.format("token")} END AS data FROM d),
g AS (SELECT *, sum(begins) OVER (PARTITION BY page_id ORDER BY pos) AS run FROM (SELECT *, (opens OR coalesce(lag(bold) OVER (PARTITION BY page_id ORDER BY pos) <> bold, true))::INT AS begins FROM e WHERE opens OR data IS NOT NULL)),
r AS (SELECT page_id, run, any_value(bold) AS bold, string_agg(coalesce(data, ''), '' ORDER BY pos) AS data FROM g GROUP BY page_id, run),
n AS (SELECT *, {_STRIP.format("data")} AS name, {_STRIP.format("regexp_replace(" + _STRIP.format("data") + ", ':+$', '')")} AS bare, coalesce(lead(data) OVER (PARTITION BY page_id ORDER BY run), '') AS after FROM r),
l AS (SELECT *, bold AND length(bare) BETWEEN 1 AND 45 AND NOT contains(bare, ':') AND (ends_with(name, ':') OR regexp_matches(after, '^\s*:')) AS label FROM n),
o AS (SELECT *, coalesce(lag(label AND NOT ends_with(name, ':')) OVER (PARTITION BY page_id ORDER BY run), false) AS rest, sum(label::INT) OVER (PARTITION BY page_id ORDER BY run) AS n FROM l),
b AS (SELECT page_id, n, max(CASE WHEN label THEN bare END) AS who, coalesce(string_agg(CASE WHEN NOT label THEN CASE WHEN rest THEN regexp_replace(data, '^\s*:', '') ELSE data END END, '' ORDER BY run), '') AS words FROM o GROUP BY page_id, n),
bold AS MATERIALIZED (SELECT page_id, 0 AS way, n, {_VALID.replace("{0}", "who")} AS speaker, {_TIDY.format(r"regexp_replace(words, '(?is)(?:" + pages.STAGE + r").*\z', '')")} AS text FROM b WHERE who IS NOT NULL),
pl AS (SELECT page_id, pos, {_STRIP.format("x[pos]")} AS part FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT page_id, string_split_regex({_UNESCAPE.format("regexp_replace(page, '<[^>]+>', chr(10), 'g')")}, '\r\n|[\n\r]') AS x FROM p))),
pk AS (SELECT *, regexp_extract(part, '{pages.CAPITALS.replace("(?U:", "(?:").replace("'", "''")}', 1) AS name FROM pl WHERE part <> ''),
pn AS (SELECT *, sum((name <> '' OR left(part, 1) IN ('[', '('))::INT) OVER (PARTITION BY page_id ORDER BY pos) AS n FROM pk),
pw AS (SELECT page_id, n, max(CASE WHEN name <> '' THEN name END) AS who, coalesce(string_agg(CASE WHEN name <> '' THEN regexp_extract(part, '{pages.CAPITALS.replace("(?U:", "(?:").replace("'", "''")}', 2) || chr(10) WHEN left(part, 1) NOT IN ('[', '(') THEN part || chr(10) END, '' ORDER BY pos), '') AS words FROM pn GROUP BY page_id, n),
plain AS MATERIALIZED (SELECT page_id, 1 AS way, n, {_VALID.replace("{0}", "who")} AS speaker, {_TIDY.format("words")} AS text FROM pw WHERE who IS NOT NULL),
u AS MATERIALIZED (SELECT * FROM bold WHERE speaker IS NOT NULL AND length(text) >= 2 UNION ALL SELECT * FROM plain WHERE speaker IS NOT NULL AND length(text) >= 1),
w AS (SELECT page_id, CASE WHEN count(*) FILTER (way = 1) > count(*) FILTER (way = 0) THEN 1 ELSE 0 END AS way FROM u GROUP BY page_id),
z AS MATERIALIZED (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::BIGINT AS sidx, speaker, text FROM u JOIN w USING (page_id, way))
"""
DIALOGUES_SQL = PAGES_SQL + "SELECT * FROM z"
#: For the query of the same name in the catalog.
PAGE_TEXT_SQL = PAGES_SQL + rf"SELECT q.page_id, (SELECT count(*) FROM z WHERE z.page_id = q.page_id) AS utterances, length({_TIDY.format("regexp_replace(q.html, '<[^>]+>', ' ', 'g')")})::INT AS text_chars FROM pages q"


def _guests(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """First words of documents as guests of their source, suppliers as voices of the shows."""
    d = _t(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("show"), F.regexp_extract(F.coalesce("text", F.lit("")), "^([A-Za-z]+)", 1).alias("speaker"), "doc_id")
    shows = d.select("show").distinct()
    n = F.conv(F.substring(F.md5("show"), 1, 4), 16, 10).cast("int")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("pos"), F.col("s_name").alias("voice"), F.when(F.col("s_nationkey") % 3 == 0, "MALE").otherwise("FEMALE").alias("gender"), (F.col("s_suppkey") % 2).cast("int").alias("source"), (170 + F.col("s_acctbal") / 50).alias("f0"), F.lit(1).alias("one"))
    # every show has about a fifth of the voices: those of its remainder
    pool = shows.withColumn("rest", n % 5).join(s.withColumn("rest", (F.col("pos") % 5).cast("int")), "rest").select("show", "gender", "voice", "source", "pos", F.when(F.col("pos") % 11 != 0, F.col("f0")).alias("f0"))
    firsts = pool.groupBy("show").agg(F.min("voice").alias("least"), F.max("voice").alias("most"))
    known = d.where(F.length("speaker") == 5).select("show", "speaker").distinct().join(firsts, "show").select("show", "speaker", F.col("most").alias("voice"))
    generic = firsts.select("show", F.inline(F.array(F.struct(F.lit("OtherMale").alias("speaker"), F.col("least").alias("voice")), F.struct(F.lit("OtherFemale").alias("speaker"), F.lit("").alias("voice")))))
    return {
        "names": d.select("show", "speaker"), "pool": pool, "known": known, "reserved": pool.where("pos % 7 = 0").select("show", "voice"),
        "genders": d.where("length(speaker) % 4 = 0").select("show", "speaker").distinct().withColumn("gender", F.lit("MALE")), "generic": generic,
    }


def guest_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voices.guest_voices(**_guests(spark, sf_dir))


def _sha_mod(h: str, n: str) -> str:
    """A SHA-1 (hex) modulo n, in thirds."""
    part = lambda a, k: f"('0x' || substr({h}, {a}, {k}))::UBIGINT::HUGEINT % {n}"
    return f"(({part(1, 15)} * ({16**25}::HUGEINT % {n}) + {part(16, 15)} * ({16**10}::HUGEINT % {n}) + {part(31, 10)}) % {n})"


GUESTS_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT coalesce(source, '') AS "show", regexp_extract(coalesce(text, ''), '^([A-Za-z]+)', 1) AS speaker FROM documents),
pool AS MATERIALIZED (SELECT "show", CASE WHEN s_nationkey % 3 = 0 THEN 'MALE' ELSE 'FEMALE' END AS gender, s_name AS voice, s_suppkey % 2 AS source, s_suppkey AS pos, CASE WHEN s_suppkey % 11 <> 0 THEN 170 + s_acctbal / 50 END AS f0
  FROM (SELECT DISTINCT "show" FROM d) JOIN supplier ON s_suppkey % 5 = ('0x' || substr(md5("show"), 1, 4))::INT % 5),
firsts AS (SELECT "show", min(voice) AS least, max(voice) AS most FROM pool GROUP BY "show"),
known AS MATERIALIZED (SELECT DISTINCT "show", speaker, most AS voice FROM d JOIN firsts USING ("show") WHERE length(speaker) = 5 AND NOT EXISTS (SELECT 1 FROM pool p WHERE p."show" = d."show" AND p.voice = most AND p.f0 > 300)),
fresh AS MATERIALIZED (SELECT "show", speaker, CASE WHEN length(speaker) % 4 = 0 THEN 'MALE' WHEN regexp_matches(lower(speaker), '(a|ie|y|elle|ine)$') THEN 'FEMALE' ELSE 'MALE' END AS want FROM (SELECT DISTINCT "show", speaker FROM d WHERE speaker NOT IN ('', 'Skip')) x WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k."show" = x."show" AND k.speaker = x.speaker)),
lists AS MATERIALIZED (SELECT "show", gender, list(voice ORDER BY source, pos) FILTER (pos % 7 <> 0 AND (f0 IS NULL OR f0 <= 300)) AS fit FROM pool GROUP BY ALL),
q AS MATERIALIZED (SELECT f."show", speaker, want, coalesce(CASE WHEN a."show" IS NOT NULL THEN a.fit ELSE b.fit END, []) AS fit, CASE WHEN want = 'MALE' THEN least ELSE '' END AS other, sha1(speaker) AS h, row_number() OVER (PARTITION BY f."show" ORDER BY speaker) AS k
  FROM fresh f LEFT JOIN lists a ON a."show" = f."show" AND a.gender = want LEFT JOIN lists b ON b."show" = f."show" AND b.gender <> want LEFT JOIN firsts x ON x."show" = f."show"),
r AS (SELECT DISTINCT q."show", 0::BIGINT AS k, coalesce((SELECT list(DISTINCT voice) FROM known WHERE known."show" = q."show"), []) AS used, ''::VARCHAR AS speaker, ''::VARCHAR AS voice FROM q
  UNION ALL SELECT "show", k, list_append(used, pick), speaker, pick FROM (SELECT "show", k, used, speaker, CASE WHEN len(free) > 0 THEN free[({_sha_mod("h", "greatest(len(free), 1)")} + 1)::BIGINT] ELSE coalesce(other, '') END AS pick
    FROM (SELECT q."show", q.k, r.used, q.speaker, q.h, q.other, CASE WHEN len(list_filter(q.fit, lambda v: NOT list_contains(r.used, v))) > 0 THEN list_filter(q.fit, lambda v: NOT list_contains(r.used, v)) ELSE q.fit END AS free FROM r JOIN q ON q."show" = r."show" AND q.k = r.k + 1)))
SELECT "show", speaker, voice FROM known UNION ALL SELECT "show", speaker, voice FROM r WHERE k > 0 AND voice <> ''"""


def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as subtitles of four seconds."""
    c = _t(spark, sf_dir, "conversations")
    x = c.select(F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").alias("seq"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 4.0).alias("end"), F.col("text").alias("zh"))
    return subtitles.srt_cues(x).withColumn("n", F.col("n").cast("long"))


_CUT = "CASE " + " ".join(f"WHEN contains('{BREAKS}', substr(rest, {k}, 1)) THEN {k}" for k in range(17, 12, -1)) + " ELSE 18 END"
_CLOCK = "lpad(({0} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({0} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({0} % 1000)::VARCHAR, 3, '0')"
CUES_SQL = rf"""WITH RECURSIVE c AS MATERIALIZED (SELECT conv_id, turn, {_STRIP.format("coalesce(text, '')")} AS t FROM conversations),
r AS (SELECT conv_id, turn, t AS rest, []::VARCHAR[] AS done FROM c WHERE length(t) > 18 UNION ALL SELECT conv_id, turn, substr(rest, {_CUT} + 1), list_append(done, {_STRIP.format(f"substr(rest, 1, {_CUT})")}) FROM r WHERE length(rest) >= 18),
w AS (SELECT conv_id, turn, list_filter(list_append(done, {_STRIP.format("rest")}), lambda x: x <> '') AS lines FROM r WHERE length(rest) < 18 UNION ALL SELECT conv_id, turn, [t] FROM c WHERE length(t) <= 18),
s AS (SELECT conv_id, turn, lines, greatest(1, (len(lines) + 1) // 2) AS screens FROM w),
p AS (SELECT conv_id, turn, k, array_to_string(lines[2 * k + 1:2 * k + 2], chr(10)) AS txt, turn * 10.0::DOUBLE + k * (4.0::DOUBLE / screens) AS st, 4.0::DOUBLE / screens AS each FROM (SELECT *, unnest(range(screens)) AS k FROM s)),
m AS (SELECT *, round_even(st * 1000, 0)::BIGINT AS a, round_even((st + each) * 1000, 0)::BIGINT AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS n FROM p)
SELECT conv_id::VARCHAR AS episode_id, n, n || chr(10) || {_CLOCK.format("a")} || ' --> ' || {_CLOCK.format("b")} || chr(10) || txt || chr(10) AS cue FROM m"""


def reviewed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line edited: another speaker, known or not and in other letters, or another text, or none."""
    x = _lines(spark, sf_dir)
    e = x.where("event_id % 3 = 0")
    speaker = F.when(F.col("event_id") % 4 == 0, " aNN ").when(F.col("event_id") % 4 == 1, "nobody").when(F.col("event_id") % 4 == 2, "SKIP").otherwise("Cid")
    edits = e.select("episode_id", F.col("line_idx").alias("idx"), speaker.alias("speaker"), F.when(F.col("event_id") % 2 == 0, " ").otherwise(F.concat(F.lit(" 改"), F.col("event_id"), F.lit("\n"))).alias("zh"))
    return translate.apply_review(x.select("episode_id", "line_idx", "speaker", "zh"), edits, ["Cid"])


REVIEWED_SQL = f"""WITH {_LINES}, e AS (SELECT *, event_id % 3 = 0 AS edited, CASE WHEN event_id % 3 <> 0 THEN speaker WHEN event_id % 4 = 0 THEN 'Ann' WHEN event_id % 4 = 2 THEN 'Skip' WHEN event_id % 4 = 3 THEN 'Cid' ELSE speaker END AS who FROM l)
SELECT episode_id, line_idx, who AS speaker, CASE WHEN edited AND event_id % 2 = 1 THEN '改' || event_id WHEN edited AND who = 'Skip' THEN '' ELSE zh END AS zh FROM e"""

#: Vectors in a row are the blocks of a track, fifty to a track.
TRACK, RATE, LEVEL = 50, 1000, 0.4


def ducked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blocks of samples, each seventh one also as a clip that starts somewhere else; what a block sums up to, and its
    peak."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    episode, place = F.floor(F.col("vec_id") / TRACK).cast("string").alias("episode_id"), (F.col("vec_id") % TRACK).cast("int")
    clips = e.where("vec_id % 7 = 0").select(episode, place.alias("clip_idx"), (place * size / F.lit(float(RATE)) + F.col("vec_id") % 11 / F.lit(100.0)).alias("start"), F.col("embedding").alias("samples"))
    x = mix.assemble(e.select(episode, place.alias("block"), F.col("embedding").alias("samples")), clips, RATE, LEVEL, size)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return x.select("episode_id", "block", F.round(total, 4).alias("total"), F.round(F.array_max(F.transform("samples", F.abs)).cast("double"), 5).alias("peak"))


MIX_SQL = f"""WITH d AS (SELECT max(len(embedding))::BIGINT AS b FROM embeddings), ramp AS (SELECT {int(mix.RAMP * RATE)}::BIGINT AS r),
s AS MATERIALIZED (SELECT vec_id // {TRACK} AS ep, (vec_id % {TRACK}) * b + k - 1 AS i, embedding[k]::FLOAT AS x, vec_id % {TRACK} AS block, b FROM (SELECT vec_id, embedding, b, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings, d)),
n AS (SELECT ep, count(*) AS total FROM s GROUP BY ep),
c AS MATERIALIZED (SELECT ep, idx, pos, total, embedding, least(pos + len(embedding), total) AS stop, start FROM (SELECT vec_id // {TRACK} AS ep, vec_id % {TRACK} AS idx, embedding, ((vec_id % {TRACK}) * b / {float(RATE)}::DOUBLE + vec_id % 11 / 100.0::DOUBLE) AS start, floor(start * {RATE})::BIGINT AS pos FROM embeddings, d WHERE vec_id % 7 = 0) JOIN n USING (ep) WHERE pos < total),
border AS (SELECT ep, i, sum(v) AS v FROM (SELECT ep, greatest(pos - r, 0) AS i, 1 AS v FROM c, ramp UNION ALL SELECT ep, least(stop + r, total), -1 FROM c, ramp) GROUP BY ALL),
g AS (SELECT s.*, (sum(coalesce(v, 0)) OVER (PARTITION BY s.ep ORDER BY s.i) > 0)::INT AS low FROM s LEFT JOIN border USING (ep, i)),
w AS (SELECT *, sum(low) OVER h AS low_n, count(*) OVER h AS near FROM g WINDOW h AS (PARTITION BY ep ORDER BY i ROWS BETWEEN {int(mix.RAMP * RATE) // 2} PRECEDING AND {(int(mix.RAMP * RATE) - 1) // 2} FOLLOWING)),
v AS (SELECT ep, i, list(y ORDER BY start, idx) AS ys FROM (SELECT ep, pos + k - 1 AS i, embedding[k]::FLOAT AS y, start, idx FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM c)) GROUP BY ALL),
o AS (SELECT w.ep, w.block, greatest(-1.0::FLOAT, least(1.0::FLOAT, x * ((low_n * {mix.LOW}::DOUBLE + (near - low_n) * {LEVEL}::DOUBLE) / r)::FLOAT + {mix.VOICE}::FLOAT * coalesce(list_reduce(ys, lambda p, q: p + q), 0.0::FLOAT))) AS z, w.i FROM w JOIN ramp ON true LEFT JOIN v USING (ep, i))
SELECT ep::VARCHAR AS episode_id, block::INT AS block, round(sum(z::DOUBLE ORDER BY i), 4) AS total, round(max(abs(z))::DOUBLE, 5) AS peak FROM o GROUP BY ep, block"""

#: A rate at which a vector of 64 is a frame.
PITCH_RATE = 1600


def _hummed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Vectors as blocks of tracks, on a square wave of the track's own period."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    track, place = F.floor(F.col("vec_id") / TRACK), (F.col("vec_id") % TRACK).cast("int")
    period = 6 + track % 9
    hum = F.transform("embedding", lambda v, k: (v.cast("double") + F.when((place * size + k) % period < 3, 0.25).otherwise(-0.25)).cast("float"))
    return e.select(track.cast("string").alias("episode_id"), place.alias("block"), hum.alias("samples")), size


def frame_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, size = _hummed(spark, sf_dir)
    x = pitch.frame_table(blocks, PITCH_RATE, size)
    return x.select("episode_id", "frame", F.round(F.coalesce("f0", F.lit(0.0)), 6).alias("f0"))


def track_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, size = _hummed(spark, sf_dir)
    return pitch.track_pitches(blocks, PITCH_RATE, size).select("episode_id", F.round(F.coalesce("f0", F.lit(0.0)), 6).alias("f0"), "frames")


_SIZE, _HOP = int(pitch.FRAME * PITCH_RATE), int(pitch.STEP * PITCH_RATE)
_FIRST, _LAST = int(PITCH_RATE / 500), int(PITCH_RATE / 70)
_FRAMES = f"""WITH d AS (SELECT max(len(embedding))::BIGINT AS b FROM embeddings),
s AS MATERIALIZED (SELECT vec_id // {TRACK} AS ep, (vec_id % {TRACK}) * b + k - 1 AS i, (embedding[k]::DOUBLE + CASE WHEN ((vec_id % {TRACK}) * b + k - 1) % (6 + vec_id // {TRACK} % 9) < 3 THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END)::FLOAT::DOUBLE AS x FROM (SELECT vec_id, embedding, b, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings, d)),
n AS MATERIALIZED (SELECT ep, count(*) AS n, max(x * x) AS peak FROM s GROUP BY ep),
f AS MATERIALIZED (SELECT ep, f, list(x ORDER BY i) AS x FROM (SELECT ep, i, x, unnest(range(greatest(0, (i - {_SIZE} + {_HOP}) // {_HOP}), i // {_HOP} + 1)) AS f FROM s) JOIN n USING (ep) WHERE f * {_HOP} < n - {_SIZE} GROUP BY ep, f),
c AS MATERIALIZED (SELECT ep, f, list_transform(x, lambda v: v - list_sum(x) / {_SIZE}) AS y FROM f),
a AS MATERIALIZED (SELECT ep, f, l, list_inner_product(y[1:{_SIZE} - l], y[1 + l:{_SIZE}]) AS ac, list_inner_product(y, y) AS energy FROM (SELECT ep, f, y, unnest(range({_FIRST}, {_LAST})) AS l FROM c)),
best AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ep, f ORDER BY ac DESC, l) = 1),
p AS MATERIALIZED (SELECT ep, f, CASE WHEN energy >= 0.05 * CASE WHEN peak > 0 THEN peak ELSE 1.0 END * {_SIZE} AND ac >= 0.45 * energy THEN {PITCH_RATE} / l::DOUBLE END AS f0 FROM best JOIN n USING (ep))
"""
FRAMES_SQL = _FRAMES + "SELECT ep::VARCHAR AS episode_id, f AS frame, round(coalesce(f0, 0.0), 6)::DOUBLE AS f0 FROM p"
TRACKS_SQL = _FRAMES + "SELECT n.ep::VARCHAR AS episode_id, round(CASE WHEN count(f0) >= 5 THEN median(f0) ELSE 0.0 END, 6)::DOUBLE AS f0, count(f0) AS frames FROM n LEFT JOIN p USING (ep) GROUP BY n.ep"

_QUERIES: tuple[tuple[Callable[[SparkSession, str], DataFrame], str], ...] = (
    (page_dialogues, DIALOGUES_SQL), (guest_voices, GUESTS_SQL), (subtitle_cues, CUES_SQL), (reviewed_script, REVIEWED_SQL), (ducked_mix, MIX_SQL), (frame_pitches, FRAMES_SQL), (track_pitches, TRACKS_SQL),
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f, _ in _QUERIES}
ORACLES: dict[str, str] = {f.__name__: sql for f, sql in _QUERIES} | {"page_text": PAGE_TEXT_SQL}
