"""Who speaks each line: script labels, voice clusters, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import GROUP, OTHER_FEMALE, OTHER_MALE, SKIP, canonical_speaker, display_name, role_gender
from ..functions.text import let, norm_words
from ..sources.profiles import Profile


def guest_of(gender: Column) -> Column:
    return F.when(gender == "FEMALE", OTHER_FEMALE).otherwise(OTHER_MALE)


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key's most frequent value, ties to the value seen first, with its count and the key's rows."""
    each = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first")))
    return each.groupBy(*keys).agg(best.alias("b"), F.sum("n").alias("rows")).select(*keys, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n"), "rows")


def cluster_genders(lines: DataFrame) -> DataFrame:
    """Gender of each voice cluster by its lines: (episode_id, cluster, gender)."""
    m, f = F.count_if(F.col("gender") == "MALE"), F.count_if(F.col("gender") == "FEMALE")
    return lines.where("cluster is not null").groupBy("episode_id", "cluster").agg(F.when(m > f, "MALE").when(f > m, "FEMALE").otherwise("").alias("gender"))


def script_labels(lines: DataFrame, profile: Profile) -> DataFrame:
    """Adds ``label`` from the script's speaker (``raw``) and ``guest``, the generic label by voice: the intro is skipped,
    an unmatched line that sings the theme too, a group is left to the voices."""
    lines = lines.drop("__g").join(cluster_genders(lines).withColumnRenamed("gender", "__g"), ["episode_id", "cluster"], "left")
    voice = F.when(F.col("__g") != "", F.col("__g")).otherwise(F.coalesce("gender", F.lit("")))
    lines = lines.withColumn("__who", canonical_speaker("raw", profile))
    who = F.col("__who")
    no_script = F.coalesce(F.col("raw"), F.lit("")) == ""
    theme = F.array(*[F.lit(w) for w in profile.theme_words]).cast("array<string>")
    sung = F.size(F.array_intersect(F.array_distinct(norm_words("en")), theme)) >= 3 if profile.theme_words else F.lit(False)
    intro = (F.col("start") < profile.skip_intro_seconds) if profile.skip_intro_seconds else F.lit(False)
    label = (
        F.when(intro, SKIP)
        .when(no_script, F.when(sung, SKIP))
        .when(who.isin(profile.main_cast), who)
        .when(who == GROUP, F.lit(None))
        .otherwise(F.coalesce(display_name("raw"), guest_of(voice)))
    )
    return lines.withColumns({"guest": guest_of(voice), "label": label}).drop("__g", "__who")


def fallback_speaker(raw: Column | str, profile: Profile, neighbour: Column | None = None) -> Column:
    """Label of a script line that nobody was heard to say."""
    near = F.coalesce(F.when(neighbour != "", neighbour), F.lit(OTHER_FEMALE)) if neighbour is not None else F.lit(OTHER_FEMALE)
    own = F.coalesce(display_name(raw), F.lit(OTHER_MALE))
    return let(canonical_speaker(raw, profile), lambda who: F.when(who.isin(profile.main_cast), who).when(who == GROUP, near).otherwise(own))


def _main_owner(lines: DataFrame, profile: Profile) -> DataFrame:
    named = lines.where(F.col("label").isin(profile.main_cast) & F.col("cluster").isNotNull())
    return majority(named, ["episode_id", "cluster"], "label", "line_idx").select("episode_id", "cluster", F.col("label").alias("owner"), F.col("n").alias("owned"))


def fill_by_cluster(lines: DataFrame, profile: Profile) -> DataFrame:
    """An open line takes the main character that most of its cluster's lines have."""
    x = lines.join(_main_owner(lines, profile), ["episode_id", "cluster"], "left")
    return x.withColumn("label", F.coalesce("label", "owner")).drop("owner", "owned")


def correct_by_cluster(lines: DataFrame, profile: Profile) -> DataFrame:
    """A line given to somebody else goes to the main character who has four lines and four fifths of its cluster, if the
    voice's gender allows."""
    size = lines.where("cluster is not null").groupBy("episode_id", "cluster").agg(F.count(F.lit(1)).alias("members"))
    strong = _main_owner(lines, profile).join(size, ["episode_id", "cluster"]).where("owned >= 4 and owned / members >= 0.8").drop("owned", "members")
    x = lines.join(strong, ["episode_id", "cluster"], "left")
    mine = F.coalesce(F.col("gender"), F.lit(""))
    wrong = F.col("owner").isNotNull() & (F.coalesce("label", F.lit("")) != SKIP) & ~F.coalesce(F.col("label").isin(profile.main_cast), F.lit(False))
    return x.withColumn("label", F.when(wrong & ((mine == "") | (mine == role_gender("owner", profile))), F.col("owner")).otherwise(F.col("label"))).drop("owner")


def fill_by_neighbour(lines: DataFrame, label: str = "label", key: str = "episode_id", order: str = "line_idx", guest: str = "guest") -> DataFrame:
    """Open lines take the label before them while the pause before is no longer than the one after; from the first
    line of a run where it is longer, the rest takes the label that follows. With one side only, that; with none, the
    guest label of the run's first line."""
    w = W.partitionBy(key).orderBy(order)
    before = F.coalesce(F.col("start") - F.lag("end").over(w), F.lit(9e9))
    after = F.coalesce(F.lead("start").over(w) - F.col("end"), F.lit(9e9))
    x = lines.withColumns({
        "__prev": F.last(label, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "__next": F.first(label, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)),
        "__run": F.count(label).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "__far": (before > after).cast("int"),
        "__open": F.col(label).isNull(),
    })
    run = W.partitionBy(key, "__run", "__open").orderBy(order)
    x = x.withColumns({"__flip": F.max("__far").over(run) == 1, "__guest": F.first(guest).over(run)})
    found = F.when(F.col("__flip") | F.col("__prev").isNull(), F.coalesce("__next", "__prev", "__guest")).otherwise(F.coalesce("__prev", "__next", "__guest"))
    return x.withColumn(label, F.when(F.col("__open"), found).otherwise(F.col(label))).drop("__prev", "__next", "__run", "__far", "__open", "__flip", "__guest")


def cluster_majority(lines: DataFrame) -> DataFrame:
    """One voice cluster, one speaker: the most frequent label that isn't Skip."""
    best = majority(lines.where((F.col("label") != SKIP) & F.col("cluster").isNotNull()), ["episode_id", "cluster"], "label", "line_idx")
    x = lines.join(best.select("episode_id", "cluster", F.col("label").alias("__best")), ["episode_id", "cluster"], "left")
    return x.withColumn("label", F.when(F.col("label") == SKIP, SKIP).otherwise(F.coalesce("__best", "label"))).drop("__best")


def cast_speakers(lines: DataFrame, profile: Profile) -> DataFrame:
    """Every line's label: the script first, then voices, then neighbours. Needs episode_id, line_idx, start, end, en, raw
    (nullable), cluster (nullable), gender."""
    x = script_labels(lines, profile)
    return fill_by_neighbour(correct_by_cluster(fill_by_cluster(x, profile), profile))


def cast_tally(lines: DataFrame, label: str = "label", key: str = "episode_id") -> DataFrame:
    return lines.groupBy(key, label).agg(F.count(F.lit(1)).alias("lines")).orderBy(key, F.desc("lines"), label)
