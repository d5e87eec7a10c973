"""Speaker labels and voice metadata as expressions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.profiles import Profile
from .text import col, let, strip

# Words that are no names, marks of a line that is no speaker's, groups, marks of a different person, and the
# words that voice metadata is read by.
NOT_NAMES = (
    "and", "the", "you", "yes", "no", "oh", "ok", "okay", "but", "so", "if", "am", "is", "are", "was", "were", "that", "this", "what", "why", "how",
    "who", "when", "where", "not", "huge", "very", "really", "just", "now", "here", "there", "all right", "i", "me", "my", "we", "he", "she", "it",
    "they", "her", "him", "his", "hers", "do", "did", "does", "don't", "didn't", "can", "can't", "will", "won't", "never", "always", "more", "less",
    "yeah", "hey", "hi", "hello", "wow", "god", "please", "thanks", "thank you", "sorry", "wait", "stop", "look", "listen", "one", "two", "end", "note",
    "time lapse", "cut to", "flashback",
)
NOT_SPEAKERS = "scene|credits|note|time lapse|cut to|commercial|written by|transcribed|opening|closing"
GROUPS = (
    "all", "everyone", "everybody", "guys", "girls", "both", "together", "gang", "group", "the girls", "the guys",
)
OTHER_PERSON = (
    "fake", "young", "old", "baby", "mini", "future", "evil", "imposter", "double", "mrs", "mr", "ms", "dr", "miss", "grandmother", "grandma", "granny",
    "grandpa", "grandfather", "mom", "mother", "dad", "father", "sister", "brother", "aunt", "uncle", "cousin", "niece", "nephew", "sr", "jr", "senior",
    "junior",
)
FEMALE_HINTS = (
    "女", "妹", "姐", "娘", "少女", "女生", "女声", "女士", "小姐", "阿姨", "奶奶", "姑娘", "女性", "御姐", "萝莉", "女孩", "女神", "妈妈", "母亲", "太太", "female", "woman", "girl",
    "lady",
)
MALE_HINTS = (
    "男", "哥", "弟弟", "少年", "男生", "男声", "先生", "大叔", "叔叔", "爷", "男性", "帅哥", "男孩", "爸爸", "父亲", "大哥", "male", "boy", "gentleman", "guy",
)
DENIED = (
    "sexy", "seductive", "seduction", "sensual", "erotic", "nsfw", "moan", "moaning", "breathy", "asmr", "whisper", "kiss", "flirt", "flirty",
    "girlfriend", "boyfriend", "sultry", "intimate", "bedroom", "18+", "性感", "娇喘", "呻吟", "诱惑", "魅惑", "耳语", "助眠", "撩", "暧昧", "挑逗", "骚", "湿", "喘息", "喘",
    "小奶音", "哄睡", "女友", "男友", "床", "情欲", "娇滴滴", "嗲",
)
OTHER_MALE, OTHER_FEMALE, SKIP, GROUP, GUEST = "OtherMale", "OtherFemale", "Skip", "GROUP", "GUEST"
MAX_GUEST_F0 = 300.0


def valid_speaker(raw: Column | str) -> Column:
    """The label without asides and trailing marks, or null if it can't be a speaker's name."""
    t = strip(F.regexp_replace(col(raw), r"\(.*?\)", ""))
    t = strip(F.regexp_replace(t, r"^\.+|\.+$", ""))
    return let(strip(F.regexp_replace(t, ":+$", "")), _name_or_null)


def _name_or_null(t: Column) -> Column:
    good = (
        F.length(t).between(2, 40)
        & ~t.rlike(r"\p{Nd}")
        & ~F.lower(t).rlike(NOT_SPEAKERS)
        & ~F.lower(t).isin(*NOT_NAMES)
        & (F.size(F.split(t, r"(?U)\s+")) <= 4)
        & t.rlike("[A-Za-z]{2}")
    )
    return F.when(good, t)


def _lookup(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*m.items())]) if m else F.create_map().cast("map<string,string>")


def canonical_speaker(raw: Column | str, profile: Profile) -> Column:
    """A main character's name, GROUP or GUEST. Only an exact name, alias or full name is a main character; a
    possessive or a relative is somebody else. Of several named together one main character stands, more are a
    group."""
    n = strip(F.regexp_replace(F.lower(F.coalesce(col(raw), F.lit(""))), r"\(.*?\)", ""))
    n = strip(F.regexp_replace(n, ":+$", ""))
    n = F.regexp_replace(n, r"""^[."']+|[."']+$""", "")
    alias, full = _lookup(profile.aliases), _lookup(profile.full_names)

    def of_parts(parts: Column) -> Column:
        members = F.filter(parts, lambda x: F.map_contains_key(alias, x))
        one = lambda m: F.when(F.size(m) == 1, F.try_element_at(alias, F.try_element_at(m, F.lit(1)))).when(F.size(m) > 1, GROUP)
        several = F.coalesce(let(members, one), F.when(F.forall(parts, lambda x: x.isin(*GROUPS)), GROUP), F.lit(GUEST))
        return F.when(F.size(parts) > 1, several)

    def first_token(tokens: Column) -> Column:
        return F.when(F.size(tokens) <= 3, F.try_element_at(alias, F.try_element_at(tokens, F.lit(1))))

    def label(n: Column) -> Column:
        other = n.rlike(r"(?U)('s\b|\x{2019}s\b|\b(?:" + "|".join(OTHER_PERSON) + r")\b)")
        parts = F.filter(F.transform(F.split(n, r"(?U)\s*(?:,|\band\b|&|\+|/)\s*"), strip), lambda x: x != "")
        tokens = F.filter(F.split(n, r"(?U)\s+"), lambda x: x != "")
        return (
            F.when((n == "") | other, GUEST)
            .when(F.map_contains_key(alias, n), F.try_element_at(alias, n))
            .when(F.map_contains_key(full, n), F.try_element_at(full, n))
            .when(n.isin(*GROUPS), GROUP)
            .otherwise(F.coalesce(let(parts, of_parts), let(tokens, first_token), F.lit(GUEST)))
        )

    return let(n, label)


def title_case(c: Column | str) -> Column:
    """Each run of letters with a capital first letter (also after apostrophes and hyphens, unlike initcap)."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), "")


def display_name(raw: Column | str) -> Column:
    """A guest's own name from the script label, or null if it is unusable."""
    t = strip(F.regexp_replace(strip(F.regexp_replace(F.coalesce(col(raw), F.lit("")), r"\(.*?\)", "")), "^:+|:+$", ""))
    return let(title_case(t), lambda name: F.when(F.length(name).between(2, 30), name))


def role_gender(role: Column | str, profile: Profile) -> Column:
    return F.when(col(role) == SKIP, "").when(col(role).isin(sorted(profile.male_roles)), "MALE").otherwise("FEMALE")


def guest_gender(name: Column | str) -> Column:
    """By the name's ending."""
    return F.when(F.lower(col(name)).rlike("(a|ie|y|elle|ine)$"), "FEMALE").otherwise("MALE")


def _any(c: Column | str, hints: tuple[str, ...]) -> Column:
    # one pattern: a function over the hints would put the text in lower case for each of them
    return F.lower(F.coalesce(col(c), F.lit(""))).rlike("|".join(re.escape(h) for h in hints))


def is_bad_voice(c: Column | str) -> Column:
    return _any(c, DENIED)


def voice_gender(c: Column | str) -> Column:
    """Female hints are looked for first."""
    return F.when(_any(c, FEMALE_HINTS), "FEMALE").when(_any(c, MALE_HINTS), "MALE").otherwise("")


def has_cjk(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(r"[\x{4e00}-\x{9fff}]")


def is_chinese(languages: Column | str, title: Column | str) -> Column:
    spoken = F.coalesce(col(languages), F.array().cast("array<string>"))
    return F.exists(spoken, lambda x: F.lower(x).startswith("zh")) | has_cjk(title)


def pitch_allowed(f0: Column | str) -> Column:
    """Voices of unknown pitch are kept."""
    return col(f0).isNull() | (col(f0) <= MAX_GUEST_F0)
