"""Dialogue from web pages: bold labels or capitals with a colon, whichever gives more.

A page becomes rows, its tags and texts or its lines in order; what a row belongs to follows from running values over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import valid_speaker
from ..functions.text import clean_script_text, strip, unescape_html

# What ends an utterance on a page with bold labels, a name in capitals before a colon, the longest label.
STAGE = r"\[\s*scene|\bcommercial break\b|\bopening credits\b|\bclosing credits\b"
CAPITALS = r"^([A-Z][A-Z'.\- ]{1,30}?):(?U:\s*)(.*)\z"
LABEL = 45
#: A comment, a tag, a text, or a sign that begins no tag; what ends a line.
_TOKEN, _LINE = r"(?s)<!--.*?-->|<[/!?a-zA-Z][^>]*>|[^<]+|<", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _page(html: Column | str) -> Column:
    """Without scripts; one that never ends hides the rest."""
    text = F.regexp_replace(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), r"(?is)<script.*?</script>", " ")
    return F.regexp_replace(text, r"(?is)<script\b.*\z", "")


def _joined(order: str, value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def text_runs(pages: DataFrame, key: str, html: str, ended: bool = False) -> DataFrame:
    """(key, run, bold, data): a page's texts as runs, each in bold or not; a bold element is a run of its own, further tags count as
    a space. Nesting is a running sum that never falls below zero."""
    x = pages.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(_page(html), F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][^\s/>]*)", 1))
    step = F.when(tag.isin("b", "strong"), F.when(F.col("token").startswith("</"), -1).otherwise(1)).otherwise(0)
    order = W.partitionBy("key").orderBy("pos")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("step", step).withColumn("total", F.sum("step").over(so_far))
    x = x.withColumn("depth", F.col("total") - F.least(F.lit(0), F.min("total").over(so_far)))
    data = F.when(F.col("token").rlike("^<[!?]") | (F.col("step") != 0), None).when(F.col("token").rlike("^</?[a-zA-Z]"), " ").otherwise(unescape_html("token", ended))
    x = x.select("key", "pos", data.alias("data"), ((F.col("step") == 1) & (F.col("depth") == 1)).alias("opens"), (F.col("depth") > 0).alias("bold")).where("opens or data is not null")
    begins = F.col("opens") | F.coalesce(F.lag("bold").over(order) != F.col("bold"), F.lit(True))
    x = x.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(so_far)).withColumn("data", F.coalesce("data", F.lit("")))
    return x.groupBy("key", "run").agg(F.first("bold").alias("bold"), _joined("pos", "data").alias("data"))


def _said(rows: DataFrame, least: int, until: str | None = None, ended: bool = False) -> DataFrame:
    """(key, n, speaker, text) of rows (key, pos, kind, value) with the kinds name, words and end: words go to the name before them,
    up to where ``until`` is found. What has no valid name or fewer than ``least`` characters is left out."""
    order = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    x = rows.withColumn("n", F.sum((F.col("kind") != "words").cast("int")).over(order))
    name = F.max(F.when(F.col("kind") == "name", F.col("value")))
    x = x.groupBy("key", "n").agg(name.alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "words", F.struct("pos", "value")))), lambda v: v["value"]), "").alias("words"))
    words = F.regexp_replace("words", f"(?is)(?:{until}).*\\z", "") if until else F.col("words")
    x = x.where("name is not null").select("key", "n", valid_speaker("name").alias("speaker"), clean_script_text(words, entities=True, ended=ended).alias("text"))
    return x.where(F.col("speaker").isNotNull() & (F.length("text") >= least))


def bold_dialogue(pages: DataFrame, key: str = "page_id", html: str = "html", ended: bool = False) -> DataFrame:
    """(key, n, speaker, text). A label is bold text of up to LABEL characters with a colon at its end or right after it; other bold
    text is emphasis within the dialogue."""
    order = W.partitionBy("key").orderBy("run")
    x = text_runs(pages, key, html, ended).withColumn("name", strip("data")).withColumn("bare", strip(F.regexp_replace("name", ":+$", "")))
    after = F.regexp_replace(F.coalesce(F.lead("data").over(order), F.lit("")), r"(?U)^\s+", "")
    closed = F.col("name").endswith(":")
    x = x.withColumn("label", F.col("bold") & F.length("bare").between(1, LABEL) & ~F.col("bare").contains(":") & (closed | after.startswith(":"))).withColumn("open", F.col("label") & ~closed)
    # the colon after a label belongs to it
    rest = F.regexp_replace("data", r"(?U)^\s*:", "")
    x = x.withColumn("words", F.when(F.coalesce(F.lag("open").over(order), F.lit(False)), rest).otherwise(F.col("data")))
    return _said(x.select("key", F.col("run").alias("pos"), F.when(F.col("label"), "name").otherwise("words").alias("kind"), F.when(F.col("label"), F.col("bare")).otherwise(F.col("words")).alias("value")), 2, STAGE, ended)


def plain_dialogue(pages: DataFrame, key: str = "page_id", html: str = "html", ended: bool = False) -> DataFrame:
    """(key, n, speaker, text) of lines that start with a name in capitals and a colon; further lines go on until one in brackets."""
    text = unescape_html(F.regexp_replace(_page(html), "<[^>]+>", "\n"), ended)
    x = pages.select(F.col(key).alias("key"), text.alias("text")).select("key", F.posexplode(F.split("text", _LINE)).alias("line", "part")).withColumn("part", strip("part")).where("part <> ''")
    x = x.withColumn("name", F.regexp_extract("part", CAPITALS, 1))
    kinds = F.when(F.col("name") != "", F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")), F.struct(F.lit("words").alias("kind"), F.concat(F.regexp_extract("part", CAPITALS, 2), F.lit("\n")).alias("value"))))
    kinds = kinds.when(F.col("part").rlike(r"^[\[(]"), F.array(F.struct(F.lit("end").alias("kind"), F.lit("").alias("value")))).otherwise(F.array(F.struct(F.lit("words").alias("kind"), F.concat("part", F.lit("\n")).alias("value"))))
    x = x.select("key", "line", F.posexplode(kinds).alias("k", "e"))
    return _said(x.select("key", (F.col("line") * 2 + F.col("k")).alias("pos"), "e.kind", "e.value"), 1, ended=ended)


def page_dialogue(pages: DataFrame, key: str = "page_id", html: str = "html", ended: bool = False) -> DataFrame:
    """(key, sidx, speaker, text) of pages (key, html), by the reading that gives more utterances; ties go to bold labels. A null or
    empty page gives none. Rows of a key are one page. A quoted ``>`` in a tag ends it. With ``ended`` only character references with a
    semicolon are resolved."""
    both = bold_dialogue(pages, key, html, ended).withColumn("way", F.lit(0)).unionByName(plain_dialogue(pages, key, html, ended).withColumn("way", F.lit(1)))
    counts = both.groupBy("key").agg((F.count_if(F.col("way") == 1) > F.count_if(F.col("way") == 0)).cast("int").alias("way"))
    x = both.join(counts, ["key", "way"])
    return x.select(F.col("key").alias(key), (F.row_number().over(W.partitionBy("key").orderBy("n")) - 1).alias("sidx"), "speaker", "text")
