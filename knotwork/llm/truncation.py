"""Text cut off by field limits.

Method: the lengths a text would have had in storage are computed under alternative encodings (UTF-8, UTF-16, Latin-1
with escapes), with entity escaping, JSON escaping and CRLF line ends. Grouped by source and measure, lengths at which
texts pile up against their surroundings expose hidden limits. Then the endings are inspected. At a limit where most
endings are broken off, every ending that is not clearly complete is cut. Elsewhere an ending in the middle of a sentence
is cut; an ending that may be complete (title, list entry, table row, code) is cut if it breaks off within a word that the
corpus knows only as the start of others, or stands unclosed. The texts are read once for lengths and endings, and once
for the words of the corpus; all else is numbers.

Cases: null and blank texts are not cut; a null source is a source of its own; texts posted again are judged each; null
ids are dropped; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import broadcast_if_small, materialize

#: A length is a limit where at least PILE texts of a source have it and STEEP times as many as one of its NEAR neighbours does on average.
PILE, STEEP, NEAR = 3, 6.0, 25
# Marks set in place of the rest of a text.
_MARK = re.compile(r"\s*(?:…|\.{3,}|\[(?:\s*(?:…|\.{3})\s*|[^\]\n]{0,30}\b(?:truncated|clipped|cut|snip(?:ped)?|trimmed|omitted|more|continued)\b[^\]\n]{0,30})\]|\((?:\s*(?:…|\.{3})\s*|[^)\n]{0,30}\b(?:truncated|clipped|cut off|snipped|trimmed|omitted|continued|more)\b[^)\n]{0,30})\)|<(?:truncated|snip|cut)>|(?:read more|show more|see more|weiterlesen|lire la suite|leer más)\W*)\s*$", re.I)
_STOP = re.compile(r"(?:[.!?。！？]|[.!?]?[^\w\s,;:(\[{<`'\"/\\|@#&*+=~^$%_…-])[\"'»”’)\]`*_]*$")
_SIGN_OFF = re.compile(r"^\W*(?:cheers|thanks|thank you|thx|regards|best|kind regards|best regards|lgtm|\+1|signed-off-by:.*|co-authored-by:.*|reviewed-by:.*|acked-by:.*|reported-by:.*|(?:fixes|closes|resolves|refs?|see)\s+#\d+|danke|grüße|viele grüße|merci|cordialement|gracias|saludos|done|ok(?:ay)?|wip|nit|ping|will (?:report|get|follow|come|write) (?:back|up)|to be continued|more (?:to come|later|soon)|stay tuned|tbc)\W*$", re.I)
_LINK = re.compile(r"(?:https?://|www\.)\S+$|(?:^|\s)[\w./-]+/[\w.-]+\.\w{1,5}$|\[[^\]]*\]\([^)\s]*\)$")
_LIST = re.compile(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s+\S")
_TITLE = re.compile(r"^\s*#{1,6}\s+\S")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
_LABEL = re.compile(r"^\s*(?:\[[^\]]*\]\s*)?[\w .-]{1,24}:\s+")
# Words that no complete title or entry ends with.
DANGLING = frozenset(
    """a an the and or but of with per to for in on by as at if that which when while whether from into than because its it
    der die das ein eine einen und oder von mit zu für im am ob dass weil wenn le la les un une des et ou de du avec pour dans
    que qui si el los las una y o del con para en por cuando porque""".split()
)
_LAST_WORD = re.compile(r"([^\W\d_]+)$")


def ending(text: str) -> tuple[str, str]:
    """('cut' | 'whole' | 'doubtful', the last word where it decides) of a text's end."""
    body = text.rstrip()
    loose = text[len(body) :].startswith((" ", "\t"))  # broken off between two words
    marked = False
    if _SIGN_OFF.match(body.rsplit("\n", 1)[-1]):
        return "whole", ""
    while (m := _MARK.search(body)) and m.start() > 0:
        body, marked = body[: m.start()].rstrip(), True
    if not body:
        return "whole", ""
    if body[-1] == "\ufffd":
        return "cut", ""
    if len(_FENCE.findall(body)) % 2:
        return "cut", ""
    lines = body.split("\n")
    last = lines[-1]
    if re.fullmatch(r"\s*(?:```|~~~)\s*", last):
        return "whole", ""
    word = m[1].lower() if (m := _LAST_WORD.search(last)) else ""
    open_tick = last.count("`") % 2 == 1
    if last.lstrip().startswith("|"):
        return ("whole", "") if last.endswith("|") else ("cut", "")
    if _SIGN_OFF.match(last) or _LINK.search(last):
        return ("cut", "") if open_tick else ("whole", "")
    if re.fullmatch(r"\s*(?:[-*+•]|\d{1,3}[.)]|#{1,6})\s*", last) or open_tick:
        return "cut", ""
    alone = len(lines) == 1 or not lines[-2].strip()
    label = _LABEL.match(last)
    title = alone and len(last) <= 90 and not re.search(r"[.!?;] |,", last) and not (label and (last[label.end() :][:1].isupper() or last.lstrip()[:1] == "["))
    if not _STOP.search(last) and (_LIST.match(last) or _TITLE.match(last) or title):
        if re.search(r"[,;(\[{]$", last) or loose or marked or word in DANGLING:
            return "cut", ""
        return "doubtful", word
    if re.match(r"^(?: {4}|\t|>>> |\$ )", last) and re.search(r"[(){}\[\];=]", last):
        return "whole", ""
    if _STOP.search(last):
        return "whole", ""
    return "cut", ""


#: What lengths are measured; see measured().
MEASURES = ("chars", "utf8", "utf16_bytes", "utf16_units", "latin1_escaped", "chars_entities", "utf8_entities", "chars_json", "utf8_json", "json_ascii", "chars_crlf", "utf8_crlf")


def measured(text: str) -> list[int]:
    """The text's lengths under alternative encodings and escapes, in the order of MEASURES."""
    chars = utf8 = len(text)
    wide = high = plain = 0
    if not text.isascii():
        utf8, wide = len(text.encode("utf-8", "surrogatepass")), len(text.encode("utf-16-le", "surrogatepass")) // 2 - chars
        high, plain = chars - len(text.encode("latin-1", "ignore")), chars - len(text.encode("ascii", "ignore"))
    feeds = text.count("\n")
    lines = feeds - text.count("\r\n")
    quotes = text.count('"')
    entity = text.count("&") * 4 + (text.count("<") + text.count(">")) * 3 + quotes * 5 + text.count("'") * 4
    slash = quotes + text.count("\\") + feeds + text.count("\r") + text.count("\t")
    return [chars, utf8, (chars + wide) * 2, chars + wide, chars + high * 5, chars + entity, utf8 + entity, chars + slash, utf8 + slash, chars + slash + (plain + wide) * 5 + wide, chars + lines, utf8 + lines]


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ends = [ending(t) for t in b["text"]]
        yield b[["doc_id", "source", "h"]].assign(ending=[e for e, _ in ends], word=[w for _, w in ends], sizes=[measured(t) for t in b["text"]])


def inspected(documents: DataFrame) -> DataFrame:
    """doc_id, source, h (hash of the text), ending, word, sizes of every document with a text; written down."""
    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("h"), "text").filter("doc_id is not null and length(trim(text)) > 0")
    return materialize(some.mapInPandas(_inspect, "doc_id long, source string, h long, ending string, word string, sizes array<long>"))


def _long(ends: DataFrame, *columns: str) -> DataFrame:
    measure = F.element_at(F.array(*map(F.lit, MEASURES)), F.col("i") + 1)
    return ends.select("source", *columns, F.posexplode("sizes").alias("i", "size")).withColumn("measure", measure).drop("i")


def limits(ends: DataFrame) -> DataFrame:
    """source, measure, size, n_texts, n_near, n_cut: lengths at which the texts of a source pile up, and how many of these
    texts end cut.

    n_near: how many texts a length nearby has on average. Mere repeats of one text are one text here. ends: as from
    inspected()."""
    known = ends.groupBy("source", "h").agg(F.max((F.col("ending") == "cut").cast("int")).alias("cut"), F.min("sizes").alias("sizes"))
    sizes = _long(known, "cut").groupBy("source", "measure", "size").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("cut").alias("n_cut"))
    # every length adds itself to its neighbours': a bounded window over the histogram, kept apart by ranges of sizes
    cell = F.floor(F.col("size") / 1024)
    spread = sizes.select("*", F.explode(F.array_distinct(F.array(F.floor((F.col("size") - NEAR) / 1024), F.floor((F.col("size") + NEAR) / 1024)))).alias("cell"))
    near = F.sum("n_texts").over(Window.partitionBy("source", "measure", "cell").orderBy("size").rangeBetween(-NEAR, NEAR))
    found = spread.withColumn("near", near).filter(F.col("cell") == cell).select("source", "measure", "size", "n_texts", ((F.col("near") - F.col("n_texts")) / (2 * NEAR)).alias("n_near"), "n_cut")
    return found.filter((F.col("n_texts") >= PILE) & (F.col("n_texts") > STEEP * F.col("n_near")))


def _vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: how often each word stands before the end of a text."""
    inner = F.regexp_extract_all(F.lower(F.regexp_replace("text", r"[\p{L}]+\P{L}*$", "")), F.lit(r"\p{L}+"), 0)
    return documents.filter("length(text) > 0").select(F.explode(inner).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _broken(ends: DataFrame, documents: DataFrame) -> DataFrame:
    """word: last words where it decides that the corpus knows only as the start of others."""
    asked = materialize(ends.filter("ending = 'doubtful' and word != ''").select("word").distinct())
    # one number for each length that such a word has
    lengths = [r.n for r in asked.select(F.length("word").alias("n")).distinct().collect()]
    vocabulary = materialize(_vocabulary(documents.select("text")))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n < F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n))
    beginnings = vocabulary.select(F.explode(starts).alias("word")).distinct()
    return asked.join(beginnings, "word", "left_semi").join(vocabulary.filter("n >= 2").select("word"), "word", "left_anti")


def at_limits(ends: DataFrame) -> DataFrame:
    """doc_id of the texts whose length is a limit where most texts end cut."""
    firm = materialize(limits(ends).filter("2 * n_cut > n_texts").select("source", "measure", "size"))
    # at most one row for a source, measure and length that many texts share
    return _long(ends, "doc_id").join(broadcast_if_small(firm), ["source", "measure", "size"], "left_semi").select("doc_id").distinct()


def judged(documents: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """doc_id, source, ending, word, cut, why ('limit', 'ending', 'word'; null where not cut) of every document with a text."""
    ends = inspected(documents) if ends is None else ends
    held = at_limits(ends).withColumn("held", F.lit(True))
    broken = _broken(ends, documents).withColumn("broken", F.lit(True))
    why = F.when(F.col("held") & (F.col("ending") != "whole"), "limit").when(F.col("ending") == "cut", "ending").when((F.col("ending") == "doubtful") & F.col("broken"), "word")
    return ends.join(held, "doc_id", "left").join(broken, "word", "left").select("doc_id", "source", "ending", "word", why.isNotNull().alias("cut"), why.alias("why"))


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id of every text that is cut off."""
    return judged(documents).filter("cut").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, n_at_limits (of n_cut, those that a limit exposed), rate, and limits: the exposed
    'measure=size' of the source, largest piles first."""
    ends = inspected(documents)
    rate = judged(documents, ends).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("why") == "limit").alias("n_at_limits"))
    found = limits(ends).groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_texts")).alias("k"), F.concat_ws("=", "measure", F.col("size").cast("string")).alias("at")))).alias("x"))
    return rate.join(found, "source", "left").select("source", "n_texts", "n_cut", "n_at_limits", (F.col("n_cut") / F.col("n_texts")).alias("rate"), F.coalesce(F.array_join("x.at", ", "), F.lit("")).alias("limits"))
