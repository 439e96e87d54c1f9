"""Source files that do not parse.

Method: generalised LL parsing with a graph-structured stack (gll.py), all dialects of a language run together in one
parse; a file is flagged where no dialect accepts it. What the grammars leave open (rules that are not context-free, such
as repeated TOML keys or what may be assigned to) is checked afterwards with the parsers of Python's standard library,
which can only refuse what the grammars accept.

Cases: null contents are not judged; empty files are invalid only as JSON; the extension decides, not the language
column; Markdown and unknown extensions always parse; identical rows give one result; null ids are dropped; empty tables
give empty results; extra columns are ignored. A text nested too deeply for the exact check counts as the grammar says.
"""

from __future__ import annotations

import ast
import json
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.gll import accepts
from knotwork.llm.grammars import LANGUAGES, Malformed


def dialects(extension: str, text: str) -> set[str]:
    """The dialects of the extension's language that accept the text."""
    lexer, grammar = LANGUAGES[extension]
    try:
        return accepts(grammar, lexer(text))
    except (Malformed, RecursionError):
        return set()


def _refused(constant: str):
    raise ValueError(constant)


def exact(extension: str, text: str) -> bool | None:
    """What the standard library's parser says; None where it has none or cannot tell."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if extension in ("py", "pyi"):
                ast.parse(text, feature_version=(3, 12))
            elif extension == "json":
                json.loads(text, parse_constant=_refused)
            elif extension == "toml":
                tomllib.loads(text)
            else:
                return None
        return True
    except (RecursionError, MemoryError):
        return None
    except (SyntaxError, ValueError):
        return False


def parses(extension: str, text: str) -> bool:
    """Whether a dialect accepts the text and the exact check, where there is one, does not refuse it."""
    return bool(dialects(extension, text)) and exact(extension, text) is not False


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"file_id": b["file_id"], "ok": [parses(e, t) for e, t in zip(b["ext"], b["content"], strict=True)]})


def judged(files: DataFrame) -> DataFrame:
    """file_id, ok of every file whose extension has a grammar and whose content is there."""
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    some = files.select(F.col("file_id").cast("long").alias("file_id"), ext.alias("ext"), "content").filter(F.col("ext").isin(*LANGUAGES) & F.col("content").isNotNull() & F.col("file_id").isNotNull())
    # contents differ much in length: small partitions keep the cores evenly busy
    spread = some.repartition(max(24, some.sparkSession.sparkContext.defaultParallelism * 4), "file_id")
    return spread.mapInPandas(_judge, "file_id long, ok boolean").groupBy("file_id").agg(F.bool_and("ok").alias("ok"))


def unparsable(files: DataFrame) -> DataFrame:
    """file_id of every file that no dialect of its language accepts."""
    return judged(files).filter("not ok").select("file_id")


def unparsable_rates(files: DataFrame) -> DataFrame:
    """repo, language (unknown where null), n_files with content, n_invalid, rate."""
    each = files.filter("file_id is not null and content is not null").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.min("repo").alias("repo"), F.coalesce(F.min("language"), F.lit("unknown")).alias("language"))
    return each.join(judged(files), "file_id", "left").groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("n_invalid")).withColumn("rate", F.col("n_invalid") / F.col("n_files"))
