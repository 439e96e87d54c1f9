"""Generated, minified or vendored source files.

Method: linear support-vector classifiers on hashed character n-grams and path components. No labels come with the files,
so a bounded sample is labelled by what gives a file away: a tool's or a third party's header, a package's folder, the
shape of a lock file, of minified code or of dumped data. Headers are masked: the classifier sees only the text behind
them, the parts of the path and the measured shape of the text, neither in the fit nor in the scores any of the headers or
names that the labels were taken from. Validation splits by repository. The classifier retrieves the files: above SURE as they are; what
it is in doubt about, above DOUBT, is kept where an exact check finds the evidence of a label.

CANDIDATES, SAMPLE and PLAIN bound the rows that are labelled and that a classifier is fitted on; everything else reads all
files, whole.

Cases: null contents and paths are judged by what is there, and a file without both is not flagged; empty files are not
flagged; of several rows of a file each is judged, and one that is flagged flags the file; null ids are dropped; with no
packages the labels come from the other evidence; where the sample has no positive or no negative label there is nothing
to fit, and the files are judged by their evidence (column fitted of scored() says so); empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from knotwork.session import broadcast_if_small, folder, materialize

#: About so many files at most, drawn by a hash of their id, are labelled; so many positives and negatives are fitted on.
CANDIDATES, SAMPLE, PLAIN = 30_000, 3000, 12_000
#: What a positive weighs in the fit; scores above which a file is taken, and above which evidence takes it.
WEIGHT, SURE, DOUBT = 2.0, 0.5, -2.0
#: Package names are matched within tasks up to this many; of more, only those that stand in some file's path or header.
PACKAGES = 100_000
GRAMS, PATHS = 1 << 13, 1 << 10
#: What labels are taken from besides the shapes; none of it is a feature.
GIVEAWAYS = ("generated_header", "package_header", "package_folder", "lock_name")
#: Names of the features after the hashed ones.
SHAPES = ("dense", "long_lines", "literals", "table", "short_names", "lock_keys")
SIZE = 2 * GRAMS + PATHS + len(SHAPES)

# Headers and names that give a file away.
_GENERATED = re.compile(
    r"(?i:\bcode generated\b|@generated\b|\bauto-?generated\b|\bautomatically generated\b|\bthis file (?:is|was) generated\b|^\W*(?:\w+ )?generated (?:from|by|with|using)\b|\bmachine generated\b|\bdo not (?:edit|modify)\W+(?:run|re-?run|use|regenerate|by hand|manually|this file)\b"
    r"|\b(?:edits?|changes?) (?:are|is|will be|get) (?:overwritten|lost)\b)|\bDO NOT (?:EDIT|MODIFY|CHANGE)\b",
    re.M,
)
_LICENSED = re.compile(r"\b(?:licensed under|license:|released under|spdx-license-identifier)\b|\blicen[cs]e\b.*\bauthors\b", re.I)
_PATCHED = re.compile(r"^\W*local (?:patch|change|modification)\b", re.I | re.M)
_VERSIONED = re.compile(r"^\W*([a-z][\w.-]*)[ @]v?\d+\.\d+(?:\.\d+)*\W*$", re.I)
_LOCK_NAME = re.compile(r"(?:[.-]lock(?:\.(?:json|ya?ml|toml))?|(?:package|npm)-lock\.json|npm-shrinkwrap\.json|go\.sum)$", re.I)
_COMMENT = re.compile(r"\s*(?:#|//|/\*|\*|<!--|\[//\]:|--|;|%|$)")
_LITERAL = re.compile(r"(?<![\w.])-?\d[\w.]*(?=\s*[,\]\)}:])|(?<![rf\w])(?:\"[^\"\n]*\"|'[^'\n]*')(?=\s*[,\]\)}:])")
_NOISE = re.compile(r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|#[^\n]*|/\*(?:.|\n)*?\*/|^\s*//[^\n]*', re.M)


def header(text: str) -> str:
    """The comment lines that a text begins with."""
    out = []
    for line in text.split("\n"):
        if not _COMMENT.match(line):
            break
        out.append(line)
    return "\n".join(out)


def _lock_keys(text: str, extension: str) -> float:
    """Share of the entries of a JSON text that pin a version to a checksum."""
    if extension != "json":
        return 0.0
    hashes = len(re.findall(r'"[^"\n]*":\s*"(?:sha\d+-)?[0-9a-fA-F]{16,}[=/+\w]*"', text))
    versions = len(re.findall(r'"[^"\n]*":\s*"[~^=v]?\d+\.\d+(?:\.\d+)?"', text))
    return min(1.0, min(hashes, versions) / 3)


def evidence(path: str, text: str, packages: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """The giveaways and the shape of a file."""
    top = header(text)
    parts = path.split("/")
    extension = path.rsplit(".", 1)[-1].lower()
    lines = top.split("\n")
    package_header = _PATCHED.search(top) is not None or any((m := _VERSIONED.match(a)) and (m[1].lower() in packages or _LICENSED.search(b)) and _LICENSED.search(top) for a, b in zip(lines, [*lines[1:], ""], strict=True))
    give = [_GENERATED.search(top) is not None, package_header, any(p.lower() in packages for p in parts[:-1]), bool(_LOCK_NAME.search(path))]
    code = extension not in ("md", "markdown", "rst", "txt")
    bare = _NOISE.sub(" ", text) if code else ""
    tight = len(re.sub(r"\s+", "", bare))
    rows = [r for r in bare.split("\n") if r.strip()]
    longest = max(map(len, rows), default=0)
    spread = 1 - tight / max(1, len(bare.strip()))
    literal = [m[0] for m in _LITERAL.finditer(bare)] if extension not in ("json", "toml") else []
    share = sum(map(len, literal)) / max(1, tight)
    names = re.findall(r"(?<![\w.])[A-Za-z_]\w*", bare)
    short = sum(len(n.strip("_")) <= 1 for n in names) / max(1, len(names))
    shape = [
        code and extension not in ("json", "toml") and tight > 300 and spread < 0.12 and share < 0.5,
        min(1.0, longest / 2000) if code else 0.0,
        share,
        share > 0.55 and tight > 600,
        short if code and tight > 300 else 0.0,
        _lock_keys(text, extension),
    ]
    return np.array(give, np.float64), np.array(shape, np.float64)


def label(give: np.ndarray, shape: np.ndarray) -> int:
    return int(give.any() or shape[3] >= 1 or shape[5] >= 1 or (shape[0] >= 1 and shape[4] > 0.3) or shape[4] > 0.4)


def hashed(path: str, text: str) -> np.ndarray:
    """Character 4- and 6-grams of the text behind its header, and path components, hashed and of unit length each."""
    body = text[len(header(text)) :]
    b = np.frombuffer(re.sub(r"\d", "0", body).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = np.zeros(2 * GRAMS + PATHS)
    for k, n in enumerate((4, 6)):
        if len(b) >= n:
            h = np.zeros(len(b) - n + 1, np.uint32)
            for i in range(n):
                h = h * np.uint32(0x01000193) + b[i : len(b) - n + 1 + i]
            h = (h ^ (h >> 15)) * np.uint32(0x2C1B3C6D)
            v = np.log1p(np.bincount((h >> 19) & (GRAMS - 1), minlength=GRAMS))
            out[k * GRAMS : (k + 1) * GRAMS] = v / np.linalg.norm(v)
    parts = {w for c in path.lower().split("/") for w in (c, *re.split(r"[\W_\d]+", c)) if w}
    for w in parts:
        out[2 * GRAMS + zlib.crc32(w.encode()) % PATHS] += 1 / len(parts)
    return out


def _features(path: str, text: str, packages: frozenset[str]) -> tuple[np.ndarray, int]:
    """The features and the label."""
    give, shape = evidence(path, text, packages)
    return np.concatenate([hashed(path, text), shape]), label(give, shape)


def _packages(files: DataFrame, packages: DataFrame) -> frozenset[str]:
    names = packages.select(F.lower("package_name").alias("p")).filter("p is not null").distinct()
    if names.count() > PACKAGES:
        met = F.concat(F.split(F.lower("path"), "/"), F.regexp_extract_all(F.lower("content"), F.lit(r"(?m)^\W*([a-z][\w.-]*)[ @]v?\d+\."), 1))
        names = materialize(names.join(_files(files).select(F.explode(met).alias("p")).distinct(), "p", "left_semi"))
        if names.count() > 10 * PACKAGES:
            raise ValueError(f"more than {10 * PACKAGES} packages are named in the files; raise PACKAGES if the executors can hold them")
    return frozenset(r.p for r in names.collect())


def _files(files: DataFrame) -> DataFrame:
    some = files.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    return some.filter("file_id is not null and (length(trim(content)) > 0)")


def _draw(*names: str, salt: int):
    return F.pmod(F.xxhash64(*names, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def labelled(files: DataFrame, known: frozenset[str], sample: int = SAMPLE, plain: int = PLAIN, candidates: int = CANDIDATES) -> DataFrame:
    """label, features, half (of the repositories) of a bounded sample: at most so many positives and plain files."""
    some = _files(files)
    n = some.count()
    drawn = some.filter(_draw("file_id", salt=11) < candidates / max(n, 1)) if n > candidates else some

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_id": b["file_id"], "kind": [label(*evidence(p, t, known)) for p, t in zip(b["path"], b["content"], strict=True)]})

    each = materialize(drawn.mapInPandas(judge, "file_id long, kind int").groupBy("file_id").agg(F.max("kind").alias("kind")))
    counts = {r.kind: r.n for r in each.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for kind, m in counts.items():
        keep = keep | ((F.col("kind") == kind) & (_draw("file_id", salt=12) < min(1.0, (sample if kind else plain) / m)))
    # rows of one file differ rarely; one of them is learnt
    chosen = drawn.join(broadcast_if_small(materialize(each.filter(keep))), "file_id").groupBy("file_id").agg(F.min(F.struct("repo", "path", "content", "kind")).alias("f")).select("f.*", F.pmod(F.xxhash64("f.repo", F.lit(5)), F.lit(2)).alias("half"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, kind, p, t in zip(b["half"], b["kind"], b["path"], b["content"], strict=True):
                v = _features(p, t, known)[0]
                at = np.flatnonzero(v)
                rows.append(f"{2 * h + kind} " + " ".join([f"{k}:{x:.4g}" for k, x in zip((at + 1).tolist(), v[at].tolist(), strict=True)]))
            yield pd.DataFrame({"value": rows})

    # written as text, the sparse vectors are read back by the JVM
    path = f"{folder(files.sparkSession)}/{uuid.uuid4().hex}"
    chosen.mapInPandas(write, "value string").write.text(path)
    rows = files.sparkSession.read.format("libsvm").option("numFeatures", str(SIZE)).load(path) if counts else files.sparkSession.createDataFrame([], StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    return rows.select((F.col("label") % 2).alias("label"), "features", F.floor(F.col("label") / 2).alias("half"))


def _train(rows: DataFrame):
    if rows.select("label").distinct().count() < 2:
        return None
    weight = F.when(F.col("label") == 1, WEIGHT).otherwise(1.0)
    return LinearSVC(maxIter=40, regParam=2e-5, standardization=False, weightCol="w", aggregationDepth=2).fit(rows.select("label", "features", weight.alias("w")))


def fit(rows: DataFrame) -> np.ndarray | None:
    """Weights of the features, the intercept last; None where the sample has one label only.

    Files without a giveaway are labelled as written by hand, which some are not. So the repositories are split in two,
    either half is judged by a classifier of the other, and what it takes for a positive is no negative in the last fit."""
    rows = rows.persist()
    clean = rows.filter("label = 1")
    for k in (0, 1):
        model = _train(rows.filter(F.col("half") != k))
        plain = rows.filter((F.col("label") == 0) & (F.col("half") == k))
        clean = clean.unionByName(model.transform(plain).filter("prediction = 0").select(*rows.columns) if model is not None else plain)
    model = _train(clean)
    out = None if model is None else np.append(model.coefficients.toArray(), model.intercept)
    rows.unpersist()
    return out


def scored(files: DataFrame, known: frozenset[str], weights: np.ndarray | None) -> DataFrame:
    """file_id, repo, label, score, fitted; a score above 0 speaks for a file that was not written by hand."""
    shared = files.sparkSession.sparkContext.broadcast(weights)  # SIZE numbers

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["content"], strict=True):
                v, kind = _features(p, t, known)
                rows.append((kind, kind - 0.5 if w is None else float(v @ w[:-1] + w[-1])))
            yield b[["file_id", "repo"]].assign(label=[k for k, _ in rows], score=[x for _, x in rows], fitted=w is not None)

    return _files(files).mapInPandas(work, "file_id long, repo string, label int, score double, fitted boolean")


def not_written(files: DataFrame, packages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """file_id of the files that were made by a tool, minified, copied from a package, or dumped."""
    known = _packages(files, packages)
    found = scored(files, known, fit(labelled(files, known, sample)))
    return found.filter((F.col("score") > SURE) | ((F.col("score") > DOUBT) & (F.col("label") == 1))).select("file_id").distinct()


def validation(files: DataFrame, packages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """n_files, n_labelled, n_found, n_both, recall of the classifier alone over repositories that the fit did not see."""
    held = F.pmod(F.xxhash64(F.coalesce("repo", F.lit(""))), F.lit(5)) == 0
    known = _packages(files, packages)
    s = scored(files.filter(held), known, fit(labelled(files.filter(~held), known, sample)))
    s = s.groupBy("file_id").agg(F.max("label").alias("label"), F.max("score").alias("score"))
    out = s.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("n_labelled"), F.count_if(F.col("score") > 0).alias("n_found"), F.count_if((F.col("score") > 0) & (F.col("label") == 1)).alias("n_both"))
    return out.withColumn("recall", F.when(F.col("n_labelled") > 0, F.col("n_both") / F.col("n_labelled")))
