"""Resolving raw references into typed edges, as staged equi-joins.

Prefixes and suffixes of dotted names are exploded, so longest-prefix and suffix matches are joins on equal keys. Every
join is scoped by repo. Where several candidates stand, one in the asking file is certain ('high'), else the one whose
name shares the longest beginning with the asking module, then the shortest, then the first by key, is taken as 'low'.

Cases: references without a source node or with null names give no edge; self-edges and repeated (source, target,
relation) are dropped, the first reference deciding the confidence; ties are broken by key; empty tables give no edges;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.text import is_test_path
from knotwork.operators.parse import BUILTINS
from knotwork.session import materialize

LINKABLE = ("module", "class", "function", "method", "test")
SYMBOLS = ("class", "function", "method")
# Names too common for a match by name alone, beside those of the built-in containers.
COMMON = frozenset(
    """run start stop close open get set add update read write send call execute process handle load save parse build create
    delete remove init setup reset clear copy format info debug warning error exception log main apply render validate check
    wait next items keys values append extend insert join split strip encode decode dump dumps loads fetch list name value
    data result connect commit rollback flush emit on off then catch push map filter reduce forEach toString length test
    cancel done submit""".split()
) | {n for t in (dict, list, str, set, object) for n in dir(t)}
#: Re-exports are followed this often, base classes this deep.
HOPS, DEPTH = 3, 5


def _parts(name: Column) -> Column:
    return F.split(name, r"\.")


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def _repo(df: DataFrame) -> DataFrame:
    return df.withColumn("repo", F.coalesce("repo", F.lit("")))


class Names:
    """The lookup tables of a set of nodes (repo, key, type, name, qualname, file_path, start_line, parent_key)."""

    def __init__(self, nodes: DataFrame, refs: DataFrame):
        cols = ["repo", "key", "type", "name", "qualname", "file_path", "start_line", "parent_key"]
        self.nodes = materialize(_repo(nodes.select(*cols)).filter("key is not null").dropDuplicates(["repo", "key"]))
        self.linkable = self.nodes.filter(F.col("type").isin(*LINKABLE))
        p = _parts(F.col("qualname"))
        suffixes = self.linkable.filter(F.size(p) > 2).select("repo", F.explode(F.transform(F.sequence(F.lit(2), F.size(p) - 1), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))).alias("full"), "key", "type", "qualname", "file_path", F.lit(1).alias("tier"))
        exact = self.linkable.select("repo", F.col("qualname").alias("full"), "key", "type", "qualname", "file_path", F.lit(0).alias("tier"))
        # only the better tier of a name counts: exact names before suffixes
        both = exact.unionByName(suffixes).withColumn("best", F.min("tier").over(Window.partitionBy("repo", "full")))
        self.quals = materialize(both.filter("tier = best").drop("tier", "best").dropDuplicates(["repo", "full", "key"]).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("repo", "full"))).withColumn("n_file", F.count(F.lit(1)).over(Window.partitionBy("repo", "full", "file_path"))))
        self.modules = self.nodes.filter(F.col("type").isin("module", "file")).select("repo", "file_path", F.col("key").alias("module_key"), F.col("type").alias("module_type"), F.when(F.col("type") == "module", F.col("qualname")).alias("modname"))
        self.modules = materialize(_first(self.modules, ["repo", "file_path"], F.col("module_key")))
        imports = refs.filter("kind = 'import'").select("repo", "file_path", "ordinal", "name", "target")
        named = imports.filter("name != '*'").select("repo", "file_path", F.col("name").alias("alias"), F.coalesce("target", "name").alias("target"), "ordinal")
        self.aliases = materialize(_first(named, ["repo", "file_path", "alias"], F.desc("ordinal")).drop("ordinal"))
        self.stars = imports.filter("name = '*'").select("repo", "file_path", F.coalesce("target", F.lit("")).alias("base"), F.col("ordinal").alias("star"))
        # one name, one symbol: what a match by name alone may take
        self.unique = self.linkable.filter(F.col("type").isin(*SYMBOLS)).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("target_key")).filter("n = 1").drop("n").filter((F.length("name") >= 4) & ~F.col("name").isin(*COMMON) & ~F.col("name").startswith("__"))
        self.children = _first(self.linkable.filter("parent_key is not null").select("repo", F.col("parent_key").alias("class_key"), "name", F.col("key").alias("method_key"), "start_line"), ["repo", "class_key", "name"], F.desc("start_line"), F.desc("method_key")).drop("start_line")

    def pick(self, asked: DataFrame, full: str = "full") -> DataFrame:
        """asked (id, repo, file_path, full) with target_key, target_type, target_file, confidence where a name is known."""
        q = self.quals.select("repo", F.col("full").alias(full), F.col("key").alias("target_key"), F.col("type").alias("target_type"), F.col("qualname").alias("target_qual"), F.col("file_path").alias("target_file"), "n", "n_file")
        mod = self.modules.select("repo", "file_path", "modname")
        near = asked.join(q, ["repo", full]).join(mod, ["repo", "file_path"], "left")
        a, b = _parts(F.coalesce("modname", F.lit(""))), _parts(F.col("target_qual"))
        same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, e: F.struct((s.k + (s.on & e).cast("int")).alias("k"), (s.on & e).alias("on")))
        here = F.coalesce((F.col("target_file") == F.col("file_path")) & (F.col("n_file") == 1), F.lit(False))
        near = near.withColumn("_sure", (F.col("n") == 1) | here).withColumn("_shared", same.k)
        best = _first(near, ["id"], F.desc(F.col("_sure")), F.desc("_shared"), F.length("target_qual"), F.col("target_key"))
        return best.withColumn("confidence", F.when(F.col("_sure"), F.lit("high")).otherwise(F.lit("low"))).select("id", "repo", "file_path", full, "target_key", "target_type", "target_file", "confidence")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """id, target_key, target_type, confidence of full names, through package re-exports. asked: id, repo, file_path, full."""
        asked = materialize(asked.select("id", "repo", "file_path", "full").filter("full is not null and full != ''"))
        found = None
        for hop in range(HOPS + 1):
            hit = materialize(self.pick(asked))
            part = hit.select("id", "target_key", "target_type", "confidence")
            found = part if found is None else found.unionByName(part)
            left = asked.join(hit.select("id"), "id", "left_anti")
            if hop == HOPS:
                break
            p = _parts(F.col("full"))
            heads = left.filter(F.size(p) > 1).select("id", "repo", "file_path", "full", F.explode(F.sequence(F.lit(1), F.size(p) - 1)).alias("cut")).withColumn("head", F.array_join(F.slice(p, 1, F.col("cut")), "."))
            heads = heads.withColumn("_id", F.col("id")).withColumn("id", F.struct("id", "cut"))
            modules = self.pick(heads.select("id", "repo", "file_path", "head"), "head").filter("target_type = 'module'").select(F.col("id.id").alias("_id"), F.col("id.cut").alias("cut"), "target_file")
            deepest = _first(modules, ["_id"], F.desc("cut")).withColumnRenamed("_id", "id")
            step = left.join(deepest, "id").withColumn("alias", F.element_at(p, F.col("cut") + 1))
            a = self.aliases.select("repo", F.col("file_path").alias("target_file"), "alias", "target")
            again = step.join(a, ["repo", "target_file", "alias"]).filter("target != full").select("id", "repo", "file_path", F.array_join(F.concat(F.array("target"), F.slice(p, F.col("cut") + 2, F.size(p))), ".").alias("full"))
            asked = materialize(again)
            if asked.isEmpty():
                break
        return found

    def expand(self, asked: DataFrame) -> DataFrame:
        """asked (id, repo, file_path, name) with full, the name behind the file's imports, and aliased."""
        p = _parts(F.col("name"))
        heads = asked.select("id", "repo", "file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(p, 1, i), ".").alias("alias")))).alias("x")).select("id", "repo", "file_path", "x.*")
        longest = _first(heads.join(self.aliases, ["repo", "file_path", "alias"]), ["id"], F.desc("cut")).select("id", "target", F.length("alias").alias("taken"))
        head_alias = heads.filter("cut = 1").join(self.aliases.select("repo", "file_path", "alias"), ["repo", "file_path", "alias"]).select("id", F.lit(True).alias("aliased"))
        own = asked.join(self.modules.filter("modname is not null").select("repo", "file_path", "modname"), ["repo", "file_path"]).withColumn("qualname", F.concat("modname", F.lit("."), F.element_at(p, 1)))
        own = own.join(self.linkable.select("repo", "qualname").distinct(), ["repo", "qualname"], "left_semi").select("id", F.concat("modname", F.lit("."), "name").alias("own"))
        out = asked.join(longest, "id", "left").join(own, "id", "left").join(head_alias, "id", "left")
        direct = F.when(F.col("target").isNotNull(), F.concat("target", F.substring(F.col("name"), F.col("taken") + 1, F.length("name")))).otherwise(F.col("own"))
        out = materialize(out.withColumn("full", direct).withColumn("aliased", F.coalesce("aliased", F.lit(False))).drop("target", "taken", "own"))
        starred = out.filter("full is null").join(self.stars, ["repo", "file_path"]).withColumn("full", F.when(F.col("base") == "", F.col("name")).otherwise(F.concat("base", F.lit("."), "name")))
        tried = materialize(starred.withColumn("id", F.struct("id", "star")).select("id", "repo", "file_path", "full"))
        if not tried.isEmpty():
            hit = self.lookup(tried).select("id").join(tried.select("id", "full"), "id").select(F.col("id.id").alias("id"), F.col("id.star").alias("star"), F.col("full").alias("starred"))
            out = out.join(_first(hit, ["id"], F.col("star")).drop("star"), "id", "left").withColumn("full", F.coalesce("full", "starred")).drop("starred")
        return out.withColumn("full", F.coalesce("full", "name"))

    def methods(self, inherits: DataFrame) -> DataFrame:
        """repo, class_key, name, method_key: each class's methods, its own before those of its bases in depth-first order."""
        up = inherits.select("repo", "class_key", F.col("base_key"), F.col("place").cast("int").alias("place"))
        line = self.nodes.filter("type = 'class'").select("repo", F.col("key").alias("class_key"), F.col("key").alias("at"), F.array().cast("array<int>").alias("path"))
        every = line
        for _ in range(DEPTH):
            step = line.join(up.select("repo", F.col("class_key").alias("at"), F.col("base_key"), "place"), ["repo", "at"])
            line = materialize(step.select("repo", "class_key", F.col("base_key").alias("at"), F.concat("path", F.array("place")).alias("path")))
            every = every.unionByName(line)
            if line.isEmpty():
                break
        held = every.join(self.children.withColumnRenamed("class_key", "at"), ["repo", "at"])
        return held.groupBy("repo", "class_key", "name").agg(F.min_by("method_key", F.struct("path", "method_key")).alias("method_key"))


def _general(names: Names, asked: DataFrame, methods: DataFrame) -> DataFrame:
    """id, target_key, target_type, confidence: by import and full name, else as a method of a known class, else by name."""
    full = materialize(names.expand(asked.select("id", "repo", "file_path", "name")))
    hit = materialize(names.lookup(full))
    left = full.join(hit.select("id"), "id", "left_anti")
    dotted = left.filter(F.size(_parts(F.col("name"))) >= 2).withColumn("last", F.element_at(_parts(F.col("name")), -1)).withColumn("owner", F.regexp_replace("full", r"\.[^.]*$", ""))
    owners = materialize(names.lookup(dotted.select("id", "repo", "file_path", F.col("owner").alias("full"))))
    owned = dotted.join(owners.filter("target_type = 'class'").select("id", F.col("target_key").alias("class_key"), "confidence"), "id").withColumnRenamed("name", "_name").withColumnRenamed("last", "name").join(methods, ["repo", "class_key", "name"]).select("id", F.col("method_key").alias("target_key"), F.lit("method").alias("target_type"), "confidence")
    free = dotted.filter(~F.col("aliased") & ~F.element_at(_parts(F.col("name")), 1).isin(*sorted(BUILTINS))).join(owners.select("id"), "id", "left_anti")
    return hit.unionByName(owned).unionByName(_by_name(names, free.select("id", "repo", F.col("last").alias("name"))))


def _by_name(names: Names, asked: DataFrame) -> DataFrame:
    return asked.join(names.unique, ["repo", "name"]).select("id", "target_key", F.lit("symbol").alias("target_type"), F.lit("low").alias("confidence"))


def resolve(names: Names, asked: DataFrame, methods: DataFrame, bases: DataFrame) -> DataFrame:
    """id, target_key, confidence of names as written in code. asked: id, repo, file_path, name, scope."""
    p = _parts(F.col("name"))
    asked = materialize(asked.withColumn("head", F.element_at(p, 1)).withColumn("last", F.element_at(p, -1)).withColumn("n_parts", F.size(p)))
    classes = _first(names.nodes.filter("type = 'class'").select("repo", F.col("qualname").alias("scope"), "file_path", F.col("key").alias("class_key"), "start_line"), ["repo", "scope", "file_path"], F.col("start_line"), F.col("class_key")).drop("start_line")
    own = asked.filter("head in ('self', 'cls') and scope is not null and n_parts >= 2")
    inside = own.filter("n_parts = 2").join(classes, ["repo", "scope", "file_path"]).select("id", "repo", "class_key", F.col("last").alias("name")).join(methods, ["repo", "class_key", "name"]).select("id", F.col("method_key").alias("target_key"), F.lit("high").alias("confidence"))
    beside = _by_name(names, own.join(inside.select("id"), "id", "left_anti").select("id", "repo", F.col("last").alias("name"))).drop("target_type")
    above = asked.filter("head = 'super()' and scope is not null and n_parts = 2").join(classes, ["repo", "scope", "file_path"]).join(bases.select("repo", "class_key", "base_key", "place"), ["repo", "class_key"])
    above = above.select("id", "repo", "place", F.col("base_key").alias("class_key"), F.col("last").alias("name")).join(methods, ["repo", "class_key", "name"])
    above = _first(above, ["id"], F.col("place"), F.col("method_key")).select("id", F.col("method_key").alias("target_key"), F.lit("high").alias("confidence"))
    unknown = _by_name(names, asked.filter("head = '?'").select("id", "repo", F.col("last").alias("name"))).drop("target_type")
    plain = _general(names, asked.filter("head not in ('self', 'cls', 'super()', '?')"), methods).drop("target_type")
    return inside.unionByName(beside).unionByName(above).unionByName(unknown).unionByName(plain)


def link(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """repo, source_key, target_key, relation, confidence (null where not judged) of all references.

    nodes: as parse.NODE with repo; refs: repo, file_path, src_key, ordinal, kind, name, target, scope.
    """
    refs = _repo(refs).filter("src_key is not null and name is not null").withColumn("id", F.struct("repo", "file_path", "src_key", "ordinal"))
    refs = materialize(refs)
    names = Names(nodes, refs)
    refs = materialize(refs.join(names.nodes.select("repo", F.col("key").alias("src_key")), ["repo", "src_key"], "left_semi"))
    none = names.children  # a class's own methods, before any base is known

    inherit = refs.filter("kind = 'inherit'")
    up = _general(names, inherit, none)
    classes = names.nodes.filter("type = 'class'").select("repo", F.col("key").alias("target_key"))
    up = inherit.select("id", "repo", "src_key", "ordinal").join(up.select("id", "target_key", "confidence"), "id").join(classes, ["repo", "target_key"], "left_semi")
    up = materialize(up)
    bases = up.select("repo", F.col("src_key").alias("class_key"), F.col("target_key").alias("base_key"), F.row_number().over(Window.partitionBy("repo", "src_key").orderBy("ordinal", "target_key")).alias("place"))
    methods = materialize(names.methods(bases))
    inherits = up.select("repo", F.col("src_key").alias("source_key"), "target_key", F.lit("inherits").alias("relation"), "confidence", "ordinal")

    imports = refs.filter("kind = 'import' and name != '*' and target is not null")
    whole = materialize(names.lookup(imports.select("id", "repo", "file_path", F.col("target").alias("full"))))
    rest = imports.join(whole.select("id"), "id", "left_anti").filter("instr(target, '.') > 0")
    around = names.lookup(rest.select("id", "repo", "file_path", F.regexp_replace("target", r"\.[^.]*$", "").alias("full")))
    imported = imports.select("id", "repo", "src_key", "ordinal").join(whole.unionByName(around), "id").select("repo", F.col("src_key").alias("source_key"), "target_key", F.lit("imports").alias("relation"), "confidence", "ordinal")

    used = refs.filter("kind in ('call', 'reference')")
    hits = resolve(names, used.select("id", "repo", "file_path", "name", "scope"), methods, bases)
    uses = materialize(used.select("id", "repo", "src_key", "kind", "ordinal").join(hits, "id").select("repo", F.col("src_key").alias("source_key"), "target_key", F.when(F.col("kind") == "call", F.lit("calls")).otherwise(F.lit("references")).alias("relation"), "confidence", "ordinal"))

    edges = contains(names.nodes).withColumn("ordinal", F.lit(0)).unionByName(inherits).unionByName(imported).unionByName(uses).unionByName(mentions(names, refs))
    edges = edges.unionByName(tested_by(names.nodes, uses).withColumn("ordinal", F.lit(0)))
    tidy = edges.filter("source_key != target_key").groupBy("repo", "source_key", "target_key", "relation").agg(F.min_by(F.struct("confidence"), F.struct("ordinal", F.coalesce("confidence", F.lit("")))).alias("c"))
    tidy = materialize(tidy.select("repo", "source_key", "target_key", "relation", F.col("c.confidence").alias("confidence")))
    return tidy.unionByName(tested_by_name(names.nodes, tidy))


def contains(nodes: DataFrame) -> DataFrame:
    """Parent-child edges where both ends are there."""
    return nodes.filter("parent_key is not null").select("repo", F.col("parent_key").alias("source_key"), F.col("key").alias("target_key")).join(nodes.select("repo", F.col("key").alias("source_key")).distinct(), ["repo", "source_key"], "left_semi").select("repo", "source_key", "target_key", F.lit("contains").alias("relation"), F.lit(None).cast("string").alias("confidence"))


def mentions(names: Names, refs: DataFrame) -> DataFrame:
    """documented_by edges from what a section of documentation names to the section."""
    said = refs.filter("kind = 'mention'").select("id", "repo", F.lit(None).cast("string").alias("file_path"), "src_key", "ordinal", "name")
    dotted = said.filter("instr(name, '.') > 0")
    sure = names.lookup(dotted.select("id", "repo", "file_path", F.col("name").alias("full"))).filter("confidence = 'high'").select("id", "target_key")
    plain = said.filter((F.instr("name", ".") == 0) & (F.length("name") >= 4) & ~F.col("name").isin(*COMMON))
    known = names.linkable.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("k"), F.count_if(F.col("type") == "class").alias("n_class"), F.min(F.when(F.col("type") == "class", F.col("key"))).alias("k_class"))
    only = plain.join(known, ["repo", "name"]).select("id", F.when(F.col("n") == 1, F.col("k")).when(F.col("n_class") == 1, F.col("k_class")).alias("target_key")).filter("target_key is not null")
    out = said.select("id", "repo", "src_key", "ordinal").join(sure.unionByName(only), "id")
    paths = refs.filter("kind = 'path_mention'").select("id", "repo", "file_path", "src_key", "ordinal", F.trim(F.col("name"), F.lit("/")).alias("asked"))
    met = resolve_paths(names.modules, paths).join(names.modules.select("repo", "file_path", F.col("module_key").alias("own")), ["repo", "file_path"], "left").filter("own is null or own != target_key").select("id", "repo", "src_key", "ordinal", "target_key")
    return out.select("id", "repo", "src_key", "ordinal", "target_key").unionByName(met).select("repo", F.col("target_key").alias("source_key"), F.col("src_key").alias("target_key"), F.lit("documented_by").alias("relation"), F.lit(None).cast("string").alias("confidence"), "ordinal")


def resolve_paths(modules: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (repo, asked, ...) with target_key: the file of that path, else the only one whose path ends with it."""
    p = F.split(F.col("file_path"), "/")
    ends = modules.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct((i == 1).alias("exact"), F.array_join(F.slice(p, i, F.size(p)), "/").alias("asked")))).alias("x"), "module_key").select("repo", "x.*", "module_key")
    one = ends.groupBy("repo", "asked").agg(F.min(F.when(F.col("exact"), F.col("module_key"))).alias("exact_key"), F.count_if(~F.col("exact")).alias("n"), F.min(F.when(~F.col("exact"), F.col("module_key"))).alias("end_key"))
    known = one.select("repo", "asked", F.coalesce("exact_key", F.when(F.col("n") == 1, F.col("end_key"))).alias("target_key")).filter("target_key is not null")
    return asked.join(known, ["repo", "asked"])


def tested_by(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Whoever is called from a test path, and its parent unless a module, is tested by the caller."""
    n = nodes.select("repo", "key", "type", "file_path", "parent_key")
    src = n.select("repo", F.col("key").alias("source_key"), F.col("file_path").alias("from_path"))
    dst = n.select("repo", F.col("key").alias("target_key"), F.col("file_path").alias("to_path"), "parent_key")
    parents = n.filter("type != 'module'").select("repo", F.col("key").alias("parent_key"), F.lit(True).alias("fit"))
    met = calls.filter("relation = 'calls'").select("repo", "source_key", "target_key").join(src, ["repo", "source_key"]).filter(is_test_path(F.col("from_path"))).join(dst, ["repo", "target_key"]).filter(~is_test_path(F.col("to_path"))).join(parents, ["repo", "parent_key"], "left")
    both = F.explode(F.array_compact(F.array("target_key", F.when(F.col("fit"), F.col("parent_key")))))
    return met.select("repo", both.alias("tested"), F.col("source_key").alias("target_key")).distinct().select("repo", F.col("tested").alias("source_key"), "target_key", F.lit("tested_by").alias("relation"), F.lit(None).cast("string").alias("confidence"))


def tested_by_name(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """test_x.py or x_test.py tests x.py where one module alone has the name and no such edge is there."""
    modules = nodes.filter("type = 'module'").select("repo", "key", "name", "file_path")
    plain = modules.filter(~is_test_path(F.col("file_path"))).groupBy("repo", F.col("name").alias("stem")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("source_key")).filter("n = 1").drop("n")
    base = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.py$", "")
    tests = modules.filter(is_test_path(F.col("file_path"))).select("repo", F.regexp_replace(F.regexp_replace(base, "^test_", ""), "_test$", "").alias("stem"), F.col("key").alias("target_key"))
    found = tests.join(plain, ["repo", "stem"]).select("repo", "source_key", "target_key", F.lit("tested_by").alias("relation"), F.lit("low").alias("confidence"))
    return found.join(edges.filter("relation = 'tested_by'").select("repo", "source_key", "target_key"), ["repo", "source_key", "target_key"], "left_anti")


def find_symbols(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """symbol, key, tier, place, n: the nodes that each asked symbol may mean, the best first, and how many there are.

    A symbol is `path:line` (tier 0), a qualified name (1), a name (2) or the end of a qualified name (3); only the first
    tier that finds something counts. asked: symbol; nodes: key, type, name, qualname, file_path, start_line, end_line,
    importance. Case and wildcards are taken as they stand; null and blank symbols find nothing."""
    c = F.col
    asked = asked.select(F.trim("symbol").alias("symbol")).filter("symbol != ''").distinct()
    n = nodes.filter(F.coalesce("type", F.lit("")) != "memory").select("key", "type", "name", "qualname", "file_path", "start_line", "end_line", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    at = asked.select("symbol", F.regexp_extract("symbol", r"^(.+):(\d{1,9})$", 1).alias("file_path"), F.regexp_extract("symbol", r"^(.+):(\d{1,9})$", 2).try_cast("int").alias("line")).filter("line is not null")
    lines = at.join(n, "file_path").filter("start_line <= line and end_line >= line").select("symbol", "key", "type", "importance", F.lit(0).alias("tier"), (c("end_line") - c("start_line")).alias("size"))
    p = _parts(c("qualname"))
    ends = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.struct(F.when(i == 1, 1).otherwise(3).alias("tier"), F.array_join(F.slice(p, i, F.size(p)), ".").alias("symbol")))
    names = n.select("key", "type", "importance", F.explode(F.concat(ends, F.array(F.struct(F.lit(2).alias("tier"), c("name").alias("symbol"))))).alias("x")).select("x.symbol", "key", "type", "importance", "x.tier", F.lit(0).alias("size"))
    every = lines.unionByName(names.join(asked, "symbol", "left_semi")).groupBy("symbol", "key").agg(F.min("tier").alias("tier"), F.min("size").alias("size"), F.first("type").alias("type"), F.first("importance").alias("importance"))
    best = every.groupBy("symbol").agg(F.min("tier").alias("tier"))
    found = materialize(every.join(best, ["symbol", "tier"]))
    counts = found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("symbol").orderBy("size", F.coalesce(c("type") == "test", F.lit(False)), F.coalesce(c("type") == "module", F.lit(False)) & ~c("symbol").contains("."), F.desc("importance"), "key")
    return found.withColumn("place", F.row_number().over(order)).join(counts, "symbol").select("symbol", "key", "tier", "place", "n")
