"""Import specifiers to file nodes.

Suffix lookups become equi-joins: every file (or directory) contributes its
path suffixes, every specifier its candidates in order of preference.  Where
only the first match counts, suffixes are reduced to their first file before
the join, so a suffix shared by many files stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.identifiers import dirname, file_id, normalize_path
from graphloom.session import cut, shuffled, spread

# Candidate extensions, in order.
TS_JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
LANGUAGES = {
    "ts": ".ts .tsx .js .jsx .mjs .cjs",
    "jvm": ".java .kt",
    "python": ".py",
    "apple": ".swift .m .h",
    "go": ".go",
}


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.[^./]+$", 0)
    expr = None
    for lang, exts in LANGUAGES.items():
        hit = ext.isin(*exts.split())
        expr = F.when(hit, lang) if expr is None else expr.when(hit, lang)
    return expr


def _suffixes(path: Column) -> Column:
    """All segment-aligned suffixes of a lower-case path."""
    parts = F.split(F.lower(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _first_by_suffix(files: DataFrame) -> DataFrame:
    return (
        files.select("ord", "id", F.explode(_suffixes(F.col("file"))).alias("cand"))
        .groupBy("cand").agg(F.min(F.struct("ord", "id")).alias("f"))
    )


def _pick_first(cands: DataFrame, files: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Best candidate per specifier: least preference, then least file."""
    return (
        cands.join(shuffled(_first_by_suffix(files) if first is None else first), "cand").groupBy("specifier")
        .agg(F.min(F.struct("pref", "f")).alias("best")).select("specifier", F.col("best.f.id").alias("target"))
    )


def _dropping(parts: Column, tails: list[str]) -> Column:
    """Candidates with 0, 1, 2, ... trailing parts dropped."""
    return F.flatten(F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda d: F.array(*[
            F.struct(d.alias("pref"), F.lower(F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - d), "/"), F.lit(t))).alias("cand"))
            for t in tails
        ]),
    ))


def resolve_jvm(specs: DataFrame, files: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Dotted names; `.*` takes every file of the package directory."""
    wild = F.col("specifier").endswith(".*")
    plain = specs.where(~wild).select("specifier", F.explode(_dropping(F.split("specifier", r"\."), [".kt", ".java"])).alias("c")).select("specifier", "c.*")
    named = _pick_first(plain, files, first)
    pkg = specs.where(wild).select("specifier", F.lower(F.concat(F.replace(F.regexp_replace("specifier", r"\.\*$", ""), F.lit("."), F.lit("/")), F.lit("/"))).alias("cand"))
    # A package may end inside a directory name: all character suffixes of
    # the distinct directories.
    d = F.lower(F.regexp_replace("file", r"[^/]*$", ""))
    dirs = files.select(d.alias("dir")).distinct().where("dir <> ''")
    ends = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.length("dir")), lambda i: F.substr(F.col("dir"), i))).alias("cand"))
    hit_dirs = pkg.join(shuffled(ends), "cand").select("specifier", "dir")
    many = hit_dirs.join(shuffled(files.select(d.alias("dir"), F.col("id").alias("target"))), "dir").select("specifier", "target")
    return named.unionByName(many)


def resolve_python_absolute(specs: DataFrame, files: DataFrame, first: DataFrame | None = None) -> DataFrame:
    cands = specs.select("specifier", F.explode(_dropping(F.split("specifier", r"\."), [".py", "/__init__.py"])).alias("c")).select("specifier", "c.*")
    return _pick_first(cands, files, first)


def resolve_apple(specs: DataFrame, files: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """Quoted headers by file name (then the Swift namesake); modules by directory."""
    s = F.col("specifier")
    quoted = s.rlike(r"(?i)\.(h|m|mm)$")
    cands = specs.where(quoted).select("specifier", F.explode(F.array(
        F.struct(F.lit(0).alias("pref"), F.lower(s).alias("cand")),
        F.struct(F.lit(1).alias("pref"), F.lower(F.concat(F.regexp_replace(s, r"\.[^./]+$", ""), F.lit(".swift"))).alias("cand")),
    )).alias("c")).select("specifier", "c.*")
    named = _pick_first(cands, files, first)
    module = specs.where(~quoted).select("specifier", F.lower(F.split(s, r"\.")[0]).alias("name")).where("name <> ''")
    parent = files.select(F.lower(F.element_at(F.split(dirname("file"), "/"), -1)).alias("name"), F.col("id").alias("target"), "file").where(F.instr("file", "/") > 0)
    return named.unionByName(module.join(shuffled(parent), "name").select("specifier", "target"))


def resolve_go(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Package paths: leading segments are dropped until a directory matches."""
    go = files.where(F.lower(F.col("file")).endswith(".go")).select(F.lower(dirname("file")).alias("dir"), F.col("id").alias("target"))
    ends = go.select("dir").distinct().select("dir", F.explode(_suffixes(F.col("dir"))).alias("cand"))
    parts = F.filter(F.split("specifier", "/"), lambda p: p != "")
    cands = specs.select("specifier", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(i.alias("pref"), F.lower(F.array_join(F.slice(parts, i, F.size(parts)), "/")).alias("cand")),
    )).alias("c")).where("specifier <> ''").select("specifier", "c.*")
    hits = cands.join(shuffled(ends), "cand").select("specifier", "pref", "dir")
    best = hits.groupBy("specifier").agg(F.min("pref").alias("pref"))
    return hits.join(shuffled(best), ["specifier", "pref"]).join(shuffled(go), "dir").select("specifier", "target")


def _resolve_exact(imports: DataFrame, files: DataFrame, cands: Column) -> DataFrame:
    """First candidate path whose node id is known; depends on the importer."""
    c = imports.select("file_path", "specifier", F.posexplode(cands).alias("pref", "cand"))
    c = c.withColumn("id", file_id("cand"))
    return (
        c.join(shuffled(files.select("id").distinct()), "id").groupBy("file_path", "specifier")
        .agg(F.min_by("id", "pref").alias("target"))
    )


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """TypeScript / JavaScript relative specifiers."""
    rel = imports.where(F.col("specifier").startswith("."))
    base = normalize_path(F.concat(dirname("file_path"), F.lit("/"), F.col("specifier")))
    known = F.lit(False)
    for e in TS_JS_EXTENSIONS:
        known = known | base.endswith(e)
    cands = F.when(known, F.array(base)).otherwise(F.array(
        *[F.concat(base, F.lit(e)) for e in TS_JS_EXTENSIONS],
        *[F.concat(base, F.lit(f"/index{e}")) for e in TS_JS_EXTENSIONS],
    ))
    return _resolve_exact(rel, files, cands)


def resolve_python_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Leading dots go up from the importer's directory."""
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    rest = F.regexp_replace("specifier", r"^\.+", "")
    up = F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/")
    base = normalize_path(F.concat_ws("/", dirname("file_path"), up, F.replace(rest, F.lit("."), F.lit("/"))))
    rel = imports.where(F.col("specifier").startswith(".") & (rest != ""))
    return _resolve_exact(rel, files, F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))))


def import_edges(raw: DataFrame, files: DataFrame) -> DataFrame:
    """`(source, target)` for raw imports `(file_path, specifier)`.

    `files(ord, id, file)`.  Specifiers that do not depend on the importer are
    resolved once per distinct specifier.  A source with one specifier cannot
    have a target twice, so only the others' edges are compared.
    """
    files = cut(spread(files.select("ord", "id", "file")))
    lang = language_of(F.col("file_path"))
    dotted = (lang == "python") & F.col("specifier").startswith(".")
    rows = raw.select("file_path", "specifier", F.when(dotted, "dotted").otherwise(lang).alias("lang")).distinct()
    src = files.select(F.col("file").alias("file_path"), F.col("id").alias("source")).distinct()
    rows = rows.join(shuffled(src), "file_path")
    rows = cut(rows.withColumn("alone", F.count(F.lit(1)).over(W.partitionBy("source")) == 1))
    first = cut(_first_by_suffix(files))

    def of(name: str) -> DataFrame:
        return rows.where(F.col("lang") == name)

    def shared(name: str, fn, *more) -> DataFrame:
        return fn(of(name).select("specifier").distinct(), files, *more).distinct().select(F.lit(name).alias("lang"), "specifier", "target")

    found = cut(
        shared("jvm", resolve_jvm, first)
        .unionByName(shared("python", resolve_python_absolute, first))
        .unionByName(shared("apple", resolve_apple, first))
        .unionByName(shared("go", resolve_go))
    )
    exact = [fn(spread(of(name).select("file_path", "specifier")), files).withColumn("lang", F.lit(name))
             for name, fn in (("ts", resolve_relative), ("dotted", resolve_python_relative))]
    exact = cut(exact[0].unionByName(exact[1]))

    def edges(some: DataFrame) -> DataFrame:
        hits = some.join(shuffled(found), ["lang", "specifier"]).select("source", "target")
        hits = hits.unionByName(some.join(shuffled(exact), ["lang", "file_path", "specifier"]).select("source", "target"))
        return hits.where(F.col("source") != F.col("target"))

    return edges(rows.where("alone")).unionByName(edges(rows.where("NOT alone")).distinct())
