"""The compile-command table: entries(file, directory, args: array<string>) and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.functions.bounded import few
from symloom.functions.columns import glob_regex, suffix

#: Flags by what they concern (spelled out). Those of USER stay with the file; DISCARDED and
#: CODEGEN ones don't belong to a compile's identity; PAIRED ones take the next argument when
#: they stand alone.
USER = ("-I", "-isystem", "-iquote", "-idirafter", "-D", "-U", "-include")
DIRS = ("-I", "-isystem", "-iquote", "-idirafter")
DISCARDED = ("--", "-main-file-name", "-c", "-o", "-emit-pch", "-include-pch", "-E", "-M", "-MM", "-MD", "-MMD", "-MF", "-MT", "-MQ", "-MG", "-MP")
DISCARDED_PREFIXES = ("-fmodule-file", "-fmodule-output", "-fprebuilt-module-path", "--show-", "-show-")
#: The same for drivers with options of their own: a driver's base name, and how theirs begin.
DRIVER_PREFIXES = {r"(?i)(^|[/\\\\])(clang-)?cl(\.exe)?$": r"^[-/](Fo|Fd|Yu|Fp|showIncludes|showFilenames)", r"(?i)(^|[/\\\\])(clang-)?dxc(\.exe)?$": r"^[-/](Fc|Fo)"}
CODEGEN = (
    "-fPIC", "-fno-PIC", "-fpic", "-fno-pic", "-fPIE", "-fno-PIE", "-fpie", "-fno-pie", "-fomit-frame-pointer", "-fno-omit-frame-pointer",
    "-funwind-tables", "-fno-unwind-tables", "-fasynchronous-unwind-tables", "-fno-asynchronous-unwind-tables",
    "-fstack-protector", "-fstack-protector-strong", "-fstack-protector-all", "-fno-stack-protector",
    "-fdata-sections", "-fno-data-sections", "-ffunction-sections", "-fno-function-sections", "-flto", "-fno-lto",
    "-fsemantic-interposition", "-fno-semantic-interposition", "-fvisibility-inlines-hidden",
    "-fcolor-diagnostics", "-fno-color-diagnostics", "-ftrapping-math", "-fno-trapping-math",
)
#: Debug information, and options with a value.
CODEGEN_PATTERN = "^(-g(dwarf.*|gdb.*|line.*|split.*|codeview.*|column.*|[0-3])?|-mframe-pointer=.*|-flto=.*)$"
PAIRED = ("-o", "-MF", "-MT", "-MQ", "-main-file-name", "-include-pch", *USER)
#: Suffixes of C-family files.
C_FAMILY = (".c", ".cc", ".cpp", ".cxx", ".c++", ".C", ".h", ".hh", ".hpp", ".hxx", ".ixx", ".cppm", ".mpp", ".cu", ".m", ".mm")

#: Words of a command. Possessive, so that a long one is matched in a loop and not by recursion.
WORDS = r"""(?:[^\s"']++|"[^"]*+"|'[^']*+')++"""

CDB_SCHEMA = T.StructType([T.StructField("directory", T.StringType()), T.StructField("file", T.StringType()), T.StructField("command", T.StringType()), T.StructField("arguments", T.ArrayType(T.StringType()))])


def absolute(path: Column, directory: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(directory, F.lit("/"), path))


def cdb_entries(rows: DataFrame) -> DataFrame:
    """Rows of CDB_SCHEMA as entries; bad ones and files of other languages are dropped.

    A command text is split at white space outside of single or double quotes; a quote that isn't
    closed is left out."""
    words = F.transform(F.regexp_extract_all("command", F.lit(WORDS), F.lit(0)), lambda w: F.regexp_replace(w, "[\"']", ""))
    args = F.coalesce("arguments", words)
    good = rows.filter("directory is not null and file is not null and (arguments is not null or command is not null)")
    return good.filter(suffix(F.col("file")).isin(*C_FAMILY)).select(absolute(F.col("file"), F.col("directory")).alias("file"), "directory", args.alias("args"))


def read_cdb(spark: SparkSession, path: str) -> DataFrame:
    """A compile_commands.json: an array of objects. Rows that don't parse are dropped."""
    return cdb_entries(spark.read.schema(CDB_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path))


def classify_flags(entries: DataFrame, key: str = "file") -> DataFrame:
    """entries with canonical and patch (arrays in order): canonical has the compiler first, and
    then the arguments without the file itself, -Xclang -include-pch pairs, and flags of DISCARDED
    and CODEGEN; flags of USER go to patch, with their directories absolute."""
    rows = entries.withColumn("entry_", F.xxhash64(key, "directory", F.to_json(F.struct("args"))))
    flat = rows.select("entry_", "file", "directory", F.get("args", F.lit(0)).alias("driver"), F.posexplode("args").alias("pos", "arg"))
    order = Window.partitionBy("entry_", "file", "directory").orderBy("pos")
    for name, n in (("prev", -1), ("prev2", -2), ("prev3", -3), ("next", 1), ("next2", 2)):
        flat = flat.withColumn(name, F.lag("arg", -n).over(order) if n < 0 else F.lead("arg", n).over(order))
    flat = flat.withColumn("prev", F.lag("arg").over(order)).withColumn("prev2", F.lag("arg", 2).over(order)).withColumn("prev3", F.lag("arg", 3).over(order))
    c = F.col
    pch = ((c("arg") == "-Xclang") & c("next").isin("-include-pch")) | ((c("arg") == "-include-pch") & (c("prev") == "-Xclang")) | ((c("arg") == "-Xclang") & (c("prev") == "-include-pch")) | ((c("prev") == "-Xclang") & (c("prev2") == "-include-pch") & (c("prev3") == "-Xclang"))
    value = F.coalesce(c("prev").isin(*PAIRED), F.lit(False))
    theirs = F.lit(False)
    for driver, begins in DRIVER_PREFIXES.items():
        theirs = theirs | (c("driver").rlike(driver) & c("arg").rlike(begins))
    flags = c("arg").isin(*DISCARDED, *CODEGEN) | c("arg").rlike(CODEGEN_PATTERN) | c("arg").rlike("^(" + "|".join(DISCARDED_PREFIXES) + ")") | theirs
    drop = F.coalesce(pch, F.lit(False)) | (flags & ~value) | (value & c("prev").isin(*DISCARDED)) | (absolute(c("arg"), c("directory")) == c("file"))
    drop = drop & (c("pos") > 0)
    joined = F.lit(None).cast("string")
    flag = F.lit(None).cast("string")
    for f in USER:
        flag = F.coalesce(flag, F.when(c("arg").startswith(f), F.lit(f)))
        joined = F.coalesce(joined, F.when(c("arg").startswith(f) & (c("arg") != f), F.substring(c("arg"), len(f) + 1, 1 << 20)))
    kept = flat.withColumns({"user": F.when(value, c("prev")).otherwise(flag), "rest": F.when(value, c("arg")).otherwise(joined)}).filter(~drop)
    alone = c("arg").isin(*USER) & ~value
    text = F.when(c("user").isin(*DIRS) & c("rest").isNotNull(), F.concat("user", absolute(c("rest"), c("directory")))).when(c("user").isNotNull() & c("rest").isNotNull(), F.concat("user", "rest")).otherwise(c("arg"))
    ordered = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", text.alias("t"))))), lambda x: x["t"])
    parts = kept.filter(~alone).groupBy("entry_", "file", "directory").agg(ordered(c("user").isNull()).alias("canonical"), ordered(c("user").isNotNull()).alias("patch"))
    empty = F.array().cast("array<string>")
    return rows.join(parts.select("entry_", "canonical", "patch").dropDuplicates(["entry_"]), "entry_", "left").drop("entry_").withColumns({"canonical": F.coalesce("canonical", empty), "patch": F.coalesce("patch", empty)})


def unique_configs(entries: DataFrame) -> DataFrame:
    """One row per (directory, canonical, patch): number of files, and the least as example."""
    return entries.groupBy("directory", "canonical", "patch").agg(F.countDistinct("file").alias("files"), F.min("file").alias("example"))


def config_dedup_stats(entries: DataFrame) -> DataFrame:
    """One row: entries, contexts, their ratio, canonicals."""
    return entries.agg(F.count("*").alias("entries"), F.countDistinct("directory", "canonical", "patch").alias("contexts"), F.countDistinct("canonical").alias("canonicals")).withColumn("ratio", F.col("contexts") / F.nullif(F.col("entries"), F.lit(0)))


def top_canonicals(entries: DataFrame, n: int = 5) -> DataFrame:
    return entries.groupBy(F.concat_ws(" ", "canonical").alias("canonical")).count().orderBy(F.desc("count"), "canonical").limit(n)


def command_hash(args: Column, directory: Column) -> Column:
    return F.md5(F.concat_ws("\0", F.array_join(args, "\0"), directory))


def command_hash_snapshot(entries: DataFrame) -> DataFrame:
    """file -> sorted multiset of its entries' hashes (entries: file, hash)."""
    return entries.groupBy("file").agg(F.sort_array(F.collect_list("hash")).alias("hashes"))


def cdb_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change): added, removed or changed between two snapshots (file, hashes)."""
    both = before.select("file", F.col("hashes").alias("old")).join(after.select("file", F.col("hashes").alias("new")), "file", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select("file", change.alias("change")).filter("change is not null")


def match_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path) x rules (rule_ord, pattern, append, remove) -> path, rules in order. The
    rules are a configuration file's, a few rows, and every file is tried on each."""
    patterns = rules.filter("pattern is not null and pattern <> ''").withColumn("regex", glob_regex(F.col("pattern")))
    hits = files.join(few(patterns), F.expr("path rlike regex"))
    return hits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "append", "remove"))).alias("rules"))


def appended(rules: Column) -> Column:
    """What matched rules append, after later rules' removals of the same text."""
    step = lambda acc, r: F.concat(F.filter(acc, lambda a: ~a.eqNullSafe(r["remove"])), F.when(r["append"].isNull(), F.array().cast("array<string>")).otherwise(F.array(r["append"])))
    return F.aggregate(rules, F.array().cast("array<string>"), step)


def removed(rules: Column) -> Column:
    return F.filter(F.transform(rules, lambda r: r["remove"]), lambda x: x.isNotNull())


def rules_hash(matched: Column) -> Column:
    """Of the matched rules in order; '' for none."""
    return F.when(F.coalesce(F.size(matched), F.lit(0)) <= 0, "").otherwise(F.md5(F.array_join(F.transform(matched, lambda r: F.concat_ws("\0", r["append"], r["remove"])), "\1")))


def effective_command(files: DataFrame, entries: DataFrame, matched: DataFrame) -> DataFrame:
    """(path, args): each entry's arguments without what rules remove (`flag*` removes every
    value) and with what they append; files without an entry get a default by their suffix."""
    base = files.select("path").distinct().join(entries.select(F.col("file").alias("path"), "args"), "path", "left").join(matched, "path", "left")
    plus = F.array(F.lit("clang++"), F.lit("-std=c++20"))
    default = F.when(suffix(F.col("path")).isin(".cpp", ".hpp", ".cc"), plus).otherwise(F.array(F.lit("clang")))
    gone = F.coalesce(removed(F.col("rules")), F.array().cast("array<string>"))
    hit = lambda a: F.exists(gone, lambda r: (a == r) | (r.endswith("*") & F.startswith(a, F.regexp_replace(r, r"\*$", ""))))
    kept = F.filter(F.coalesce("args", default), lambda a: ~hit(a))
    return base.select("path", F.concat(kept, F.coalesce(appended(F.col("rules")), F.array().cast("array<string>"))).alias("args"))


def search_dirs(configs: DataFrame) -> DataFrame:
    """configs (config_id, args; a row for each) -> (config_id, idx, grp, dir): quoted, angled,
    system and after directories in that order; -iprefix holds for later -iwithprefixbefore; from
    the angled group on a directory's first place counts. A list is read where it lies."""
    groups = (("quoted", "-iquote"), ("angled", "-I"), ("system", "-isystem"), ("after", "-idirafter"))
    every = F.sequence(F.lit(0), F.size("args") - 1)
    at = lambda i: F.get("args", i)
    own = configs.filter("size(args) > 0").select("config_id", "args", F.filter(every, lambda i: at(i - 1) == "-iprefix").alias("prefixes"))

    def found(g: int, i: Column) -> Column:
        grp, flag = groups[g]
        arg, prev = at(i), at(i - 1)
        glued = F.when(arg.startswith(flag) & (arg != flag), F.substring(arg, len(flag) + 1, 1 << 20))
        d = F.when(prev == flag, arg).otherwise(F.when(~F.coalesce(prev.isin("-iquote", "-I", "-isystem", "-idirafter", "-iprefix"), F.lit(False)), glued))
        if grp == "angled":
            prefix = at(F.try_element_at(F.filter("prefixes", lambda j: j <= i), F.lit(-1)))
            d = F.coalesce(d, F.when(prev == "-iwithprefixbefore", F.concat(F.coalesce(prefix, F.lit("")), arg)))
        return F.struct(F.lit(grp).alias("grp"), d.alias("dir"))

    named = lambda g: F.filter(F.transform(every, lambda i: found(g, i)), lambda x: x["dir"].isNotNull())
    listed = own.select("config_id", named(0).alias("quoted"), F.concat(named(1), named(2), named(3)).alias("rest"))
    first = F.filter("rest", lambda x, k: F.array_position(F.col("rest.dir"), x["dir"]) == k + 1)
    rows = listed.select("config_id", F.posexplode(F.concat("quoted", first)).alias("idx", "x"))
    return rows.select("config_id", F.col("idx").cast("long").alias("idx"), "x.grp", "x.dir")


def has_entry(files: DataFrame, entries: DataFrame) -> DataFrame:
    known = entries.select(F.col("file").alias("path"), F.lit(True).alias("known")).distinct()
    return files.join(known, "path", "left").select("path", F.coalesce("known", F.lit(False)).alias("has_entry"))


def lookup(files: DataFrame, entries: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("file")).join(entries, "file")


def resolve_command(files: DataFrame, chosen: DataFrame, entries: DataFrame, ranked: DataFrame) -> DataFrame:
    """(path, tier, host): a chosen host, else the file's own entry, else its best ranked host
    that has an entry, else the fallback. chosen: path, host; ranked: header, host, rank."""
    own = entries.select("file").distinct()
    c = chosen.join(own.withColumnRenamed("file", "host"), "host", "left_semi").groupBy("path").agg(F.min("host").alias("chosen"))
    e = own.select(F.col("file").alias("path"), F.col("file").alias("exact"))
    r = ranked.join(own.withColumnRenamed("file", "host"), "host", "left_semi").groupBy(F.col("header").alias("path")).agg(F.min_by("host", "rank").alias("ranked"))
    joined = files.select("path").distinct().join(c, "path", "left").join(e, "path", "left").join(r, "path", "left")
    tier = F.when(F.col("chosen").isNotNull(), "chosen").when(F.col("exact").isNotNull(), "exact").when(F.col("ranked").isNotNull(), "host").otherwise("fallback")
    return joined.select("path", tier.alias("tier"), F.coalesce("chosen", "exact", "ranked").alias("host"))


def reconcile_snapshot(old: DataFrame, new: DataFrame, headers: DataFrame) -> DataFrame:
    """(file, verdict): entries (file, hashes, rules) of two snapshots that were added, removed
    or changed by hashes or rules; headers (file, host, rules, new_rules, reaches) are changed
    if their rules differ, their host is gone or changed, or no longer reaches them."""
    a, b = (x.select("file", F.col("hashes").alias(f"h{i}"), F.col("rules").alias(f"r{i}")) for i, x in ((0, old), (1, new)))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(~F.col("h0").eqNullSafe(F.col("h1")) | ~F.col("r0").eqNullSafe(F.col("r1")), "changed")
    entries = a.join(b, "file", "full_outer").select("file", change.alias("verdict")).filter("verdict is not null")
    moved = entries.filter("verdict <> 'added'").select(F.col("file").alias("host"), F.lit(True).alias("moved"))
    live = new.select(F.col("file").alias("host"), F.lit(True).alias("live"))
    h = headers.join(moved, "host", "left").join(live, "host", "left")
    stale = ~F.col("rules").eqNullSafe(F.col("new_rules")) | F.col("moved").isNotNull() | F.col("live").isNull() | ~F.coalesce("reaches", F.lit(False))
    return entries.union(h.filter(stale).select("file", F.lit("changed").alias("verdict"))).distinct()


def owed_rows(recorded: DataFrame, entries: DataFrame, manifests: DataFrame, pending: DataFrame, disk: DataFrame) -> DataFrame:
    """(file): recorded files (file, hashes: none, as for what is indexed on its own) whose index
    was dropped and never built again: they have no entry, no manifest and are not queued, so that
    nothing else would queue them. Those that are gone from disk are owed nothing."""
    own = recorded.filter("file is not null and (hashes is null or size(hashes) = 0)").select("file").distinct()
    for other in (entries, manifests, pending):
        own = own.join(other.select("file").distinct(), "file", "left_anti")
    return own.join(disk.select("file").distinct(), "file", "left_semi")
