"""Source scans and include resolution. sources: file_id, content; directives: file_id, line,
directive."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions.columns import basename, dirname, without_dots
from symloom.operators.lexing import PIECE, comment_parts, pieces, pieces_of_lines, transitions, whole_comments
from symloom.operators.occurrences import lines_held, unpacked

INCLUDE = r'^[ \t]*#[ \t]*(include|include_next|import)[ \t]*([<"])([^>"]+)[>"]'
LINKED = r'(?:^[ \t]*#[ \t]*(?:include_next|include|import|embed)|__has_(?:include_next|include|embed)[ \t]*\()[ \t]*(?:<[^>]*>|"[^"]*")'
OPENING, CLOSING = r"^[ \t]*#[ \t]*if(n?def)?\b", r"^[ \t]*#[ \t]*endif\b"
MODULE = r"^[ \t]*(export[ \t]+)?module[ \t]+([\w.:]+)[ \t]*;"
#: Lines of a file that share a task where something is carried along it.
STRETCH = 4096
#: Tasks for each core that read source files, at most.
SOURCE_TASKS = 32
#: Folders over which written source files are dealt.
FOLDERS = 256


def write_sources(sources: DataFrame, folder: str) -> int:
    """Each content that isn't null as a file of its own below folder (a path or URI that all
    executors share), in one of FOLDERS; returns how many there are. A line feed follows each, as
    Spark doesn't read files without a byte. Tasks write their files in
    place by Arrow's file systems: a committer would move them one by one on the driver. A task
    that runs again writes the same files."""
    rows = sources.filter("content is not null").select("file_id", F.col("content").cast("string").alias("content")).repartition(FOLDERS, "file_id")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = f"{folder}/{TaskContext.get().partitionId():03d}"
        where = at[5:] if at.startswith("file:") else at
        fs, path = (LocalFileSystem(), "/" + where.lstrip("/")) if "://" not in where else FileSystem.from_uri(at)
        seen: dict = {}
        for part in parts:
            fs.create_dir(path, recursive=True)
            for file, text in zip(part.column("file_id").to_pylist(), part.column("content").to_pylist(), strict=True):
                n = seen[file] = seen.get(file, -1) + 1
                with fs.open_output_stream(f"{path}/{file}{f'-{n}' if n else ''}.txt", compression=None) as out:
                    out.write(text.encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int64())})

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, content (null if not UTF-8), hash of the bytes, size, modified. Of a folder all files
    below it are read. Many small files share a task."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    most = SOURCE_TASKS * spark.sparkContext.defaultParallelism
    raw = raw.coalesce(most) if raw.rdd.getNumPartitions() > most else raw
    return raw.select("path", F.expr("try_validate_utf8(cast(content as string))").alias("content"), F.xxhash64("content").alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def lines(sources: DataFrame) -> DataFrame:
    return sources.select("file_id", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def saturating_depth(steps: DataFrame, step: str, keys: list[str], order: str) -> DataFrame:
    """steps with depth, the running sum of +1 and -1 that never falls below 0, and before, the
    depth ahead of the row. order is a whole number, of its own for each row of a key.

    A key's rows are cut into stretches of order. Of a stretch only its sum and the lowest of its
    running sums go on, which is all that later stretches need to know of it, so that a key of any
    size is many tasks."""
    part = steps.withColumn("stretch_", F.floor(F.col(order) / STRETCH))
    upto = Window.partitionBy(*keys, "stretch_").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = part.withColumn("sum_", F.sum(step).over(upto)).withColumn("low_", F.min("sum_").over(upto))
    totals = own.groupBy(*keys, "stretch_").agg(F.sum(step).alias("total_"), F.min("sum_").alias("least_"))
    earlier = Window.partitionBy(*keys).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.withColumn("base_", F.coalesce(F.sum("total_").over(earlier), F.lit(0)))
    based = based.withColumn("floor_", F.least(F.lit(0), F.min(F.col("base_") + F.col("least_")).over(earlier))).drop("total_", "least_")
    both = own.join(based, [*keys, "stretch_"])
    ahead = F.least(F.col("floor_"), F.col("base_") + F.coalesce(F.lag("low_").over(Window.partitionBy(*keys, "stretch_").orderBy(order)), F.lit(0)))
    depth = F.col("base_") + F.col("sum_") - F.least(F.col("floor_"), F.col("base_") + F.col("low_"))
    before = F.col("base_") + F.col("sum_") - F.col(step) - F.least(F.col("floor_"), ahead)
    return both.withColumns({"depth": depth.cast("long"), "before": before.cast("long")}).drop("stretch_", "sum_", "low_", "base_", "floor_")


def counted_so_far(rows: DataFrame, what: Column, keys: list[str], order: str, to: str) -> DataFrame:
    """rows with `to`: how many of the same keys hold `what`, up to the row itself; cut as in
    saturating_depth."""
    part = rows.withColumns({"what_": what.cast("int"), "stretch_": F.floor(F.col(order) / STRETCH)})
    own = F.sum("what_").over(Window.partitionBy(*keys, "stretch_").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = part.groupBy(*keys, "stretch_").agg(F.sum("what_").alias("total_"))
    earlier = F.sum("total_").over(Window.partitionBy(*keys).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select(*keys, "stretch_", F.coalesce(earlier, F.lit(0)).alias("base_"))
    return part.withColumn("own_", own).join(base, [*keys, "stretch_"]).withColumn(to, F.col("base_") + F.col("own_")).drop("what_", "stretch_", "own_", "base_")


def line_table(sources: DataFrame) -> DataFrame:
    """(file_id, line, start, len): lines from 0, offsets in code points."""
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines(sources).select("file_id", "line", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long").alias("start"), F.length("text").cast("long").alias("len"))


def scan_includes(sources: DataFrame) -> DataFrame:
    """(file_id, line, name, angled, next, offset, depth) of each include directive; depth is
    the number of open conditionals there."""
    return includes_of_lines(lines(sources).join(line_table(sources).select("file_id", "line", "start"), ["file_id", "line"]))


def includes_of_lines(rows: DataFrame) -> DataFrame:
    """scan_includes of files that are rows already (file_id, line, start, text)."""
    step = F.when(F.col("text").rlike(OPENING), 1).when(F.col("text").rlike(CLOSING), -1).otherwise(0)
    deep = saturating_depth(rows.filter(F.col("text").rlike(r"^[ \t]*#")).withColumn("step", step), "step", ["file_id"], "line")
    part = lambda i: F.regexp_extract("text", INCLUDE, i)
    return deep.filter(F.col("text").rlike(INCLUDE)).select("file_id", "line", part(3).alias("name"), (part(2) == "<").alias("angled"), (part(1) == "include_next").alias("next"), F.col("start").alias("offset"), "depth")


def scan_modules(sources: DataFrame) -> DataFrame:
    """(file_id, name, interface, need_preprocess): the first module declaration; one within a
    conditional is not read, and needs the preprocessor."""
    return modules_of_lines(lines(sources))


def modules_of_lines(lines: DataFrame) -> DataFrame:
    """scan_modules of files that are rows already (file_id, line, text)."""
    step = F.when(F.col("text").rlike(OPENING), 1).when(F.col("text").rlike(CLOSING), -1).otherwise(0)
    rows = lines.withColumn("step", step).withColumn("named", F.col("text").rlike(MODULE)).filter("step <> 0 or named")
    deep = saturating_depth(rows, "step", ["file_id"], "line").filter("named")
    first = deep.groupBy("file_id").agg(F.min_by(F.struct("text", "depth"), "line").alias("x"))
    inside = F.col("x.depth") > 0
    return first.select("file_id", F.when(~inside, F.regexp_extract("x.text", MODULE, 2)).alias("name"), (~inside & (F.regexp_extract("x.text", MODULE, 1) != "")).alias("interface"), inside.alias("need_preprocess"))


def scan_comments(sources: DataFrame) -> DataFrame:
    """(file_id, begin, end, kind): each comment, line or block, with its range (end excluded).

    Strings, raw strings, character literals, header names and numbers with quotes hide what
    looks like a comment; a line comment goes on after a backslash at a line's end; a block
    comment that isn't closed ends with the file. A null content has none.

    A long file is cut into pieces of whole lines that are lexed apart. What a piece does to each
    state it may begin in is a small map, and a file's maps are folded in their order, so that
    each piece begins in the right one. Comments across pieces are put together at the end."""
    kind = dict(sources.dtypes)["file_id"]
    own = sources.select("file_id", F.col("content").cast("string").alias("content"))
    whole = own.mapInArrow(whole_comments, f"file_id {kind}, begin long, end long, kind string")
    # Looked at first: where no file is long, all are read once.
    long = own.filter(F.length("content") > PIECE)
    return whole.unionByName(comments_of_pieces(pieces(long))) if long.limit(1).count() else whole


def comments_of_lines(rows: DataFrame) -> DataFrame:
    """scan_comments of files that are rows already (file_id, line, start, text), of any length."""
    return comments_of_pieces(pieces_of_lines(rows))


def comments_of_pieces(parts: DataFrame) -> DataFrame:
    """scan_comments of pieces of files (file_id, piece, n_pieces, start, text)."""
    kind = dict(parts.dtypes)["file_id"]
    many = parts.filter("n_pieces > 1")
    maps = many.mapInArrow(transitions, f"file_id {kind}, piece int, n_pieces int, ends map<string,string>")
    step = lambda acc, x: F.struct(F.coalesce(F.try_element_at(x["ends"], acc["state"]), acc["state"]).alias("state"), F.concat(acc["begins"], F.array(acc["state"])).alias("begins"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", F.map_entries("ends").alias("e"))))  # a map for each piece of a file
    folded = F.aggregate(F.transform(ordered, lambda x: F.struct(F.map_from_entries(x["e"]).alias("ends"))), F.struct(F.lit("").alias("state"), F.array().cast("array<string>").alias("begins")), step)
    begins = maps.groupBy("file_id").agg(folded["begins"].alias("b")).select("file_id", F.posexplode("b").alias("piece", "state"))
    columns = f"file_id {kind}, begin long, end long, kind string"
    single = parts.filter("n_pieces = 1").withColumn("state", F.lit("")).mapInArrow(comment_parts, columns)
    found = many.join(begins, ["file_id", "piece"]).mapInArrow(comment_parts, columns)
    whole = found.filter("begin is not null and end is not null")
    # Of those cut, the beginning and the end are rows; a file has a few for each piece.
    place = F.coalesce("begin", "end")
    ends = F.lead("end").over(Window.partitionBy("file_id").orderBy(place))
    cut = found.filter("begin is null or end is null").withColumn("end", ends).filter("begin is not null")
    return single.unionByName(whole).unionByName(cut.select("file_id", "begin", "end", "kind"))


def comment_share(sources: DataFrame, comments: DataFrame) -> DataFrame:
    """(file_id, comments, comment_chars, chars, share): what comments (of scan_comments) take of
    each file; share in thousandths, null for an empty file."""
    return shares(sources.select("file_id", F.length("content").cast("long").alias("chars")), comments)


def shares(sizes: DataFrame, comments: DataFrame) -> DataFrame:
    """comment_share of files of these sizes (file_id, chars)."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sums = comments.groupBy("file_id").agg(F.count("*").alias("comments"), F.sum(F.col("end") - F.col("begin")).alias("comment_chars"))
    rows = sizes.select("file_id", "chars").join(sums, "file_id", "left").select("file_id", zero("comments"), zero("comment_chars"), "chars")
    return rows.withColumn("share", F.floor(F.try_divide(1000 * F.col("comment_chars"), F.col("chars"))).cast("long"))


def to_position(offsets: DataFrame, table: DataFrame) -> DataFrame:
    """offsets (file_id, offset) with line and column, null beyond the file. One sort of lines
    and offsets together: each offset takes the last line that starts at or before it."""
    starts = table.select("file_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("line", "start", "len").alias("own"))
    asked = offsets.select("file_id", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["own"].dataType).alias("own"))
    w = Window.partitionBy("file_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = starts.union(asked).select("file_id", "at", "kind", F.last("own", ignorenulls=True).over(w).alias("own")).filter("kind = 1").select("file_id", "at", "own.*")
    inside = F.col("at") <= F.col("start") + F.col("len")
    return rows.select("file_id", F.col("at").alias("offset"), F.when(inside, F.col("line")).alias("line"), F.when(inside, F.col("at") - F.col("start")).alias("column"))


def to_offset(positions: DataFrame, table: DataFrame, clamp: bool = False) -> DataFrame:
    """positions (file_id, line, column) with offset: null past the line's end, or its end."""
    joined = positions.join(table, ["file_id", "line"], "left")
    at = F.col("start") + (F.least("column", "len") if clamp else F.col("column"))
    return joined.select("file_id", "line", "column", (at if clamp else F.when(F.col("column") <= F.col("len"), at)).alias("offset"))


def line_context(offsets: DataFrame, sources: DataFrame) -> DataFrame:
    """offsets (file_id, offset; more columns follow) with line and the text of that line, null
    beyond the file or without one.

    Offsets and texts are dealt out once, by file. A text comes before its offsets, and a line goes
    on as one row with a list of what was asked of it, so that its text is copied last.
    Offsets that lie by file may come as lists (all columns but file_id): they travel as these, and
    equal ones of a file are taken once."""
    kept = [c for c in offsets.columns if c != "file_id"]
    types = dict(offsets.dtypes)
    lists = types["offset"].startswith("array<")
    own = offsets.select("file_id", *kept) if lists else offsets.select("file_id", F.struct(*kept).alias("row"))
    kind = f"struct<{', '.join(f'`{c}`: {types[c][6:-1]}' for c in kept)}>" if lists else own.schema["row"].dataType.simpleString()
    asked = own.select("file_id", F.lit(True).alias("asked"), F.lit(None).cast("string").alias("content"), *own.columns[1:])
    none = [F.lit(None).cast(f.dataType) for f in own.schema.fields[1:]]
    texts = sources.select(F.col("file_id").cast(types["file_id"]).alias("file_id"), F.lit(False), F.col("content").cast("string"), *none)
    dealt = texts.toDF(*asked.columns).union(asked).repartition("file_id").sortWithinPartitions("file_id", "asked")
    held = dealt.mapInArrow((lambda parts: lines_held(unpacked(parts, once=True))) if lists else lines_held, f"file_id {types['file_id']}, line long, text string, rows array<{kind}>")
    return held.select("file_id", F.explode("rows").alias("row"), "line", "text").select("file_id", *[F.col("row")[c].alias(c) for c in kept], "line", "text")


def document_links(resolved: DataFrame) -> DataFrame:
    """(file, kind, begin, end, target): of source_links with the path that resolve_includes
    found for each, those that have one."""
    return resolved.filter("path is not null").select(F.col("src").alias("file"), "kind", "begin", "end", F.col("path").alias("target"))


def source_links(sources: DataFrame) -> DataFrame:
    """(src, ord, kind, name, angled, next, begin, end) of what a file's directives name: kind is
    include, embed, has_include or has_embed; the range is that of the argument with its marks.
    A line may test several names. sources: file_id, content."""
    table = line_table(sources).select("file_id", "line", "start")
    own = lines(sources).filter(F.col("text").rlike(LINKED))
    # What lies between the matches of a line gives their places.
    found, between = F.regexp_extract_all("text", F.lit(LINKED), F.lit(0)), F.split("text", LINKED, -1)
    each = own.join(table, ["file_id", "line"]).withColumns({"found": found, "between": between}).select("file_id", "line", "start", "found", "between", F.posexplode("found").alias("k", "match"))
    ahead = F.length(F.array_join(F.slice("between", F.lit(1), F.col("k") + 1), "")) + F.length(F.array_join(F.slice("found", F.lit(1), F.col("k")), ""))
    arg = F.regexp_extract("match", r"[<\"][^>\"]*[>\"]$", 0)
    word = F.regexp_extract("match", r"(__has_)?(include_next|include|import|embed)", 2)
    kind = F.concat(F.when(F.col("match").contains("__has_"), "has_").otherwise(""), F.when(word == "embed", "embed").otherwise("include"))
    end = (F.col("start") + ahead + F.length("match")).cast("long")
    return each.select(F.col("file_id").alias("src"), (F.col("line") * 1000 + F.col("k")).alias("ord"), kind.alias("kind"), F.regexp_extract(arg, r"^.(.*).$", 1).alias("name"), arg.startswith("<").alias("angled"), (word == "include_next").alias("next"), (end - F.length(arg)).alias("begin"), end.alias("end"))


def conditional_groups(directives: DataFrame) -> DataFrame:
    """if, elif, else and endif rows with depth (of their conditional, from 1) and group (the
    number of `if`s of that depth so far); stray closings are dropped."""
    own = directives.filter(F.col("directive").isin("if", "elif", "else", "endif"))
    step = F.when(F.col("directive") == "if", 1).when(F.col("directive") == "endif", -1).otherwise(0)
    deep = saturating_depth(own.withColumn("step", step), "step", ["file_id"], "line")
    rows = deep.withColumn("depth", F.when(F.col("directive") == "if", F.col("depth")).otherwise(F.col("before"))).filter("depth > 0")
    return counted_so_far(rows, F.col("directive") == "if", ["file_id", "depth"], "line", "grp").drop("step", "before")


def inactive_regions(conditions: DataFrame, ends: DataFrame) -> DataFrame:
    """conditions (file_id, line, directive, taken) -> (file_id, start, end): from the line after
    a branch that isn't taken to the next branch of the same conditional. An else is inactive
    if an earlier branch was taken. Regions still open end with the file (ends: file_id, last)."""
    rows = conditional_groups(conditions)
    w = Window.partitionBy("file_id", "depth", "grp").orderBy("line")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.bool_or(F.coalesce("taken", F.lit(False))).over(before), F.lit(False))
    active = F.when(F.col("directive") == "else", ~earlier).otherwise(F.coalesce("taken", F.lit(False)))
    marked = rows.withColumns({"active": active, "next": F.lead("line").over(w)}).filter("directive <> 'endif' and not active")
    return marked.join(ends, "file_id").select("file_id", (F.col("line") + 1).alias("start"), F.coalesce(F.col("next"), F.col("last") + 1).alias("end")).filter("start < end")


def pragma_regions(pragmas: DataFrame) -> DataFrame:
    """pragmas (file_id, line, directive: region or endregion) -> (file_id, start, end), paired
    by nesting; pairs on one line are dropped, as are those that never end."""
    step = F.when(F.col("directive") == "region", 1).otherwise(-1)
    deep = saturating_depth(pragmas.withColumn("step", step), "step", ["file_id"], "line")
    region = F.col("directive") == "region"
    rows = deep.withColumn("level", F.when(region, F.col("depth")).otherwise(F.col("before"))).filter("level > 0")
    # A level's regions don't overlap, so the n-th to begin is the n-th to end.
    pairs = counted_so_far(rows, region, ["file_id", "level"], "line", "nth").groupBy("file_id", "level", "nth").agg(F.max(F.when(region, F.col("line"))).alias("start"), F.min(F.when(~region, F.col("line"))).alias("end"))
    return pairs.filter("start < end").select("file_id", "start", "end")


def condition_folds(conditions: DataFrame) -> DataFrame:
    """(file_id, start, end): from each branch of a conditional to its else, if it has one."""
    rows = conditional_groups(conditions)
    w = Window.partitionBy("file_id", "depth", "grp").orderBy("line")
    return rows.withColumns({"end": F.lead("line").over(w), "kind": F.lead("directive").over(w)}).filter("kind = 'else' and directive in ('if', 'elif')").select("file_id", F.col("line").alias("start"), "end")


def dir_listing(paths: DataFrame) -> DataFrame:
    """(dir, entry): every file and directory under its parent, ancestors included."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    pieces = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i"))
    parent = F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), "/"))
    return pieces.select(parent.alias("dir"), F.element_at("p", F.col("i")).alias("entry")).distinct()


def resolve_includes(includes: DataFrame, search: DataFrame, listing: DataFrame, own_dirs: DataFrame) -> DataFrame:
    """includes (src, config_id, ord, name, angled) with idx and path of the first hit, null if
    there is none. Quoted names look in the includer's directory (own_dirs: src, dir) first, as
    idx -1; angled ones begin at the first directory that isn't quoted. An absolute name is
    itself. search: config_id, idx, grp, dir; listing: dir, entry.

    Two more columns of includes may be given: next (boolean) and found_idx, the idx at which src
    was found itself. A next include begins after that, wherever src lies. The first directory of
    a nested name must be one (it may be left again by `..`)."""
    columns = includes.columns
    for name, none in (("next", F.lit(False)), ("found_idx", F.lit(None).cast("long"))):
        if name not in columns:
            includes = includes.withColumn(name, none)
    key = ["src", "config_id", "ord"]
    asked = includes.select(*key, "name", F.coalesce("angled", F.lit(False)).alias("angled"), F.coalesce("next", F.lit(False)).alias("next"), "found_idx")
    spots = listing.select(F.col("dir").alias("spot"), F.col("entry").alias("base"))

    def there(candidates: DataFrame) -> DataFrame:
        """Those of candidates (dir, name) that the listing has, with their path."""
        whole = candidates.withColumn("path", without_dots(F.concat("dir", F.lit("/"), "name")))
        head = F.regexp_extract("name", r"^([^/]*)/", 1)
        nested = (head != "") & ~head.isin(".", "..")
        made = whole.withColumns({"spot": F.when(F.col("path").rlike("^/[^/]*$"), "/").otherwise(dirname(F.col("path"))), "base": basename(F.col("path")), "head": head, "nested": nested})
        found = made.join(spots, ["spot", "base"], "left_semi")
        first = spots.select(F.col("spot").alias("dir"), F.col("base").alias("head"))
        return found.filter("not nested").unionByName(found.filter("nested").join(first, ["dir", "head"], "left_semi")).drop("spot", "base", "head", "nested")

    relative = F.col("name").isNotNull() & ~F.col("name").startswith("/")
    start = search.filter("grp <> 'quoted'").groupBy("config_id").agg(F.min("idx").alias("start"))
    # The few search directories are spelled out for each distinct name of a configuration.
    wanted = asked.filter(relative).select("config_id", "name").distinct()
    hits = there(wanted.join(search.select("config_id", "idx", "dir"), "config_id")).select("config_id", "name", "idx", "path")
    reach = F.when(F.col("next"), F.coalesce("found_idx", F.lit(0)) + 1).when(F.col("angled"), F.col("start")).otherwise(0)
    best = F.min(F.struct("idx", "path")).alias("hit")
    from_search = asked.join(hits, ["config_id", "name"]).join(start, "config_id", "left").filter(F.col("idx") >= reach).groupBy(*key).agg(best)
    own = there(asked.filter(relative & ~F.col("angled") & ~F.col("next")).join(own_dirs.distinct(), "src")).select(*key, F.struct(F.lit(-1).cast("long").alias("idx"), "path").alias("hit"))
    whole = asked.filter(F.col("name").startswith("/")).withColumns({"path": without_dots(F.col("name"))})
    whole = whole.withColumns({"spot": F.when(F.col("path").rlike("^/[^/]*$"), "/").otherwise(dirname(F.col("path"))), "base": basename(F.col("path"))}).join(spots, ["spot", "base"], "left_semi").select(*key, F.struct(F.lit(None).cast("long").alias("idx"), "path").alias("hit"))
    best = from_search.union(own).union(whole).groupBy(*key).agg(F.min("hit").alias("hit"))
    return includes.join(best, key, "left").select(*columns, "hit.idx", "hit.path")


def unresolved_includes(resolved: DataFrame) -> DataFrame:
    return resolved.filter("path is null").drop("idx", "path")


def count_occurrences(resolved: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, target) with n: includes of src that resolve to target; else those with its
    file name, if they have one spelling; else 0."""
    exact = resolved.filter("path is not null").groupBy("src", F.col("path").alias("target")).agg(F.count("*").alias("exact"))
    base = F.element_at(F.split("name", "/"), -1)
    named = resolved.groupBy("src", base.alias("base")).agg(F.count("*").alias("named"), F.countDistinct("name").alias("spellings"))
    joined = pairs.withColumn("base", F.element_at(F.split("target", "/"), -1)).join(exact, ["src", "target"], "left").join(named, ["src", "base"], "left")
    return joined.select("src", "target", F.when(F.col("exact") > 0, F.col("exact")).when(F.col("spellings") == 1, F.col("named")).otherwise(0).alias("n"))


def pick_include(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """candidates (src, ord, conditional, ...); choices (src, occurrence): the chosen one by
    order of appearance (none if out of range), else the first unconditional one, else the
    first."""
    by_ord = F.row_number().over(Window.partitionBy("src").orderBy("ord")) - 1
    by_use = F.row_number().over(Window.partitionBy("src").orderBy("conditional", "ord")) - 1
    rows = candidates.withColumns({"nth": by_ord, "pref": by_use}).join(choices.select("src", "occurrence"), "src", "left")
    return rows.filter("(occurrence is null and pref = 0) or nth = occurrence").select(*candidates.columns)
