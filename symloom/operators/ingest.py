"""Building and merging the index.

Rows: occurrences(file_id, begin, end, symbol_id), relations(file_id, symbol_id, kind, begin,
end, target_symbol), each with a tu or a variant; contributions(tu, path, rows_hash)."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.functions.bounded import FEW
from symloom.functions.columns import key64
from symloom.functions.lineage import cut, delete
from symloom.functions.ranks import numbered

#: A relation and the one that mirrors it on the other symbol. A type's constructors
#: and destructors are told by the type; the type of anything else has no mirror.
MIRRORS = {"Callee": "Caller", "Base": "Derived", "Interface": "Implementation", "Constructor": "TypeDefinition", "Destructor": "TypeDefinition"}


def canonical_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of a file in a unit once."""
    return rows.dropDuplicates(keys)


def mirror_relations(facts: DataFrame, mirrors: dict[str, str] = MIRRORS) -> DataFrame:
    """facts (file_id, symbol_id, kind, begin, end, target_symbol) with their mirror rows.
    Of rows without a mirror or a target there is only the row itself."""
    pairs = F.create_map(*[F.lit(x) for kv in mirrors.items() for x in kv])
    own = F.struct("symbol_id", "kind", "target_symbol")
    other = F.struct(F.col("target_symbol").alias("symbol_id"), F.try_element_at(pairs, F.col("kind")).alias("kind"), F.col("symbol_id").alias("target_symbol"))
    rows = facts.select("file_id", "begin", "end", F.explode(F.array(own, other)).alias("r")).filter("r.kind is not null and r.symbol_id is not null")
    return rows.select("file_id", "r.symbol_id", "r.kind", "begin", "end", "r.target_symbol")


def classify_scope(linkage: Column) -> Column:
    return F.when(linkage == "none", "FileLocal").when(linkage.isin("internal", "module"), "TULocal").otherwise("External")


def reference_files(relations: DataFrame) -> DataFrame:
    """(symbol_id, file_id): the files in which a symbol has relations."""
    return relations.select("symbol_id", "file_id").distinct()


def module_rows(uses: DataFrame) -> DataFrame:
    """uses (file_id, name, interface) as relation rows of module symbols."""
    return uses.select("file_id", key64(F.concat(F.lit("@module@"), "name")).alias("symbol_id"), "name", F.when(F.col("interface"), "Definition").otherwise("Reference").alias("kind"))


def rows_hash(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, hash): identity of a group's set of rows, whatever their order. Sums of row hashes
    are partial aggregates, so a large file needs no sort and no list."""
    low, high = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    half = lambda h: F.sum(h.cast("decimal(20,0)"))
    out = rows.select(*by, *columns).distinct().groupBy(*by).agg(F.count("*").alias("n"), half(low).alias("a"), half(high).alias("b"))
    return out.select(*by, F.sha1(F.concat_ws(",", "n", "a", "b")).alias("hash"))


def merge_variants(old: DataFrame, keep: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (columns, variant): old ones whose (file_id, variant) is kept, and fresh ones, as
    columns with the sorted array of their variants. The order of fresh rows doesn't matter. What is
    kept is written, so that where it is short Spark sees that and doesn't move the old rows."""
    live = cut(keep.select("file_id", "variant").distinct())
    kept = old.join(live, ["file_id", "variant"], "left_semi").select(*columns, "variant")
    return kept.union(fresh.select(*columns, "variant")).groupBy(*columns).agg(F.sort_array(F.collect_set("variant")).alias("variants"))


#: Variants of a mask.
WORD = 64


def number_variants(known: DataFrame, seen: DataFrame) -> DataFrame:
    """known (file_id, variant, number) with the variants of seen (file_id, variant), which get
    each file's next numbers from 0, in order of variant. Numbers are given once and kept, so
    that masks stay right. They are written, as every mask needs them, and where they are few
    Spark sees that by their size and doesn't move the rows that meet them."""
    new = seen.select("file_id", "variant").distinct().join(known, ["file_id", "variant"], "left_anti")
    top = known.groupBy("file_id").agg((F.max("number") + 1).alias("top"))
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("variant")) - 1
    fresh = new.withColumn("nth", nth).join(top, "file_id", "left").select("file_id", "variant", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("long").alias("number"))
    return cut(known.select("file_id", "variant", F.col("number").cast("long").alias("number")).union(fresh))


def single_bits(rows: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    """rows (columns with file_id, variant) as (columns, word, mask), each with the bit of its
    variant alone."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % WORD).cast("int"))
    return rows.join(numbers, ["file_id", "variant"]).select(*columns, F.floor(F.col("number") / WORD).alias("word"), mask.alias("mask"))


def bits(rows: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    """rows (columns with file_id, variant) as (columns, word, mask): a row for every 64 variants
    by number, in which each has a bit."""
    return single_bits(rows, numbers, columns).groupBy(*columns, "word").agg(F.bit_or("mask").alias("mask"))


def live_masks(live: DataFrame, numbers: DataFrame) -> DataFrame:
    """(file_id, word, mask) of live variants (file_id, variant)."""
    return bits(live, numbers, ["file_id"])


def merge_masks(old: DataFrame, keep: DataFrame, fresh: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    """merge_variants in bits: old rows (columns, word, mask) lose the bits that keep (file_id,
    word, mask) lacks, fresh ones (columns, variant) are added by their numbers, and equal rows
    are one, with their masks OR-ed. Rows without a bit vanish. Masks are added up before they
    are shuffled, fresh ones once with the old, and nothing is gathered."""
    kept = old.join(keep.select("file_id", "word", F.col("mask").alias("kept")), ["file_id", "word"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("kept"))).filter("mask <> 0")
    both = kept.select(*columns, "word", "mask").unionByName(single_bits(fresh, numbers, columns))
    return both.groupBy(*columns, "word").agg(F.bit_or("mask").alias("mask"))


def live_masked(rows: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """The rows (columns) of which some word shares a bit with the live one (file_id, word,
    mask), once each."""
    own = rows.join(live.select("file_id", "word", F.col("mask").alias("live")), ["file_id", "word"]).filter(F.col("mask").bitwiseAND(F.col("live")) != 0)
    return own.select(*columns).distinct()


def new_sets(rows: DataFrame, stored: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ingests only row sets that aren't stored. rows: tu, path, columns; stored: path, hash.

    Returns contributions (tu, path, hash) and fresh rows (path, hash, columns): of each set that
    is new, those of its first unit. The identity of a set is added up where its rows lie
    (rows_hash), so what travels is a sum for each task and (tu, path); of the rows themselves
    only those of new sets do, and none where all are stored."""
    contributions = cut(rows_hash(rows, ["tu", "path"], columns))
    new = contributions.join(stored.select("path", "hash").distinct(), ["path", "hash"], "left_anti").groupBy("path", "hash").agg(F.min("tu").alias("tu"))
    new = cut(new)
    # Counted first: where few sets are new their list goes to the rows, which then don't move.
    some = new.limit(FEW + 1).count()
    if some == 0:
        rows = rows.limit(0)
    return contributions, rows.join(F.broadcast(new) if some <= FEW else new, ["tu", "path"]).select("path", "hash", *columns).distinct()


def local_names(names: DataFrame, references: DataFrame) -> DataFrame:
    """names (symbol_id, tu, name, scope) of symbols that aren't External and that a file refers
    to: (file_id, symbol_id, name), the first unit's name."""
    own = names.filter("scope <> 'External'").groupBy("symbol_id").agg(F.min_by("name", "tu").alias("name"))
    return references.select("file_id", "symbol_id").distinct().join(own, "symbol_id").select("file_id", "symbol_id", "name")


def merge_symbols(symbols: DataFrame, files: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """symbols (tu, symbol_id, name, kind, scope, file_id) -> one row per External symbol: name
    and kind of the first unit, and the number of its files (`symbol_files` has them). A unit
    with a file that doesn't exist is rejected as a whole. used: (tu, file_id) of all symbols,
    where that can be had for less than symbols."""
    good = accepted(symbols, files, used)
    per = good.groupBy("symbol_id", "file_id").agg(F.min(F.struct("tu", "name", "kind")).alias("first"))
    return per.groupBy("symbol_id").agg(F.min("first").alias("first"), F.count("*").alias("files")).select("symbol_id", "first.name", "first.kind", "files")


def symbol_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol_id, file_id): the union of the files of each External symbol over the units that
    merge_symbols accepts, a row for each."""
    return accepted(symbols, files).select("symbol_id", "file_id").distinct()


def accepted(symbols: DataFrame, files: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """The External symbols of units all of whose files exist. The others' list is written, so that
    where it is short Spark sees that and doesn't move the symbols."""
    used = (symbols if used is None else used).select("tu", "file_id").distinct()
    bad = cut(used.join(files.select("file_id").distinct(), "file_id", "left_anti").select("tu").distinct())
    return symbols.filter("scope = 'External'").join(bad, "tu", "left_anti")


def intern_file_versions(known: DataFrame, seen: DataFrame) -> DataFrame:
    """known (fv_id, file_id, content_hash) with new pairs of seen (file_id, content_hash), which
    get the next ids in order of path and hash. Their numbers come from counts of ranges of the
    keys, so no task sees all of them."""
    new = seen.select("file_id", "content_hash").distinct().join(known, ["file_id", "content_hash"], "left_anti")
    top = known.agg(F.coalesce(F.max("fv_id"), F.lit(0)).alias("top"))
    fresh = numbered(new, ["file_id", "content_hash"], "n").crossJoin(F.broadcast(top))  # one row
    return known.select("fv_id", "file_id", "content_hash").union(fresh.select((F.col("top") + F.col("n")).cast("long").alias("fv_id"), "file_id", "content_hash"))


def apply_manifest(contributions: DataFrame, fresh: DataFrame) -> DataFrame:
    """contributions with those of fresh's units replaced."""
    return contributions.join(fresh.select("tu").distinct(), "tu", "left_anti").select("tu", "path", "rows_hash").union(fresh.select("tu", "path", "rows_hash"))


def affected_files(contributions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Paths to which the replaced units contributed or now contribute."""
    old = contributions.join(fresh.select("tu").distinct(), "tu", "left_semi").select("path")
    return old.union(fresh.select("path")).distinct()


def remove_manifest(contributions: DataFrame, units: DataFrame) -> DataFrame:
    return contributions.join(units.select("tu").distinct(), "tu", "left_anti")


def live_variants(contributions: DataFrame) -> DataFrame:
    """(path, variant): the distinct contributed row sets of each file."""
    return contributions.select("path", F.col("rows_hash").alias("variant")).distinct()


def live_rows(rows: DataFrame, live: DataFrame) -> DataFrame:
    """rows (path, variant, ...) of live variants."""
    return rows.join(live, ["path", "variant"], "left_semi")


def compact(stored: DataFrame, live: DataFrame) -> DataFrame:
    """stored (path, variant) -> (path, verdict): kept, rewritten if some variant is dead, or
    retired if all are."""
    marked = stored.distinct().join(live.withColumn("live", F.lit(True)), ["path", "variant"], "left")
    alive = F.count("live")
    return marked.groupBy("path").agg(F.when(alive == 0, "retired").when(alive < F.count("*"), "rewritten").otherwise("kept").alias("verdict"))


def owners_of(contributions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(tu, path): the units that contribute to the files of verdicts (path): those whose
    manifests are to be dropped and queued where compact retires a file or unservable_files
    names it."""
    return contributions.select("tu", "path").distinct().join(verdicts.select("path").distinct(), "path", "left_semi").select("tu", "path")


def merge_plan(sections: DataFrame, stored: DataFrame) -> DataFrame:
    """sections (tu, path, rows_hash, content_hash) with outcome: hit if the variant is stored,
    appended if the file is stored with this content, else rebuilt. stored: path, variant,
    content_hash."""
    hit = stored.select("path", F.col("variant").alias("rows_hash"), F.lit(True).alias("hit")).distinct()
    same = stored.select("path", "content_hash", F.lit(True).alias("same")).distinct()
    joined = sections.join(hit, ["path", "rows_hash"], "left").join(same, ["path", "content_hash"], "left")
    return joined.select("tu", "path", "rows_hash", F.when(F.col("hit"), "hit").when(F.col("same"), "appended").otherwise("rebuilt").alias("outcome"))


def reject_inconsistent(sections: DataFrame, graph: DataFrame) -> DataFrame:
    """Units with a section whose content hash differs from the include graph's (tu, path,
    graph_hash), both known."""
    both = sections.join(graph, ["tu", "path"]).filter("content_hash is not null and graph_hash is not null and content_hash <> graph_hash")
    return both.select("tu").distinct()


def requeue_after_rebuild(contributions: DataFrame, stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Units that still point at a variant that a rebuilt path no longer has."""
    own = contributions.join(rebuilt.select("path").distinct(), "path", "left_semi")
    return own.join(stored.select("path", F.col("variant").alias("rows_hash")), ["path", "rows_hash"], "left_anti").select("tu").distinct()


def gc_file_versions(versions: DataFrame, *references: DataFrame) -> DataFrame:
    """versions that any of the references (fv_id) holds."""
    used = references[0].select("fv_id")
    for r in references[1:]:
        used = used.union(r.select("fv_id"))
    return versions.join(used.distinct(), "fv_id", "left_semi")


def adopt_manifests(manifests: DataFrame, pins: DataFrame, known: DataFrame) -> DataFrame:
    """manifests (tu, generation, fv_id per row) and pins (tu, generation) -> (tu, verdict):
    adopted, dead (another generation or an unknown version) or missing (a pin without one)."""
    lost = manifests.join(known.select("fv_id").distinct(), "fv_id", "left_anti").select("tu").distinct().withColumn("lost", F.lit(True))
    own = manifests.select("tu", "generation").distinct().join(lost, "tu", "left")
    both = own.join(pins.select("tu", F.col("generation").alias("pin")), "tu", "full_outer")
    return both.select("tu", F.when(F.col("generation").isNull(), "missing").when(F.col("generation").eqNullSafe(F.col("pin")) & F.col("lost").isNull(), "adopted").otherwise("dead").alias("verdict"))


def unservable_files(contributions: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, reason): no shard, a conflict of its generations, or a contributed variant that
    it lacks. stored: path, variant, generation."""
    wanted = contributions.select("path", F.col("rows_hash").alias("variant")).distinct()
    gens = stored.groupBy("path").agg(F.countDistinct("generation").alias("gens"))
    have = stored.select("path", "variant", F.lit(True).alias("have")).distinct()
    per = wanted.join(have, ["path", "variant"], "left").groupBy("path").agg(F.bool_or(F.col("have").isNull()).alias("lacks")).join(gens, "path", "left")
    reason = F.when(F.col("gens").isNull(), "missing").when(F.col("gens") > 1, "conflict").when(F.col("lacks"), "variant")
    return per.select("path", reason.alias("reason")).filter("reason is not null")


def orphan_shards(stored: DataFrame, contributions: DataFrame) -> DataFrame:
    return stored.select("path").distinct().join(contributions.select("path"), "path", "left_anti")


def index_stats(occurrences: DataFrame, relations: DataFrame, contributions: DataFrame) -> DataFrame:
    """(metric, value) over the whole index."""
    a = occurrences.agg(F.count("*").alias("occurrences"), F.countDistinct("symbol_id").alias("symbols"), F.countDistinct("file_id").alias("files"))
    b = relations.agg(F.count("*").alias("relations"))
    c = contributions.agg(F.countDistinct("tu").alias("units"), F.countDistinct("path", "rows_hash").alias("variants"))
    return a.crossJoin(b).crossJoin(c).unpivot([], ["occurrences", "symbols", "files", "relations", "units", "variants"], "metric", "value")


def storage_stats(stored: DataFrame, versions: DataFrame) -> DataFrame:
    """(metric, value): shards and bytes of stored (path, bytes), the largest and the mean shard
    (floor), and the versions (file_id, content_hash) with the files that have several."""
    a = stored.groupBy("path").agg(F.sum("bytes").alias("bytes")).agg(F.count("*").alias("shards"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("bytes"), F.lit(0)).alias("largest"))
    a = a.withColumn("mean", F.coalesce(F.floor(F.col("bytes") / F.nullif("shards", F.lit(0))), F.lit(0)))
    b = versions.select("file_id", "content_hash").distinct().groupBy("file_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("versions"), F.count_if(F.col("count") > 1).alias("files_with_several"))
    names = ["shards", "bytes", "largest", "mean", "versions", "files_with_several"]
    return a.crossJoin(b).select(*[F.col(c).cast("long") for c in names]).unpivot([], names, "metric", "value")  # one row each


def shares_over(values: DataFrame, thresholds: list[int]) -> DataFrame:
    """values (measure, value) -> (measure, threshold, n, share): how many values of each measure
    are above each threshold."""
    over = values.groupBy("measure").agg(F.count("*").alias("all"), *[F.count_if(F.col("value") > x).alias(str(x)) for x in thresholds])
    rows = over.unpivot(["measure", "all"], [F.col(f"`{x}`") for x in thresholds], "threshold", "n")
    return rows.select("measure", F.col("threshold").cast("long").alias("threshold"), "n", (F.col("n") / F.col("all")).alias("share"))


def relations_per_variant(relations: DataFrame) -> DataFrame:
    """relations (path, variant, ...) -> (measure, value): relations of each stored variant."""
    return relations.groupBy("path", "variant").agg(F.count("*").cast("long").alias("value")).select(F.lit("relations").alias("measure"), "value")


def rows_per_file(occurrences: DataFrame) -> DataFrame:
    """(measure, value): the rows of each file, as in row_distributions, for which nothing but a
    count travels."""
    return occurrences.groupBy("file_id").agg(F.count("*").cast("long").alias("value")).select(F.lit("rows").alias("measure"), "value")


def graph_rows(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, module, includes): a row per including file, ready for JSON: the first of its module
    names (or null), and its included files in order, over all configurations."""
    names = modules.groupBy(F.col("file_id").alias("src")).agg(F.min("name").alias("module"))
    lists = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("includes"))
    return lists.join(names, "src", "left").select("src", "module", "includes")


def largest_files(occurrences: DataFrame, n: int = 10) -> DataFrame:
    return occurrences.groupBy("file_id").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "file_id").limit(n)


def variant_stats(contributions: DataFrame) -> DataFrame:
    """Files, variants and contributions by bucket of the number of variants, and the share of
    contributions that a stored variant served."""
    per = contributions.groupBy("path").agg(F.countDistinct("rows_hash").alias("m"), F.count("*").alias("n"))
    m = F.col("m")
    bucket = F.when(m == 1, "1").when(m <= 8, "2-8").when(m <= 16, "9-16").when(m <= 32, "17-32").when(m <= 64, "33-64").otherwise(">64")
    out = per.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum("m").alias("variants"), F.sum("n").alias("contributions"))
    return out.withColumn("hit_rate", 1 - F.col("variants") / F.col("contributions"))


def row_distributions(occurrences: DataFrame) -> DataFrame:
    """(measure, value): rows and symbols per file, token lengths, distances between starts and
    last ends, ready for percentiles."""
    per = occurrences.groupBy("file_id").agg(F.count("*").alias("rows"), F.countDistinct("symbol_id").alias("symbols"), F.max("end").alias("last_end"))
    gap = F.col("begin") - F.lag("begin").over(Window.partitionBy("file_id").orderBy("begin"))
    single = occurrences.select((F.col("end") - F.col("begin")).alias("length"), gap.alias("gap"))
    longs = lambda df: df.unpivot([], [F.col(c).cast("long").alias(c) for c in df.columns if c != "file_id"], "measure", "value")
    return longs(per.drop("file_id")).union(longs(single)).filter("value is not null")


def kind_histogram(relations: DataFrame) -> DataFrame:
    return relations.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("symbol_id").alias("symbols"))


def scope_split(symbols: DataFrame) -> DataFrame:
    """symbols (tu, symbol_id, scope): by scope, rows over all units and symbols by the scope
    that their first unit gives."""
    every = symbols.groupBy("scope").agg(F.count("*").alias("rows"))
    first = symbols.groupBy("symbol_id").agg(F.min_by("scope", "tu").alias("scope")).groupBy("scope").agg(F.count("*").alias("symbols"))
    return every.join(first, "scope", "full_outer").select("scope", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def directive_sharing(includes: DataFrame) -> DataFrame:
    """includes (path, tu, line, target) -> (units, files, one_shape): by number of units of a
    file, the files and how many have the same include list in all of them."""
    shape = rows_hash(includes, ["path", "tu"], ["line", "target"])
    per = shape.groupBy("path").agg(F.count("*").alias("units"), F.countDistinct("hash").alias("shapes"))
    return per.groupBy("units").agg(F.count("*").alias("files"), F.count_if(F.col("shapes") == 1).alias("one_shape"))


def variant_sizes(rows: DataFrame, by: str, variant: str, symbol: str, columns: list[str]) -> DataFrame:
    """rows as size_model takes them, for each `by`: m variants, s symbols, rows (columns) and
    all_rows (columns and variant), all distinct. Rows are dealt out once, by `by` and symbol, and
    counted down step by step where they lie."""
    own = [c for c in columns if c not in (by, symbol)]
    dealt = rows.select(by, symbol, *own, variant).repartition(by, symbol).distinct()
    one = dealt.groupBy(by, symbol, *own).agg(F.count("*").alias("n"))
    per = one.groupBy(by, symbol).agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    sums = per.groupBy(by).agg(F.count("*").alias("s"), F.sum("rows").alias("rows"), F.sum("n").alias("all_rows"))
    return rows.select(by, variant).distinct().groupBy(by).agg(F.count("*").alias("m")).join(sums, by).select(by, "m", "s", "rows", "all_rows")


def size_model(per_file: DataFrame, row_bytes: int = 12, symbol_bytes: int = 8) -> DataFrame:
    """per_file (m variants, s symbols, rows distinct, all_rows over variants) -> one row: bytes
    with each variant stored apart, and with merged rows and a variant mask."""
    m = F.col("m")
    mask = F.when(m == 1, 0).when(m <= 32, 4).when(m <= 64, 8).otherwise(F.ceil(m / 8))
    apart = F.col("all_rows") * row_bytes + m * F.col("s") * symbol_bytes
    merged = F.col("rows") * (row_bytes + mask) + F.col("s") * symbol_bytes
    return per_file.agg(F.sum(apart).cast("long").alias("apart"), F.sum(merged).cast("long").alias("merged"))


def write_index(tables: dict[str, DataFrame], path: str, generation: int) -> None:
    """Each table as Parquet, below its generation; then the generation's pin, a small file that
    is written aside and renamed, so that it is there as a whole or not at all. Until then
    readers don't see the generation; a pinned one isn't written again."""
    spark = next(iter(tables.values())).sparkSession
    if generation in pinned(spark, path):
        raise ValueError(f"generation {generation} is pinned")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/generation={generation}")
    jvm = spark.sparkContext._jvm
    at, to = (jvm.org.apache.hadoop.fs.Path(f"{path}/pins/{x}") for x in (f".{uuid.uuid4().hex}", f"{generation}.json"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(at)
    out.write(bytearray(json.dumps({"generation": generation, "tables": sorted(tables)}).encode()))
    out.close()
    if not fs.rename(at, to):
        fs.delete(at, False)
        raise ValueError(f"generation {generation} was pinned by another writer")


def pinned(spark: SparkSession, path: str) -> list[int]:
    """The pinned generations, oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/pins")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))


def read_index(spark: SparkSession, path: str, name: str, generation: int | None = None) -> DataFrame:
    """A table of one pinned generation, the newest by default; only its folder is listed."""
    there = pinned(spark, path)
    if generation is None and there:
        generation = there[-1]
    if generation not in there:
        raise ValueError(f"no pinned generation {'' if generation is None else generation}")
    return spark.read.parquet(f"{path}/{name}/generation={generation}")


def collect_index(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes generations that aren't pinned, left by writers that failed, and pinned ones but
    for the newest `keep`: first their pins, then their tables. To be run while none is written.
    Returns the generations that stay."""
    there = pinned(spark, path)
    stay = there[-keep:] if keep > 0 else []
    for g in set(there) - set(stay):
        delete(spark, f"{path}/pins/{g}.json")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for table in [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []:
        for f in [f.getPath() for f in fs.listStatus(table)]:
            m = re.fullmatch(r"generation=(\d+)", f.getName())
            if m and int(m[1]) not in stay:
                delete(spark, f.toString())
    return stay


def stats_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table's rows as JSON lines, below its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/report={name}")
