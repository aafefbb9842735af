"""The include graph: edges(src, config_id, dst, conditional, ord), modules(name, file_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.columns import common_prefix, dirname, stem, suffix
from symloom.functions.lineage import Grown, cut
from symloom.operators.scan import resolve_includes


def word_of(root: Column) -> Column:
    return F.shiftright(root, 6)


def bit_of(root: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), root.bitwiseAND(63).cast("int"))


def places_in(bits: Column) -> Column:
    """The places, from 0, of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftright", bits, k).bitwiseAND(1) == 1)


def reached_words(seeds: DataFrame, arcs: DataFrame, most: int | None = None) -> DataFrame:
    """(node, word, bits, depth): the closure of seeds (root, node) with 64 roots in one long.
    Bit k of word w is root 64 w + k, so roots whose ids are near, as files of one folder have
    them, go on together; ids far apart are right too, with a row each. A row has the roots that
    first come to its node at its depth. Arcs (src, dst) are distinct and written.

    A step is one join and one aggregate: what comes in and what was met are OR-ed by node and
    word, and only bits that are new go on, so cycles end. Seeds with nulls are none."""
    levels = Grown(seeds.sparkSession, "closure")
    packed = seeds.filter("root is not null and node is not null").select("node", word_of(F.col("root")).alias("word"), bit_of(F.col("root")).alias("bit"))
    front, depth, none = levels.add(packed.groupBy("node", "word").agg(F.bit_or("bit").alias("bits"))), 0, F.lit(0).cast("long")
    while most is None or depth < most:
        depth += 1
        came = front.join(arcs, front["node"] == arcs["src"]).select(F.col("dst").alias("node"), "word", F.col("bits").alias("came"), none.alias("met"))
        met = levels.all().select("node", "word", none, "bits")
        both = came.union(met).groupBy("node", "word").agg(F.bit_or("came").bitwiseAND(F.bitwise_not(F.bit_or("met"))).alias("bits"))
        front = levels.add(both.filter("bits <> 0"))
        if front.isEmpty():
            break
    return levels.all().withColumnRenamed("at_step", "depth")


def roots_of(words: DataFrame, to: str) -> DataFrame:
    """words, with a row for each root of a word in column `to`, instead of word and bits."""
    rows = words.withColumn("place_", F.explode(places_in(F.col("bits"))))
    return rows.withColumn(to, F.shiftleft("word", 6) + F.col("place_")).drop("word", "bits", "place_")


def closure(seeds: DataFrame, arcs: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth): nodes reached from each seed (root, node), with the length of the
    shortest way; the seed itself has depth 0. All roots advance together, 64 in a word."""
    words = reached_words(seeds, cut(arcs.select("src", "dst").distinct()), most)
    return roots_of(words, "root").select("root", "node", "depth")


def reached_from(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(file_id): what arcs (src, dst) lead to from any of files, in one step or more. One
    frontier goes on for all files; which of them a node was reached from isn't kept."""
    arcs = cut(arcs.select("src", "dst").distinct())
    met, front = None, files.select("file_id").distinct()
    while met is None or not front.isEmpty():
        after = front.join(arcs, front["file_id"] == arcs["src"]).select(F.col("dst").alias("file_id")).distinct()
        if met is None:
            met = Grown(files.sparkSession, "reached")
            front = met.add(after)
        else:
            front = met.add(after.join(met.all().select("file_id"), "file_id", "left_anti"))
    return met.all().select("file_id")


def latest_reaching(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(file_id, seq): what arcs (src, dst) lead to from files (file_id, seq) in one step or more,
    with the greatest seq of those it is reached from. A node goes on again only when its seq has
    risen, so that a step has a row for a node at most, however many files lead there."""
    arcs = cut(arcs.select("src", "dst").distinct())
    met, front, none = None, files.groupBy("file_id").agg(F.max("seq").alias("seq")), F.lit(None).cast("long")
    while met is None or not front.isEmpty():
        came = front.join(arcs, front["file_id"] == arcs["src"]).select(F.col("dst").alias("file_id"), "seq", none.alias("had"))
        if met is None:
            met = Grown(files.sparkSession, "latest")
        else:
            came = came.union(met.all().select("file_id", none, "seq"))
        best = came.groupBy("file_id").agg(F.max("seq").alias("seq"), F.max("had").alias("had"))
        front = met.add(best.filter("seq is not null and (had is null or seq > had)").select("file_id", "seq"))
    return met.all().groupBy("file_id").agg(F.max("seq").alias("seq"))


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def modules_of(modules: DataFrame) -> DataFrame:
    return modules.select("name", "file_id").distinct()


def lookup_module(modules: DataFrame, names: DataFrame) -> DataFrame:
    """Candidate files of each wanted name."""
    return modules_of(modules).join(names.select("name").distinct(), "name")


def set_includes(edges: DataFrame, fresh: DataFrame, owners: DataFrame) -> DataFrame:
    """edges, with the lists of owners (src, config_id) replaced by fresh ones. An owner
    without fresh edges is cleared."""
    kept = edges.join(owners.select("src", "config_id").distinct(), ["src", "config_id"], "left_anti").select(edges.columns)
    return kept.unionByName(fresh.select(edges.columns))


def all_includes(edges: DataFrame) -> DataFrame:
    """Over all configurations: an edge is conditional only if it is so everywhere."""
    return edges.groupBy("src", "dst").agg(F.bool_and("conditional").alias("conditional"), F.min("ord").alias("ord"))


def includers(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("file_id"), F.col("src").alias("includer")).distinct()


def all_files(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("file_id")).union(edges.select("dst")).distinct()


def graph_counts(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: files with edges, edges, and module names."""
    a = edges.agg(F.countDistinct("src").alias("files"), F.count("*").alias("edges"))
    return a.crossJoin(modules.agg(F.countDistinct("name").alias("modules")))


def roots(edges: DataFrame) -> DataFrame:
    """Files that nothing includes."""
    return edges.select(F.col("src").alias("file_id")).distinct().join(edges.select(F.col("dst").alias("file_id")).distinct(), "file_id", "left_anti")


def host_sources(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, host): files that include each of files at any distance and that nothing
    includes. The file itself isn't its host. Hosts are followed down to what they include, as
    hosts with neighbouring ids share most of it, along edges that lead to one of files."""
    wanted = files.select("file_id").distinct()
    arcs = cut(leading_to(wanted, edges))
    tops = roots(arcs)  # what includes a file on a way leads to the same file, so no includer is left out
    down = reached_words(tops.select(F.col("file_id").alias("root"), F.col("file_id").alias("node")), arcs)
    found = down.filter("depth > 0").join(wanted, F.col("node") == F.col("file_id"), "left_semi")
    return roots_of(found, "host").select(F.col("node").alias("file_id"), "host")


def leading_to(files: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (src, dst) on any way to one of files, found by one frontier backwards, so that
    ways from single roots aren't followed where nothing that is asked for lies."""
    files = files.select("file_id").distinct()
    behind = reached_from(files, reversed_(edges)).union(files).distinct().withColumnRenamed("file_id", "dst")
    return edges.select("src", "dst").distinct().join(behind, "dst", "left_semi").select("src", "dst")


def include_chain(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, target, step, node): a shortest chain from host to target for each reachable
    pair; a single step where they are equal. Of several includers at the same distance the
    smallest is taken. Hosts go in words, both down to what they reach and back from the target."""
    pairs = pairs.select("host", "target").distinct()
    arcs = cut(leading_to(pairs.select(F.col("target").alias("file_id")), edges))
    reach = reached_words(pairs.select(F.col("host").alias("root"), F.col("host").alias("node")).distinct(), arcs).select("node", "word", F.col("bits").alias("there"), F.col("depth").alias("step"))
    asked = pairs.groupBy("target", word_of(F.col("host")).alias("word")).agg(F.bit_or(bit_of(F.col("host"))).alias("bits")).withColumn("node", F.col("target"))
    both = F.col("bits").bitwiseAND(F.col("there"))
    walked = Grown(edges.sparkSession, "chain")
    at = walked.add(asked.join(reach, ["node", "word"]).select("target", "step", "node", "word", both.alias("bits")).filter("bits <> 0"))
    while not (at := at.filter("step > 0")).isEmpty():
        up = at.join(arcs, at["node"] == arcs["dst"]).select("target", (F.col("step") - 1).alias("step"), F.col("src").alias("node"), "word", "bits")
        on_way = up.join(reach, ["node", "word", "step"]).select("target", "step", "node", "word", F.explode(places_in(both)).alias("place"))
        nearest = on_way.groupBy("target", "step", "word", "place").agg(F.min("node").alias("node"))
        at = walked.add(nearest.groupBy("target", "step", "node", "word").agg(F.bit_or(bit_of(F.col("place").cast("long"))).alias("bits")))
    return roots_of(walked.all(), "host").select("host", "target", "step", "node")


def reaches(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (host, target) with `reaches`."""
    arcs = cut(leading_to(pairs.select(F.col("target").alias("file_id")), edges))
    reach = reached_words(pairs.select(F.col("host").alias("root"), F.col("host").alias("node")).distinct(), arcs)
    # A host's bit is set at one depth only, so a pair meets one row at most.
    met = (F.col("target") == F.col("node")) & (word_of(F.col("host")) == F.col("word")) & (F.col("bits").bitwiseAND(bit_of(F.col("host"))) != 0)
    return pairs.join(reach, met, "left").select("host", "target", F.col("node").isNotNull().alias("reaches"))


def file_deps(files: DataFrame, edges: DataFrame, direction: str = "both", depth: int = 1) -> DataFrame:
    """(file_id, side, other, depth): includes and includers up to a depth (0: any)."""
    seeds = files.select(F.col("file_id").alias("root"), F.col("file_id").alias("node"))
    sides = [(name, arcs) for name, arcs in (("includes", edges), ("includers", reversed_(edges))) if direction in ("both", name)]
    found = [closure(seeds, arcs, depth or None).filter("depth > 0 and not (depth > 1 and node = root)").select(F.col("root").alias("file_id"), F.lit(name).alias("side"), F.col("node").alias("other"), "depth") for name, arcs in sides]
    return found[0] if len(found) == 1 else found[0].union(found[1])


def impact_analysis(files: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_id, effect, value): direct includers, hosts that aren't direct, and modules of
    the hosts and of the file itself."""
    wanted = files.select("file_id").distinct()
    direct = includers(edges).join(wanted, "file_id", "left_semi")
    hosts = cut(host_sources(wanted, edges))
    further = hosts.join(direct.select("file_id", F.col("includer").alias("host")), ["file_id", "host"], "left_anti")
    names = modules.select(F.col("file_id").alias("of"), "name")
    owned = hosts.select("file_id", F.col("host").alias("of")).union(wanted.select("file_id", F.col("file_id"))).join(names, "of").select("file_id", F.lit("module").alias("effect"), "name")
    return direct.select("file_id", F.lit("direct").alias("effect"), F.col("includer").cast("string").alias("value")).union(further.select("file_id", F.lit("transitive"), F.col("host").cast("string"))).union(owned)


def project_files(files: DataFrame, indexed: DataFrame, modules: DataFrame, only: str | None = None) -> DataFrame:
    """(path, kind, module): files of the command table are modules, headers or sources; indexed
    headers that it lacks are added. A module file has its name, the last of several. With
    `only`, files of that kind."""
    header = suffix(F.col("path")).isin(".h", ".hpp", ".hxx", ".hh")
    own = files.join(module_map(modules).withColumnRenamed("name", "module"), "file_id", "left").select("path", F.when(F.col("module").isNotNull(), "module").when(header, "header").otherwise("source").alias("kind"), "module")
    more = indexed.select("path").filter(header).join(files.select("path"), "path", "left_anti").select("path", F.lit("header").alias("kind"), F.lit(None).cast("string").alias("module"))
    out = own.union(more).distinct()
    return out if only is None else out.filter(F.col("kind") == only)


def project_totals(listed: DataFrame) -> DataFrame:
    """(kind, total) of project_files, and the total of all."""
    return listed.groupBy("kind").agg(F.count("*").alias("total")).union(listed.agg(F.count("*")).select(F.lit("all"), F.col("count(1)")))


def module_map(modules: DataFrame) -> DataFrame:
    """file_id -> module; of several the last by name."""
    return modules.groupBy("file_id").agg(F.max("name").alias("name"))


def rank_hosts(pairs: DataFrame) -> DataFrame:
    """pairs (header, host: paths) with rank: same stem, then same directory, then how much of
    the shorter path is not common, then by path."""
    h, c = F.col("header"), F.col("host")
    order = [(stem(h) != stem(c)).cast("int"), (dirname(h) != dirname(c)).cast("int"), F.least(F.length(h), F.length(c)) - common_prefix(h, c), c]
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("header").orderBy(*order)))


def dependents_closure(units: DataFrame, deps: DataFrame) -> DataFrame:
    """(unit, dependent): each changed unit and all that depend on it (deps: src needs dst). What
    depends is followed down to what it needs, as neighbours share most of it, along edges that
    lead to one of units."""
    wanted = units.select("file_id").distinct()
    arcs = cut(leading_to(wanted, deps))
    own = arcs.select(F.col("src").alias("file_id")).union(wanted).distinct()
    down = reached_words(own.select(F.col("file_id").alias("root"), F.col("file_id").alias("node")), arcs)
    found = down.join(wanted, F.col("node") == F.col("file_id"), "left_semi")
    return roots_of(found, "dependent").select(F.col("node").alias("unit"), "dependent")


def build_levels(deps: DataFrame) -> DataFrame:
    """(unit, level): 0 without needs, else one above the highest need; null for units on a
    cycle or behind one. Units whose needs all have levels are peeled off, level by level."""
    arcs = cut(deps.select("src", "dst").distinct())
    left = cut(all_files(arcs))
    levels = Grown(deps.sparkSession, "levels")
    while True:
        open_ = arcs.join(left.withColumnRenamed("file_id", "dst"), "dst", "left_semi").select(F.col("src").alias("file_id"))
        ready = levels.add(left.join(open_, "file_id", "left_anti"))
        if ready.isEmpty():
            failed = left.select(F.col("file_id").alias("unit"), F.lit(None).cast("int").alias("level"))
            return levels.all().select(F.col("file_id").alias("unit"), F.col("at_step").alias("level")).union(failed)
        left = cut(left.join(ready, "file_id", "left_anti"))


def chain_dependents(headers: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, header): headers (file_id) whose chain, themselves and all they include, holds
    a file. A header's bit is set once for each node, so words become rows last, and nothing has to
    be made distinct then."""
    seeds = headers.select(F.col("file_id").alias("root"), F.col("file_id").alias("node"))
    words = reached_words(seeds, cut(edges.select("src", "dst").distinct()))
    held = words.join(files.select(F.col("file_id").alias("node")), "node", "left_semi")
    return roots_of(held, "header").select(F.col("node").alias("file_id"), "header")


def orphaned_choices(choices: DataFrame, reach: DataFrame, counts: DataFrame, hashes: DataFrame) -> DataFrame:
    """choices (file_id, host, occurrence, hash) that no longer hold: the host doesn't reach the
    file, the occurrence is beyond their number (if there are any), or the hash is gone.
    reach: host, target, reaches; counts: host, file_id, n; hashes: host, hash."""
    r = reach.select("host", F.col("target").alias("file_id"), "reaches")
    known = hashes.select("host", "hash", F.lit(True).alias("known")).distinct()
    joined = choices.join(r, ["host", "file_id"], "left").join(counts, ["host", "file_id"], "left").join(known, ["host", "hash"], "left")
    why = F.when(~F.coalesce("reaches", F.lit(False)), "unreachable").when((F.coalesce("n", F.lit(0)) > 0) & (F.col("occurrence") >= F.col("n")), "occurrence").when(F.col("hash").isNotNull() & F.col("known").isNull(), "hash")
    return joined.select("file_id", "host", "occurrence", why.alias("reason")).filter("reason is not null")


#: Errors that mean that a header can't stand alone.
CONTEXT_CODES = ("err_unknown_typename", "err_undeclared_var_use", "err_undeclared_var_use_suggest", "err_pp_unterminated_conditional")


def header_mode(diagnostics: DataFrame, codes=CONTEXT_CODES) -> DataFrame:
    """(file_id, needs_context): an error with one of the codes was reported."""
    hit = (F.col("severity") == "error") & F.col("code").isin(*codes)
    return diagnostics.groupBy("file_id").agg(F.bool_or(hit).alias("needs_context"))


def wavefront_scan(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, config_id, wave): files in the wave in which they are first met; of several
    discoverers in a wave the smallest (src, ord) gives the configuration."""
    spark = seeds.sparkSession
    arcs = cut(edges.select(F.col("src").alias("file_id"), "config_id", "dst", "ord"))
    waves = Grown(spark, "waves")
    front = waves.add(seeds.select("file_id", "config_id").dropDuplicates(["file_id"]))
    while not front.isEmpty():
        step = front.join(arcs, ["file_id", "config_id"])
        new = step.groupBy("dst").agg(F.min(F.struct("file_id", "ord", "config_id")).alias("by")).select(F.col("dst").alias("file_id"), "by.config_id")
        front = waves.add(new.join(waves.all().select("file_id"), "file_id", "left_anti"))
    return waves.all().select("file_id", "config_id", F.col("at_step").alias("wave"))


def wavefront_from_sources(seeds: DataFrame, includes: DataFrame, search: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scans from seeds (path, config_id) on, wave by wave, until no wave finds a new file.

    includes are what the files say (src: path, ord, name, angled, next, conditional), search and
    listing as in resolve_includes, which resolves each wave's own includes under the
    configuration, and from the directory index, that its files were found with. Of several
    discoverers of a file in a wave the smallest (src, ord, config_id) hands these on, and later
    ones change nothing; a file found beside its includer, or by an absolute name, has index 0.

    Returns waves (path, config_id, found_idx, wave), with a row for each configuration of a seed,
    and edges (src, config_id, ord, name, angled, conditional, idx, dst, wave), dst null where
    nothing was found. Files without a row in includes have no edges; null paths and names take no
    part. The state between waves is written to the shared folder, a folder each."""
    spark = seeds.sparkSession
    said = cut(includes.filter("src is not null and name is not null").select("src", "ord", "name", "angled", "next", "conditional"))
    waves, edges = Grown(spark, "waves"), Grown(spark, "edges")
    front = waves.add(seeds.filter("path is not null").select("path", "config_id", F.lit(0).cast("long").alias("found_idx")).distinct())
    while True:
        asked = front.withColumnRenamed("path", "src").join(said, "src")
        own = front.select(F.col("path").alias("src"), dirname(F.col("path")).alias("dir")).distinct()
        found = edges.add(resolve_includes(asked, search, listing, own).select("src", "config_id", "ord", "name", "angled", "conditional", "idx", F.col("path").alias("dst")))
        by = F.struct("src", "ord", "config_id", F.greatest(F.coalesce("idx", F.lit(0)), F.lit(0)).cast("long").alias("found_idx"))
        new = found.filter("dst is not null").groupBy("dst").agg(F.min(by).alias("by")).select(F.col("dst").alias("path"), "by.config_id", "by.found_idx")
        front = waves.add(new.join(waves.all().select("path"), "path", "left_anti"))
        if front.isEmpty():
            break
    each = lambda t: t.withColumnRenamed("at_step", "wave")
    return each(waves.all()), each(edges.all())


def scan_report(waves: DataFrame, files: DataFrame, edges: DataFrame, found: DataFrame, modules: DataFrame) -> DataFrame:
    """(metric, value): files by kind, edges by kind, found and resolved includes, their share
    (accuracy, in thousandths), modules, waves and the files of each. found: name, resolved
    (boolean)."""
    is_source = suffix(F.col("path")) == ".cpp"
    rows = [
        files.select(F.explode(F.array(F.lit("files"), F.when(is_source, "source_files").otherwise("header_files"))).alias("metric")),
        edges.select(F.explode(F.array(F.lit("edges"), F.when(F.col("conditional"), "conditional_edges").otherwise("unconditional_edges"))).alias("metric")),
        found.select(F.explode(F.array(F.lit("includes_found"), F.when(F.col("resolved"), "includes_resolved").otherwise("includes_unresolved"))).alias("metric")),
        modules.select("name").distinct().select(F.lit("modules").alias("metric")),
        waves.select("wave").distinct().select(F.lit("waves").alias("metric")),
        waves.select(F.concat(F.lit("wave_"), "wave").alias("metric")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    share = found.agg(F.floor(1000 * F.count_if("resolved") / F.count("*")).alias("value")).filter("value is not null").select(F.lit("accuracy").alias("metric"), "value")
    return out.groupBy("metric").agg(F.count("*").alias("value")).union(share)


