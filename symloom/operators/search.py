"""Index queries, each for a batch of symbols, cursors or locators.

relations(file_id, symbol_id, kind, begin, end, target_symbol[, source, priority]),
symbols(symbol_id, name, kind), occurrences(file_id, begin, end, symbol_id)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.bounded import few
from symloom.functions.columns import basename

from .calls import calls_together
from .scan import line_context, line_table, to_position

#: Kinds that a search may return, and kinds of a document's outline.
SEARCHED = ("Namespace", "Class", "Struct", "Union", "Enum", "Type", "Field", "EnumMember", "Function", "Method", "Variable", "Parameter", "Macro", "Concept", "Module", "Operator", "MacroParameter", "Label", "Attribute")
OUTLINED = ("Namespace", "Class", "Struct", "Union", "Enum", "Type", "Field", "EnumMember", "Function", "Method", "Variable", "Macro", "Concept", "Module", "Operator", "Attribute")
#: The smallest long, for rows that come first.
NONE = -(1 << 63)
CLASS_LIKE = ("Class", "Struct", "Union")
#: Offsets of a file that share a bucket in the containment join.
BUCKET = 4096


def symbol_at(cursors: DataFrame, occurrences: DataFrame) -> DataFrame:
    """cursors (file_id, offset) with begin, end and symbol_id of the occurrence that holds the
    offset; one that only ends there comes after one that holds it. Both sides meet in buckets
    of offsets, so that a large file is many keys."""
    spans = occurrences.select("file_id", "begin", "end", "symbol_id", F.explode(F.sequence(F.floor(F.col("begin") / BUCKET), F.floor(F.col("end") / BUCKET))).alias("bucket"))
    # Dealt out once: what is asked is made distinct, joined and grouped where its bucket lies.
    asked = cursors.select("file_id", "offset", F.floor(F.col("offset") / BUCKET).alias("bucket")).repartition("file_id", "bucket").dropDuplicates(["file_id", "bucket", "offset"])
    hits = asked.join(spans, ["file_id", "bucket"]).filter("begin <= offset and offset <= end")
    best = hits.groupBy("file_id", "bucket", "offset").agg(F.min(F.struct((F.col("offset") == F.col("end")).alias("edge"), "begin", "end", "symbol_id")).alias("x"))
    return best.select("file_id", "offset", "x.begin", "x.end", "x.symbol_id")


def relations_of(wanted: DataFrame, relations: DataFrame, *kinds: str) -> DataFrame:
    """Relations of the wanted symbols (symbol_id), of the kinds given or of all."""
    rows = relations.filter(F.col("kind").isin(*kinds)) if kinds else relations
    return rows.join(wanted.select("symbol_id").distinct(), "symbol_id", "left_semi")


def symbol_info(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """symbol_id, name, kind of the source with the lowest priority number (names: symbol_id,
    name, kind, priority)."""
    best = names.groupBy("symbol_id").agg(F.min(F.struct("priority", "name", "kind")).alias("x"))
    return wanted.select("symbol_id").distinct().join(best, "symbol_id").select("symbol_id", "x.name", "x.kind")


def relation_locations(wanted: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """(symbol_id, file_id, begin, end), each place once."""
    return relations_of(wanted, relations, kind).select("symbol_id", "file_id", "begin", "end").distinct()


def definition(cursors: DataFrame, occurrences: DataFrame, relations: DataFrame) -> DataFrame:
    """cursors with places: the symbol's definitions; if there are none, or the cursor is on
    one, its declarations too, and without the cursor's own place if others remain."""
    at = symbol_at(cursors, occurrences).select("file_id", "offset", "symbol_id")
    rows = at.select(F.col("file_id").alias("cursor_file"), "offset", "symbol_id").join(relations_of(at, relations, "Definition", "Declaration").select("symbol_id", "kind", "file_id", "begin", "end").distinct(), "symbol_id")
    return _places(rows, F.col("kind") == "Definition")


def declaration(cursors: DataFrame, occurrences: DataFrame, relations: DataFrame) -> DataFrame:
    """cursors with places: declarations and definitions, without the cursor's own place if
    others remain."""
    at = symbol_at(cursors, occurrences).select("file_id", "offset", "symbol_id")
    rows = at.select(F.col("file_id").alias("cursor_file"), "offset", "symbol_id").join(relations_of(at, relations, "Definition", "Declaration").select("symbol_id", "kind", "file_id", "begin", "end").distinct(), "symbol_id")
    return _places(rows, None)


def _places(rows: DataFrame, first) -> DataFrame:
    per = Window.partitionBy("cursor_file", "offset")
    here = (F.col("file_id") == F.col("cursor_file")) & F.col("offset").between(F.col("begin"), F.col("end"))
    marked = rows.withColumn("here", here)
    if first is not None:
        own = marked.withColumns({"main": first, "n_main": F.count_if(first).over(per), "on_main": F.coalesce(F.bool_or(first & F.col("here")).over(per), F.lit(False))})
        own = own.withColumn("more", (F.col("n_main") == 0) | F.col("on_main"))
        marked = own.filter("main or more")
    else:
        marked = marked.withColumn("more", F.lit(True))
    places = marked.select("cursor_file", "offset", "symbol_id", "file_id", "begin", "end", "here", "more").distinct()
    n = F.count("*").over(per)
    return places.withColumn("n", n).filter("not (more and here and n > 1)").select("cursor_file", "offset", "symbol_id", "file_id", "begin", "end")


def place_counts(cursors: DataFrame, occurrences: DataFrame, relations: DataFrame, definitions_first: bool) -> DataFrame:
    """cursors with n, how many places `definition` (definitions_first) or `declaration` gives,
    and s, the sum of their offsets, without making a row for each: places are added up by
    symbol, and a cursor's own place is taken off where it doesn't count."""
    at = symbol_at(cursors, occurrences).select(F.col("file_id").alias("cursor_file"), "offset", "symbol_id")
    places = relations.filter(F.col("kind").isin("Definition", "Declaration")).join(at.select("symbol_id").distinct(), "symbol_id", "left_semi")
    places = places.groupBy("symbol_id", "file_id", "begin", "end").agg(F.bool_or(F.col("kind") == "Definition").alias("main"))
    sums = places.groupBy("symbol_id").agg(F.count("*").alias("n"), F.sum("begin").alias("s"), F.count_if("main").alias("n_main"), F.sum(F.when(F.col("main"), F.col("begin"))).alias("s_main"))
    spans = places.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin") / BUCKET), F.floor(F.col("end") / BUCKET)))).withColumnRenamed("file_id", "cursor_file")
    own = at.withColumn("bucket", F.floor(F.col("offset") / BUCKET)).join(spans, ["symbol_id", "cursor_file", "bucket"]).filter("begin <= offset and offset <= end")
    own = own.groupBy("cursor_file", "offset").agg(F.count("*").alias("n_own"), F.sum("begin").alias("s_own"), F.bool_or("main").alias("on_main"))
    rows = at.join(sums, "symbol_id").join(own, ["cursor_file", "offset"], "left")
    more = (F.col("n_main") == 0) | F.coalesce("on_main", F.lit(False)) if definitions_first else F.lit(True)
    off = more & (F.col("n") > 1)
    n = F.when(off, F.col("n") - F.coalesce("n_own", F.lit(0))).when(more, F.col("n")).otherwise(F.col("n_main"))
    s = F.when(off, F.col("s") - F.coalesce("s_own", F.lit(0))).when(more, F.col("s")).otherwise(F.col("s_main"))
    return rows.select("cursor_file", "offset", n.alias("n"), s.alias("s")).filter("n > 0")


def relation_location(wanted: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """One place per symbol: of the source with the lowest priority number, the first file and
    offset there. Places are cut down to one a symbol before they meet the wanted ones."""
    order = [F.col("priority")] if "priority" in relations.columns else [F.lit(0)]
    best = relations.filter(F.col("kind") == kind).groupBy("symbol_id").agg(F.min(F.struct(*[o.alias("p") for o in order], "file_id", "begin", "end")).alias("x"))
    return relations_of(wanted, best).select("symbol_id", "x.file_id", "x.begin", "x.end")


def canonical_location(wanted: DataFrame, relations: DataFrame) -> DataFrame:
    """One place per symbol: its definition, else its declaration."""
    d = relation_location(wanted, relations, "Definition")
    return d.union(relation_location(wanted, relations, "Declaration").join(d, "symbol_id", "left_anti"))


def resolve_symbol(wanted: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """canonical_location with name and kind; symbols without one of them are left out."""
    return canonical_location(wanted, relations).join(symbols.filter("name <> '' and kind is not null").select("symbol_id", "name", "kind"), "symbol_id")


def placed(relations: DataFrame) -> DataFrame:
    """(symbol_id) of symbols with a place: fewer rows than the relations that lead to them."""
    return relations.filter(F.col("kind").isin("Definition", "Declaration")).select("symbol_id")


def targets(wanted: DataFrame, relations: DataFrame, kind: str) -> DataFrame:
    """(symbol_id, target_symbol, file_id, begin, end): distinct targets, where they are."""
    pairs = relations_of(wanted, relations, kind).filter("target_symbol is not null").select("symbol_id", "target_symbol").distinct()
    place = canonical_location(placed(relations), relations).withColumnRenamed("symbol_id", "target_symbol")
    return pairs.join(place, "target_symbol").select("symbol_id", "target_symbol", "file_id", "begin", "end")


def type_definition(wanted: DataFrame, relations: DataFrame) -> DataFrame:
    return targets(wanted, relations, "TypeDefinition")


def implementation(wanted: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Derived types of class-like symbols, implementations of others."""
    kinds = wanted.join(symbols, "symbol_id")
    like = F.coalesce(F.col("kind").isin(*CLASS_LIKE), F.lit(False))
    return targets(kinds.filter(like), relations, "Derived").union(targets(kinds.filter(~like), relations, "Implementation"))


def references(wanted: DataFrame, relations: DataFrame, declarations: bool = True) -> DataFrame:
    """(symbol_id, kind, file_id, begin, end): references, and declarations and definitions;
    each list is distinct, and a place may be in several."""
    kinds = ("Reference", "Declaration", "Definition") if declarations else ("Reference",)
    return relations_of(wanted, relations, *kinds).select("symbol_id", "kind", "file_id", "begin", "end").distinct()


def references_with_context(wanted: DataFrame | None, relations: DataFrame, sources: DataFrame, definitions: bool = False) -> DataFrame:
    """(symbol_id, file_id, begin, line, text): references, with the line around them; with
    definitions too if asked for. Where the content is gone the text is ''. Those of every symbol
    (wanted None) don't meet a list first; relations then have lists of symbol_id and begin for a
    file, and are made distinct where its text lies."""
    kinds = ("Reference", "Definition") if definitions else ("Reference",)
    rows = relations.filter(F.col("kind").isin(*kinds)) if wanted is None else relations_of(wanted, relations, *kinds)
    rows = rows.select("symbol_id", "file_id", F.col("begin").alias("offset"))
    return line_context(rows if wanted is None else rows.distinct(), sources).select("symbol_id", "file_id", F.col("offset").alias("begin"), "line", F.coalesce("text", F.lit("")).alias("text"))


def reference_totals(wanted: DataFrame, relations: DataFrame, definitions: bool = False) -> DataFrame:
    """(symbol_id, total): how many references each wanted symbol has, 0 included; with
    definitions too if asked for."""
    kinds = ("Reference", "Definition") if definitions else ("Reference",)
    rows = relations_of(wanted, relations, *kinds).select("symbol_id", "file_id", "begin").distinct().groupBy("symbol_id").agg(F.count("*").alias("total"))
    return wanted.select("symbol_id").distinct().join(rows, "symbol_id", "left").select("symbol_id", F.coalesce("total", F.lit(0)).alias("total"))


def definition_text(wanted: DataFrame, relations: DataFrame, sources: DataFrame) -> DataFrame:
    """(symbol_id, file_id, text, start_line, end_line): the first definition whose range is in
    bounds and not empty, and the lines, from 1, on which it begins and ends."""
    found = relations_of(wanted, relations, "Definition").join(sources.select("file_id", F.length("content").alias("n")), "file_id").filter("begin < end and end <= n")
    first = found.groupBy("symbol_id").agg(F.min(F.struct("file_id", "begin", "end")).alias("x")).select("symbol_id", "x.*")
    text = F.substr("content", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    own = first.join(sources, "file_id").withColumns({"text": text, "start_line": 1 + breaks(F.substr("content", F.lit(1), F.col("begin").cast("int")))})
    return own.select("symbol_id", "file_id", "text", F.col("start_line").cast("long").alias("start_line"), (F.col("start_line") + breaks("text")).cast("long").alias("end_line"))


def first_places(relations: DataFrame) -> DataFrame:
    """canonical_location of every symbol that has one, in one aggregation."""
    order = F.col("priority") if "priority" in relations.columns else F.lit(0)
    rows = relations.filter(F.col("kind").isin("Definition", "Declaration"))
    best = rows.groupBy("symbol_id").agg(F.min(F.struct((F.col("kind") != "Definition").alias("declared"), order.alias("p"), "file_id", "begin", "end")).alias("x"))
    return best.select("symbol_id", "x.file_id", "x.begin", "x.end")


def calls(wanted: DataFrame | None, relations: DataFrame, kind: str) -> DataFrame:
    """(symbol_id, target_symbol, file_id, begin, end, ranges, calls): rows of Caller (incoming)
    or Callee (outgoing) of the wanted symbols (None: of all) by target: where the target is (its
    definition, else its declaration; targets without a place are dropped), and its distinct ranges
    (file_id, begin, end) in order with their number.

    Rows are dealt out once, by target. Places of targets come first in a task, which holds them;
    then come calls by one number for target and symbol, as that is the cheapest order that puts
    together what belongs together."""
    rows = relations.filter((F.col("kind") == kind) & F.col("target_symbol").isNotNull() & F.col("symbol_id").isNotNull())
    if wanted is not None:
        rows = relations_of(wanted, rows)
    own = rows.select("target_symbol", "symbol_id", "file_id", "begin", (F.col("end") - F.col("begin")).alias("size"))
    types = dict(rows.dtypes)
    place = first_places(relations).select("symbol_id", F.lit(None).cast(types["symbol_id"]), "file_id", "begin", F.col("end") - F.col("begin"))
    key = F.when(F.col("symbol_id").isNull(), F.lit(NONE)).otherwise(F.greatest(F.xxhash64("target_symbol", "symbol_id"), F.lit(NONE + 1)))
    dealt = own.union(place.toDF(*own.columns)).repartition("target_symbol").withColumn("key", key).sortWithinPartitions("key")
    at = f"file_id {types['file_id']}, begin {types['begin']}, end {dict(own.dtypes)['size']}"
    return dealt.mapInArrow(calls_together, f"symbol_id {types['symbol_id']}, target_symbol {types['target_symbol']}, {at}, ranges array<struct<{at}>>, calls long")


def incoming_calls(wanted: DataFrame | None, relations: DataFrame) -> DataFrame:
    return calls(wanted, relations, "Caller")


def outgoing_calls(wanted: DataFrame | None, relations: DataFrame) -> DataFrame:
    return calls(wanted, relations, "Callee")


def supertypes(wanted: DataFrame, relations: DataFrame) -> DataFrame:
    return targets(wanted, relations, "Base")


def subtypes(wanted: DataFrame, relations: DataFrame) -> DataFrame:
    return targets(wanted, relations, "Derived")


def hierarchy(wanted: DataFrame, relations: DataFrame, up: str, down: str, depth: int = 1) -> DataFrame:
    """(root, side, symbol_id, depth): what relations lead to from each root, both ways. A single
    step has nothing to carry on: its relations meet the roots once, for both sides, and are
    distinct where they met."""
    from .graph import closure

    if depth == 1:
        steps = relations_of(wanted, relations.filter("target_symbol <> symbol_id"), up, down)
        return steps.select(F.col("symbol_id").alias("root"), F.col("kind").alias("side"), F.col("target_symbol").alias("symbol_id")).distinct().withColumn("depth", F.lit(1))
    seeds = wanted.select(F.col("symbol_id").alias("root"), F.col("symbol_id").alias("node"))
    out = None
    for side in (up, down):
        arcs = relations.filter((F.col("kind") == side) & F.col("target_symbol").isNotNull()).select(F.col("symbol_id").alias("src"), F.col("target_symbol").alias("dst"))
        rows = closure(seeds, arcs, depth).filter("depth > 0").select("root", F.lit(side).alias("side"), F.col("node").alias("symbol_id"), "depth")
        out = rows if out is None else out.union(rows)
    return out


def search_symbols(queries: DataFrame, symbols: DataFrame, relations: DataFrame, kinds=SEARCHED, most: int = 100) -> DataFrame:
    """queries (query) x symbols whose name holds it, whatever the case, that are of the kinds
    (None: any) and have a definition: the first `most` by name. The queries are a stated, small
    list, and every name is looked at once for all of them."""
    rows = symbols.filter("name <> ''")
    if kinds is not None:
        rows = rows.filter(F.col("kind").isin(*kinds))
    defined = relations.filter("kind = 'Definition'").select("symbol_id").distinct()
    hits = rows.join(few(queries.select("query").distinct()), F.expr("contains(lower(name), lower(query))")).join(defined, "symbol_id", "left_semi")
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("name", "symbol_id"))).filter(F.col("rank") <= most).select("query", "rank", "symbol_id", "name", "kind")


#: Letters of a posting's gram, at most.
GRAM = 3


def grams_of(text: Column, sizes: list[int]) -> Column:
    """The distinct grams of text of these sizes, in letters, case aside; of size 0 the empty one."""
    low = F.lower(text)
    some = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda k: F.substring(low, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[some(n) if n else F.array(F.lit("")) for n in sizes]))


def name_postings(symbols: DataFrame) -> DataFrame:
    """(gram, symbol_id): each gram of up to three letters of each symbol's name, once. Written
    by gram (clustered.write_clustered), it answers searches for parts of names."""
    return symbols.filter("name is not null").select(F.explode(grams_of(F.col("name"), [0, 1, 2, 3])).alias("gram"), "symbol_id").distinct()


def candidates(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """queries (query) -> (query, symbol_id): symbols of the posting list of each query's rarest
    gram, of three letters or of all where it has fewer; whatever holds the query is among them.
    Queries may be many: they meet lists by gram and not every name. A query with a gram that no
    name has finds nothing; the count of a list is taken only for grams that are asked for."""
    asked = queries.filter("query is not null").select("query").distinct()
    long, size = F.length(F.lower("query")), lambda n: grams_of(F.col("query"), [n])
    own = F.when(long >= GRAM, size(3)).when(long == 2, size(2)).when(long == 1, size(1)).otherwise(size(0))
    grams = asked.select("query", F.explode(own).alias("gram"))
    lists = postings.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    met = grams.join(lists, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = met.groupBy("query").agg(F.min(F.struct("n", "gram")).alias("r")).filter("r.n > 0").select("query", F.col("r.gram").alias("gram"))
    return postings.join(rarest, "gram").select("query", "symbol_id")


def search_by_postings(queries: DataFrame, symbols: DataFrame, postings: DataFrame, relations: DataFrame, kinds=SEARCHED, most: int = 100) -> DataFrame:
    """As search_symbols, for any number of queries, with the postings of the symbols' names."""
    rows = symbols.filter("name <> ''")
    if kinds is not None:
        rows = rows.filter(F.col("kind").isin(*kinds))
    defined = relations.filter("kind = 'Definition'").select("symbol_id").distinct()
    found = candidates(queries, postings).join(rows, "symbol_id").filter("contains(lower(name), lower(query))").join(defined, "symbol_id", "left_semi")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("name", "symbol_id"))).filter(F.col("rank") <= most).select("query", "rank", "symbol_id", "name", "kind")


def locate_symbols(locators: DataFrame, symbols: DataFrame, places: DataFrame) -> DataFrame:
    """locators (locator, name, path) -> (locator, symbol_id): symbols named so, whole or after
    `::`, case aside; if there are none, those whose name holds it. With a path only those
    defined (places: symbol_id, path) in a file of that base name or path ending."""
    asked = few(locators.withColumn("low", F.lower("name")).select("locator", "low", F.col("path").alias("want")))
    low = F.lower(symbols["name"])
    hits = symbols.join(asked, F.contains(low, F.col("low"))).withColumn("partial", ~((low == F.col("low")) | F.endswith(low, F.concat(F.lit("::"), "low"))))
    ok = (basename(F.col("path")) == F.col("want")) | F.endswith(F.col("path"), F.concat(F.lit("/"), "want")) | (F.col("path") == F.col("want"))
    hits = hits.join(places, "symbol_id", "left").filter(F.col("want").isNull() | ok).select("locator", "symbol_id", "partial").distinct()
    return hits.withColumn("exact", F.min("partial").over(Window.partitionBy("locator"))).filter("partial = exact").select("locator", "symbol_id")


def locate_by_id(locators: DataFrame, symbols: DataFrame, places: DataFrame) -> DataFrame:
    """locators (locator, symbol_id) -> (locator, symbol_id): symbols that have a name and a
    definition (places: symbol_id, path). An id of 0 or null is none."""
    asked = locators.filter("symbol_id <> 0").select("locator", "symbol_id").distinct()
    named = symbols.filter("name is not null").select("symbol_id").distinct()
    return asked.join(named, "symbol_id", "left_semi").join(places.select("symbol_id").distinct(), "symbol_id", "left_semi").select("locator", "symbol_id")


def definition_lines(relations: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, line, begin, symbol_id): definitions with the line, from 1, on which they begin."""
    rows = relations.filter("kind = 'Definition'").select("file_id", "begin", "symbol_id").distinct()
    at = to_position(rows.select("file_id", F.col("begin").alias("offset")).distinct(), line_table(sources)).filter("line is not null")
    return rows.join(at.select("file_id", F.col("offset").alias("begin"), (F.col("line") + 1).alias("line")), ["file_id", "begin"]).select("file_id", "line", "begin", "symbol_id")


def locate_by_line(locators: DataFrame, files: DataFrame, definitions: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """locators (locator, path, line) -> (locator, symbol_id): the symbol defined on that line
    (definitions: of definition_lines) of the file with that path (files: file_id, path), the
    first where there are several. Files of stale (file_id), whose lines aren't those of the text
    as it is, have none. Equal paths and lines meet in a join, so locators may be many."""
    known = files.select("file_id", "path").join(stale.select("file_id").distinct(), "file_id", "left_anti") if stale is not None else files.select("file_id", "path")
    asked = locators.select("locator", "path", F.col("line").cast("long").alias("line")).distinct().join(known, "path")
    first = asked.join(definitions, ["file_id", "line"]).groupBy("locator").agg(F.min(F.struct("begin", "symbol_id"))["symbol_id"].alias("symbol_id"))
    return first.select("locator", "symbol_id")


def resolve_unique(locators: DataFrame, located: DataFrame) -> DataFrame:
    """(locator, status, candidates, symbol_id): found, ambiguous or not found."""
    n = located.groupBy("locator").agg(F.count("*").alias("candidates"), F.min("symbol_id").alias("symbol_id"))
    joined = locators.select("locator").distinct().join(n, "locator", "left")
    c = F.coalesce("candidates", F.lit(0))
    return joined.select("locator", F.when(c == 0, "not found").when(c == 1, "found").otherwise("ambiguous").alias("status"), c.alias("candidates"), F.when(c == 1, F.col("symbol_id")).alias("symbol_id"))


def document_symbols(files: DataFrame, symbols: DataFrame, relations: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, symbol_id, name, kind, start_line, end_line): definitions of outline kinds in
    the files, lines from 1."""
    rows = relations.filter("kind = 'Definition'").join(files.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "symbol_id", "begin", "end")
    rows = rows.join(symbols.filter(F.col("kind").isin(*OUTLINED) & (F.col("name") != "")), "symbol_id")
    table = line_table(sources)
    at = lambda c, to: to_position(rows.select("file_id", F.col(c).alias("offset")).distinct(), table).select("file_id", F.col("offset").alias(c), (F.col("line") + 1).alias(to)).filter(f"{to} is not null")
    return rows.join(at("begin", "start_line"), ["file_id", "begin"]).join(at("end", "end_line"), ["file_id", "end"]).select("file_id", "symbol_id", "name", "kind", "start_line", "end_line")


def read_symbol(locators: DataFrame, symbols: DataFrame, places: DataFrame, relations: DataFrame, sources: DataFrame) -> DataFrame:
    """(locator, status, candidates, text): the definition's text where one symbol was found."""
    unique = resolve_unique(locators, locate_symbols(locators, symbols, places))
    text = definition_text(unique.filter("status = 'found'"), relations, sources).select("symbol_id", "text")
    return unique.join(text, "symbol_id", "left").select("locator", "status", "candidates", "text")


def serving_files(files: DataFrame, pending: DataFrame, open_files: DataFrame, indexing: bool = True, disk_only: bool = False) -> DataFrame:
    """files without those whose content changed and isn't indexed yet (unless indexing is off)
    and, unless only disk rows are asked for, without open ones."""
    out = files
    if indexing:
        out = out.join(pending.filter("reason = 'ContentChanged'").select("file_id"), "file_id", "left_anti")
    return out if disk_only else out.join(open_files.select("file_id"), "file_id", "left_anti")


#: Bytes of a query and of a name that take part in a fuzzy score.
QUERY_MOST, NAME_MOST = 63, 127
#: Scores of a letter: full marks, and what can't be.
FULL, NEVER = 4, -(1 << 13)
#: What a letter earns by being found, by agreeing in case or in where it stands, and
#: by coming right after another or at the start; what it costs to skip the first character or the
#: head of a segment, and to match inside of a segment: the head of a segment of the query, its
#: first letter, and a letter after a gap.
FOUND, ALIKE, NEXT = 1, 1, 2
SKIP_FIRST, SKIP_HEAD, HEAD_INSIDE, FIRST_INSIDE, GAP_INSIDE = 3, 1, 1, 4, 3


def segments(text: str) -> tuple[list[str], set[str]]:
    """The place of each character in its segment (head, tail, or - for separators), and the
    kinds of characters (lower, upper, -) that occur. Digits and non-ASCII count as lower."""
    kind = ["upper" if "A" <= c <= "Z" else "lower" if c.isalnum() or ord(c) > 127 else "-" for c in text]
    role = []
    for i, k in enumerate(kind):
        before, after = kind[i - 1] if i else "-", kind[i + 1] if i + 1 < len(kind) else None
        inside = before == "lower" if k == "lower" else before == "upper" and after != "lower"
        role.append("-" if k == "-" else "tail" if before != "-" and (inside or (k == "lower" and before == "upper")) else "head")
    return role, set(kind)


def fuzzy_score(query: str, name: str) -> float | None:
    """How well the letters of query are found in order in name, case aside; None: not at all.

    The best placement counts. The first letter, and one after a gap, must begin a segment.
    A letter scores 1; 1 more if the case agrees or it begins a segment in both; 2 more right
    after another or at the start of the name. It costs to skip the first character (3) and the
    head of a segment (1) before the last letter is placed, and to match inside of a segment.
    Full marks for every letter are 1, and twice that if nothing of the name is left over. Bytes
    count as letters, and only ASCII has cases."""
    q, n = (x.encode().decode("latin-1")[:most] for x, most in ((query, QUERY_MOST), (name, NAME_MOST)))
    if not q:
        return 1.0
    if len(q) > len(n):
        return None
    same = [c.lower() if c.isascii() else c for c in n]
    role, kinds = segments(n)
    own_role, own_kinds = segments(q)
    single = own_kinds in ({"lower"}, {"upper"})
    skip = [SKIP_FIRST if i == 0 else SKIP_HEAD * (r == "head") for i, r in enumerate(role)]
    # Best sums over the characters so far whose last one was skipped, or matched.
    skipped, matched = [0], [NEVER]
    for i in range(len(n)):
        skipped.append(skipped[-1] - skip[i])
        matched.append(NEVER)
    for k, letter in enumerate(q):
        last = k == len(q) - 1
        low = letter.lower() if letter.isascii() else letter
        to_skipped, to_matched = [NEVER] * (len(n) + 1), [NEVER] * (len(n) + 1)
        for i in range(k, len(n)):
            cost = 0 if last else skip[i]
            to_skipped[i + 1] = max(to_matched[i], to_skipped[i]) - cost
            if same[i] != low:
                continue
            tail = role[i] == "tail"
            point = FOUND + ALIKE * (letter == n[i] or (role[i] == "head" and (single or own_role[k] == "head")))
            point -= HEAD_INSIDE * (own_role[k] == "head" and tail) + FIRST_INSIDE * (k == 0 and tail)
            run = matched[i] + point + NEXT
            # Capitals of one word may begin segments of their own, unless all letters are capitals.
            strong = not tail or (n[i] != same[i] and "lower" in kinds)
            jump = skipped[i] + point + NEXT * (i == 0) - GAP_INSIDE * (tail and k > 0) if strong else NEVER
            to_matched[i + 1] = max(run, jump)
        skipped, matched = to_skipped, to_matched
    best = max(skipped[-1], matched[-1])
    if best < NEVER / 2:
        return None
    return min(FULL * len(q), max(0, best)) / (FULL * len(q)) * (2 if len(q) == len(n) else 1)


def fuzzy_rank(queries: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, name, score): the k best of the distinct names for each of the (few, stated)
    queries, ties by name. Names that lack the letters in order are dropped before any is scored."""
    # Of the query what the score looks at, and no more.
    scored_part = F.filter(F.filter(F.split(F.lower("query"), ""), lambda x: x != ""), lambda x, i: F.octet_length(F.substr(F.lower("query"), F.lit(1), i + 1)) <= QUERY_MOST)
    # Up to each letter what isn't that letter, and no way back: linear in the name.
    letters = F.transform(scored_part, lambda x: F.concat(F.lit("[^\\Q"), x, F.lit("\\E]*+\\Q"), x, F.lit("\\E")))
    asked = queries.select("query").distinct().withColumns({"rx": F.concat(F.lit("(?s)"), F.array_join(letters, "")), "need": F.size(letters)})
    pairs = names.select("name").distinct().join(few(asked), F.expr("length(name) >= need and lower(name) rlike rx"))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, n in parts:
            yield pd.Series([fuzzy_score(a, b) for a, b in zip(q, n, strict=True)], dtype=float)

    scored = pairs.select("query", "name", score("query", "name").alias("score")).filter("score is not null")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name"))).filter(F.col("rank") <= k).select("query", "rank", "name", "score")


def index_status(queue: DataFrame) -> DataFrame:
    """queue (file_id, pending) -> one row: idle, pending, total, indexed."""
    n = F.count_if("pending")
    return queue.agg((n == 0).alias("idle"), n.alias("pending"), F.count("*").alias("total"), (F.count("*") - n).alias("indexed"))
