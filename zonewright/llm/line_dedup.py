"""Line dedup by how large a share of a host's pages has the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import source_key, with_row_ids

#: A line on more than this share of its host's pages is boilerplate ...
RATIO = 0.05
#: ... if so many pages have it.
LEAST_PAGES = 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_mark(line: Column) -> Column:
    """64-bit hash of a line without white space at its ends; null for a blank one."""
    bare = F.regexp_replace(line, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def without_copies(docs: DataFrame) -> DataFrame:
    """(source, text) of docs, each text of a host once. Only the hashes and numbers of rows are shuffled, not the texts."""
    rows = with_row_ids(docs.select("doc_id", "source", "text"), "lines-rows")
    text = F.col("text")
    marks = rows.select("_zw_rid", source_key(F.col("source")).alias("host"), F.length(text).alias("n"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"))
    marks = materialize(marks, "lines-texts")
    firsts = marks.groupBy("host", "n", "h", "g").agg(F.min("_zw_rid").alias("_zw_rid"))
    copies = materialize(marks.join(firsts, "_zw_rid", "left_anti").select("_zw_rid"), "lines-copies")
    return rows.join(copies, "_zw_rid", "left_anti").select("source", "text")


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, slots): the lines that over `ratio` of a host's pages have, as a table of slots (see slotted), stored.

    Pages of the same text are one page of their host, so a text that is copied often is no boilerplate for that. A page
    counts a line once, however often it repeats there. Lines are counted as hashes, summed before they move, so a line
    that every page has is one row a task. A host's lines are bounded by the mean number on its pages divided by ratio.
    """
    pages = without_copies(docs).select(source_key(F.col("source")).alias("host"), F.col("text"))
    totals = materialize(pages.groupBy("host").agg(F.count("*").alias("pages")), "lines-hosts")
    marks = F.array_distinct(F.array_compact(F.transform(lines_of(F.col("text")), line_mark)))
    having = pages.select("host", F.explode(marks).alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    common = having.filter(F.col("n") >= least_pages).join(totals, "host").filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return materialize(slotted(materialize(common.select("host", "mark"), "lines-common")), "lines-boilerplate")


def slotted(common: DataFrame) -> DataFrame:
    """(host, slots) of distinct (host, mark): as many slots as the host has marks, a mark in the one of its remainder.

    Marks are hashes, so a slot holds about one of them, and a look-up costs the same whatever the number of marks.
    """
    sizes = common.groupBy("host").agg(F.count("*").alias("size"))
    filled = common.join(sizes, "host").groupBy("host", F.pmod("mark", "size").alias("slot")).agg(F.collect_list("mark").alias("marks"))
    every = sizes.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("slot"))
    rows = every.join(filled, ["host", "slot"], "left").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "marks"))).alias("rows"))
    return rows.select("host", F.transform("rows", lambda r: F.coalesce(r["marks"], F.array().cast("array<bigint>"))).alias("slots"))


def is_among(mark: Column, slots: Column) -> Column:
    """Whether a host's slots hold a mark; false for a null mark, or without slots."""
    slot = F.get(slots, F.pmod(mark, F.size(slots).cast("long")).cast("int"))
    return F.coalesce(F.array_contains(slot, mark), F.lit(False))


def dedup_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """docs with their texts less the boilerplate lines of their host (column source), and n_lines, n_dropped.

    Lines compare without white space at their ends; blank lines stay. A null text stays null and has no lines; null
    hosts are one host; a text that loses all its lines is empty. Rows of the same text stay and count as one page of
    their host. A host needs least_pages pages with a line before there is evidence against it. An empty table gives no
    rows; columns called n_lines or n_dropped are replaced, others are kept. The texts are not shuffled while the hosts'
    slots, whose stored size Spark knows, are small enough to broadcast; else Spark joins by host and splits hot ones.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lists = boilerplate(docs, ratio, least_pages).select(F.col("host").alias("_zw_host"), F.col("slots").alias("_zw_slots"))
    joined = docs.withColumn("_zw_host", source_key(F.col("source"))).join(lists, "_zw_host", "left")
    lines = lines_of(F.col("text"))
    stays = lambda x: ~is_among(line_mark(x), F.col("_zw_slots"))
    cut = joined.withColumn("_zw_lines", lines).withColumn("_zw_left", F.when(F.col("_zw_slots").isNull(), F.col("_zw_lines")).otherwise(F.filter("_zw_lines", stays)))
    is_text = F.col("text").isNotNull()
    n = lambda c: F.when(is_text, F.size(c)).otherwise(0).cast("long")
    text = F.when(is_text, F.array_join("_zw_left", "\n")).alias("text")
    return cut.select(*[text if c == "text" else F.col(c) for c in docs.columns], n("_zw_lines").alias("n_lines"), (n("_zw_lines") - n("_zw_left")).alias("n_dropped"))
