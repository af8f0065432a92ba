"""Line dedup by log templates: a fixed-depth tree finds lines that recur across documents.

A line becomes words; words with a digit are variable fields (``<*>``). The tree's levels are the
number of words and the first LEADING words; a leaf holds the lines that agree in
them. In a leaf a word is constant at its place if enough of the leaf's lines have it there, and
a variable field if not: a line's template is its constant words with ``<*>`` in the other
places. A template with a sufficient share of constant words that stands in at
least MIN_DOCS documents recurs, and its lines are dropped, all of them, from every document.

    templates(lines(docs)) -> leaf, line: the lines (by hash) whose template recurs
    dropped(docs)          -> doc_id, text_hash, n_lines, dropped (places of its dropped lines)
    cleaned(docs)          -> the documents without those lines

Lines that by themselves stand in MIN_DOCS documents are their own recurring templates;
only the others of leaves with enough documents are taken apart into words. The corpus is cut and masked
once; what follows works on stored hashes, and reads a line's text again only where its leaf is open.
Everything is DataFrame expressions and partially aggregated joins (common.by_key), so neither a leaf's
lines nor the copies of a line meet in one task, whatever share of the corpus they are.

Copies of a document make each of its lines recur, so this runs after document dedup.

Edge cases: null or empty texts have no lines and stay as they are; lines without a word are kept
and not counted; a document counts once for a template however often it repeats it;
equal rows are one document here, and get equal results; a null doc_id is an id; an empty table gives no rows; texts and lines
of any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common

LEADING, MIN_DOCS, CONSTANT_SHARE = 3, 3, 0.6


def lines(docs: DataFrame, leading: int = LEADING) -> DataFrame:
    """doc_id, text_hash, at, leaf, line (hashes), masked: every line with a word, its words parted by one space each."""
    cut = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "l"))
    # patterns run over the lines that need them only
    spaced = F.trim(F.when(F.col("l").rlike(r"[\x09-\x0D]"), F.regexp_replace("l", r"[\x09-\x0D]+", " ")).otherwise(F.col("l")))
    cut = cut.select("doc_id", "text_hash", "at", spaced.alias("l"))
    single = F.when(F.contains("l", F.lit("  ")), F.regexp_replace("l", " +", " ")).otherwise(F.col("l"))
    cut = cut.filter("l <> ''").select("doc_id", "text_hash", "at", single.alias("l"))
    masked = F.when(F.col("l").rlike("[0-9]"), F.regexp_replace("l", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(F.col("l"))
    cut = cut.select("doc_id", "text_hash", "at", masked.alias("masked"))
    count = "octet_length(masked) - octet_length(replace(masked, ' ', ''))"
    return cut.selectExpr("doc_id", "text_hash", "at", f"xxhash64({count}, substring_index(masked, ' ', {leading})) as leaf", "xxhash64(masked) as line", "masked")


def templates(rows: DataFrame, min_docs: int = MIN_DOCS, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """leaf, line, n (its rows): the lines whose template recurs. rows: lines(docs), stored."""
    total = rows.count()
    # a document's copies of a line first, so that a frequent line is counted in parts
    seen = rows.groupBy("leaf", "line", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    counts = common.stored(seen.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.sum("n").alias("n")), "lines")
    recurring = counts.filter(F.col("docs") >= min_docs).select("leaf", "line", "n")
    # lines that don't recur as they are, in leaves with enough documents
    leaves = counts.groupBy("leaf").agg(F.sum("docs").alias("held"), F.min("docs").alias("least"), F.sum("n").alias("n"))
    leaves = common.stored(leaves.filter((F.col("held") >= min_docs) & (F.col("least") < min_docs)).select("leaf", "n"), "lines")
    open_ = common.by_key(rows.select("leaf", "line", "masked"), leaves, ["leaf"], total, "left_semi").groupBy("leaf", "line").agg(F.first("masked").alias("masked"))
    counted = common.stored(open_.join(counts, ["leaf", "line"]), "lines")
    words = common.stored(counted.select("leaf", "line", "docs", "n", F.posexplode(F.split("masked", " ")).alias("place", "word")).withColumn("word", F.xxhash64("word")), "lines")
    support = words.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("support"), F.count("*").alias("n"))
    constant = common.stored(support.filter(F.col("support") >= min_docs).select("leaf", "place", "word", "n", F.lit(True).alias("constant")), "lines")
    wanted = words.filter(F.col("docs") < min_docs).withColumnRenamed("n", "rows")
    wanted = common.by_key(wanted, constant, ["leaf", "place", "word"], words.count(), "left")
    # places differ within a line, so the hashes of its constant words tell the set of them
    template = wanted.groupBy("leaf", "line").agg(
        F.count("*").alias("words"), F.count("constant").alias("fixed"), F.max("rows").alias("n"),
        F.expr("bit_xor(if(constant, xxhash64(place, word), 0L))").alias("constants"),
    )
    template = template.filter(F.col("fixed") >= constant_share * F.col("words")).selectExpr("leaf", "line", "n", "xxhash64(leaf, constants) as template")
    template = common.stored(template, "lines")
    stands = common.by_key(rows.select("leaf", "line", "doc_id", "text_hash"), template, ["leaf", "line"], total)
    docs = stands.select("template", "doc_id", "text_hash").distinct().groupBy("template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    held = common.stored(template.groupBy("template").agg(F.count("*").alias("n")).join(docs, "template").select("template", "n"), "lines")
    return recurring.unionByName(common.by_key(template.withColumnRenamed("n", "rows"), held, ["template"], template.count(), "left_semi").select("leaf", "line", F.col("rows").alias("n")))


def dropped(docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """doc_id, text_hash, dropped: the places of the dropped lines, for documents that lose some."""
    rows = common.stored(lines(docs, leading), "lines")
    found = common.stored(templates(rows, min_docs, constant_share), "templates")
    hit = common.by_key(rows.select("doc_id", "text_hash", "at", "leaf", "line"), found, ["leaf", "line"], rows.count(), "left_semi")
    return hit.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def cleaned(docs: DataFrame, leading: int = LEADING, min_docs: int = MIN_DOCS, constant_share: float = CONSTANT_SHARE) -> DataFrame:
    """The documents with the columns they came with, text without its dropped lines, and n_lines and n_dropped (lines with a word) after them, in place of columns of these names."""
    gone = dropped(docs, leading, min_docs, constant_share).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select("row", F.col("row.doc_id").alias("_doc"), F.xxhash64("row.text").alias("_text"))
    joined = rows.join(gone, rows._doc.eqNullSafe(gone._id) & (rows._text == gone._hash), "left")
    some = joined.withColumn("_l", F.expr("if(dropped is null, null, split(row.text, '\n'))"))
    kept = "if(dropped is null, row.text, array_join(transform(array_except(sequence(0, size(_l) - 1), dropped), i -> get(_l, i)), '\n'))"
    counts = {"n_lines": F.expr(r"size(filter(split(coalesce(row.text, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]'))").cast("long"), "n_dropped": F.expr("if(dropped is null, 0, size(dropped))").cast("long")}
    return some.select(F.col("row").withField("text", F.expr(kept)).alias("row"), *[v.alias(k) for k, v in counts.items()]).select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in counts], *counts)
