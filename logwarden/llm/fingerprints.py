"""Document fingerprints from closed syncmers, in DataFrame functions only.

Words are hashed; an s-mer is two words in a row, a k-mer is six. A k-mer is a closed syncmer when the
smallest hash among its five s-mers is the first or the last one. Whether it is chosen depends on its own
words alone, so equal passages keep equal anchors wherever they stand. All anchors are kept: two texts are as
alike as the share of the anchors of both that both hold.

The fingerprint is all anchors as 32-bit numbers, in text order. A text of fewer than 16 anchors holds its words
beside them; when one of two such texts has fewer than four anchors, words are compared with words. Likeness
follows from the fingerprints as they are returned. A text without words has the empty fingerprint. Letter case
and white space do not count. Equal texts have likeness 1, an empty one against any other 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm.common import id_and_text
from logwarden.session import stage

#: Words of a k-mer and of an s-mer.
K, S = 6, 2
#: A text with fewer anchors holds its words too; one with fewer than ``LEAST`` is compared by them.
HELD, LEAST = 16, 4
#: Documents next to each other in ``doc_id`` that one window group holds at most, when ids are distinct.
ID_BLOCK = 8_192


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the array of anchor hashes and, as ``{out}_words``, that of word hashes; distinct and in text order.

    Each step is a column of its own, so no step is computed twice.
    """
    hashes, pairs, chosen = f"{out}__words", f"{out}__pairs", f"{out}__chosen"
    step = df.withColumn(
        hashes,
        F.transform(
            F.filter(F.split(F.lower(F.col(text)), "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w)
        ),
    )
    step = step.withColumn(
        pairs,
        F.expr(f"zip_with({hashes}, slice({hashes}, 2, greatest(size({hashes}) - 1, 0)), (a, b) -> xxhash64(a, b))"),
    )
    # The window of s-mers i .. i+4 is read by position; the sixth word ends s-mer i+4.
    closed = f"""
        filter(
            transform(
                sequence(0, size({hashes}) - {K}),
                i -> if(
                    least({pairs}[i], {pairs}[i + 4]) <= least({pairs}[i + 1], {pairs}[i + 2], {pairs}[i + 3]),
                    xxhash64({pairs}[i], {pairs}[i + 2], {pairs}[i + 4]),
                    null
                )
            ),
            x -> x is not null
        )
    """
    step = step.withColumn(chosen, F.expr(f"if(size({hashes}) < {K}, array(), {closed})"))
    step = step.withColumn(out, F.array_distinct(chosen)).withColumn(f"{out}_words", F.array_distinct(hashes))
    return step.drop(hashes, pairs, chosen)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add a text's fingerprint: ``out``, its anchors as 32-bit numbers, and ``{out}_words``, its words alike.

    Words are held by texts of fewer than ``HELD`` anchors only, else null. Both are distinct and in text order.
    """
    step = with_anchors(df, text, out)
    short = lambda c: F.array_distinct(F.transform(c, lambda x: F.shiftrightunsigned(x, 32)))
    words = F.when(F.size(out) < HELD, short(F.col(f"{out}_words")))
    return step.withColumn(f"{out}_words", words).withColumn(out, short(F.col(out)))


def fingerprint_text(fingerprint: str) -> Column:
    """Eight hex digits for each anchor; where words are held, a colon and eight for each word."""
    digits = lambda c: F.concat_ws("", F.transform(c, lambda x: F.lpad(F.hex(x), 8, "0")))
    words = F.col(f"{fingerprint}_words")
    return F.concat(digits(F.col(fingerprint)), F.when(words.isNull() | (F.size(words) == 0), "").otherwise(F.concat(F.lit(":"), digits(words))))


def _shared(a: str, b: str) -> Column:
    """Share of the values of two arrays of distinct values that both hold; 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)), F.lit(1.0))


def likeness(a: str, b: str) -> Column:
    """Share of the anchors of two fingerprints that both hold, 0 to 1.

    If either has fewer than ``LEAST`` and both hold words, the share of words. So it follows from the
    fingerprints alone, and two short texts are compared by words also when one has a few anchors more.
    """
    few = (F.size(a) < LEAST) | (F.size(b) < LEAST)
    by_words = few & F.col(f"{a}_words").isNotNull() & F.col(f"{b}_words").isNotNull()
    return F.when(by_words, _shared(f"{a}_words", f"{b}_words")).otherwise(_shared(a, b))


def anchor_positions(docs: DataFrame) -> DataFrame:
    """``doc_id, anchor, place``: all anchors and their order, for positional matching by a join.

    A text with few anchors holds its words after them, so that it meets other short texts too.
    """
    marked = with_anchors(id_and_text(docs), "text", "anchors")
    own = F.when(F.size("anchors") >= LEAST, F.col("anchors")).otherwise(F.concat("anchors", "anchors_words"))
    return marked.select("doc_id", F.posexplode(own).alias("place", "anchor"))


def _placed(rows: DataFrame) -> DataFrame:
    """Add ``place``, the id with null as the least long, and its ``block`` of ``ID_BLOCK`` ids."""
    return rows.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn(
        "block", F.expr(f"place div {ID_BLOCK} - if(place < 0, 1, 0)")
    )


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``next_text``: the next document by descending id, cyclic.

    Blocks of ids are window groups. What follows the lowest document of a block is the highest one of
    the next block below that has any; these heads are one row per block. Equal ids follow each other by
    text; a null id counts as the least. Only texts are exchanged; anchors are made after.
    """
    rows = _placed(id_and_text(docs))
    order = Window.partitionBy("block").orderBy(F.col("place").desc(), F.xxhash64("text"), "text")
    following = F.lead("text").over(order)

    tops = _placed(id_and_text(docs).select("doc_id")).groupBy("block").agg(F.max("place").alias("top"))
    below = Window.orderBy(F.col("block").desc())
    whole = below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = tops.select(
        "block", F.coalesce(F.lead("top").over(below), F.first("top").over(whole)).alias("top")
    )
    # Written, so that Spark knows its size before it plans the join: a small one spares a shuffle of all texts.
    heads = stage(heads, "heads")
    texts = (
        _placed(id_and_text(docs)).withColumnRenamed("place", "top")
        .join(heads.select("top"), "top")
        .groupBy("top").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
        .select("top", F.col("first.text").alias("head_text"))
    )
    heads = heads.join(texts, "top").drop("top")
    linked = rows.withColumn("following", following).join(heads, "block")
    return linked.select("doc_id", "text", F.coalesce("following", "head_text").alias("next_text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike they are.

    The edited text has its last half (rounded down, in code points) replaced by as much of the start of
    the next document, or all of it. Each input row gives one row; null texts are empty.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    step = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    )
    for text, out in (("text", "fp"), ("next_text", "next_fp"), ("edited", "edited_fp")):
        step = with_fingerprint(step, text, out)
    return step.select(
        "doc_id", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text("fp").alias("fingerprint"), fingerprint_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
