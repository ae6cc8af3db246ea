"""Markdown as tables: lines with fence, page and heading state, packed chunks and the node tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hard_split, n_tokens, token_tail, uuid5
from .markdown import LEVELS, cut, of_outline, outline, render

#: The namespace of node ids: a fixed value of this library.
NAMESPACE = "5b0f1a52-6c1e-4f0c-9d8e-2b7f3c9a1d40"
SEPARATOR = "\x1f"


def lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, line, in_code, level (null for no heading), title, page, section (pos of the innermost open heading, -1 before any), path (titles of open headings).

    Fences toggle, both styles alike; page markers set the page of what follows; a heading closes its own level and deeper ones.
    """
    x = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    x = x.withColumn("fence", fence).withColumn("in_code", (F.sum(F.col("fence").cast("int")).over(w) % 2 == 1) | F.col("fence"))
    marks = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    x = x.withColumn("level", F.when(~F.col("in_code") & (marks != ""), F.length(marks)))
    x = x.withColumn("title", F.when(F.col("level").isNotNull(), F.regexp_replace("line", r"^#{1,6}\s+|\s+$", "")))
    page = F.regexp_extract("line", r"^<!--\s*[Pp]age\s+(\d+)\s*-->\s*$", 1)
    x = x.withColumn("page", F.last(F.when((page != "") & ~F.col("in_code"), page.cast("int")), ignorenulls=True).over(w))
    for k in range(1, LEVELS + 1):
        x = x.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(w))
    newest = F.lit(-1)
    for k in range(1, LEVELS + 1):  # a heading stays open unless a shallower one came later
        own = F.coalesce(F.col(f"h{k}.pos"), F.lit(-1))
        x = x.withColumn(f"o{k}", F.when(own > newest, F.col(f"h{k}.title")))
        newest = F.greatest(newest, own)
    path = F.filter(F.array(*(F.col(f"o{k}") for k in range(1, LEVELS + 1))), lambda t: t.isNotNull())
    return x.select(key, "pos", "line", "in_code", "level", "title", "page", newest.alias("section"), path.alias("path"))


def cut_block(text: Column, most: int) -> Column:
    """A block over `most` tokens as runs of whole lines; a line over `most` in pieces of its own."""
    small = lambda t: n_tokens(t) <= most
    empty = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<string>").alias("out"))
    flushed = lambda acc: F.when(acc["now"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["now"]))

    def step(acc: Column, line: Column) -> Column:
        joined = F.concat(acc["now"], F.lit("\n"), line)
        grows = acc["now"].isNotNull() & small(joined)
        return F.when(~small(line), F.struct(F.lit(None).cast("string").alias("now"), F.concat(flushed(acc), hard_split(line, most)).alias("out"))).otherwise(
            F.struct(F.when(grows, joined).otherwise(line).alias("now"), F.when(grows, acc["out"]).otherwise(flushed(acc)).alias("out"))
        )

    return F.when(small(text), F.array(text)).otherwise(F.filter(F.aggregate(F.split(text, "\n"), empty, step, flushed), lambda t: F.trim(t) != ""))


def cut_blocks(blocks: Column, most: int) -> Column:
    """Blocks (kind, page, text) none of which is over `most` tokens."""
    return F.flatten(F.transform(blocks, lambda b: F.transform(cut_block(b["text"], most), lambda t: F.struct(b["kind"].alias("kind"), b["page"].alias("page"), t.alias("text")))))


def pack(blocks: Column, most: int, overlap: int) -> Column:
    """Chunks (text, first_page, last_page) of blocks put together up to `most` tokens, a blank line between them.

    A full chunk hands on as many of its last blocks as have `overlap` tokens, or that much of the end of its last block, unless that leaves no room for the next
    block; a `break` hands on nothing. A chunk that is a heading alone is left out. One row-local fold: its state is the queue of the blocks now open; chunks are copied only when one is added.
    """
    piece = "struct<page:int,text:string>"
    chunk = lambda q: F.struct(_joined(q).alias("text"), F.array_min(_pages(q)).alias("first_page"), F.array_max(_pages(q)).alias("last_page"))
    none = F.array().cast(f"array<{piece}>")
    empty = F.struct(none.alias("now"), F.array().cast("array<struct<text:string,first_page:int,last_page:int>>").alias("out"))
    flushed = lambda acc: F.when(F.size(acc["now"]) == 0, acc["out"]).otherwise(F.array_append(acc["out"], chunk(acc["now"])))

    def carried(q: Column) -> Column:
        n = F.size(F.filter(F.sequence(F.lit(1), F.size(q)), lambda k: F.floor(F.length(_joined(F.slice(q, -k, k))) / 4) <= overlap))
        last = F.element_at(q, -1)
        tail = F.array(F.struct(last["page"].alias("page"), token_tail(last["text"], overlap).alias("text")))
        return F.when(n > 0, F.slice(q, -n, n)).otherwise(tail) if overlap else none

    def step(acc: Column, b: Column) -> Column:
        own = F.array(F.struct(b["page"].alias("page"), b["text"].alias("text")))
        fits = lambda q: n_tokens(_joined(F.concat(q, own))) <= most
        fresh = F.when(fits(carried(acc["now"])), F.concat(carried(acc["now"]), own)).otherwise(own)
        grows = (F.size(acc["now"]) == 0) | fits(acc["now"])
        return F.when(b["kind"] == "break", F.struct(none.alias("now"), flushed(acc).alias("out"))).otherwise(
            F.struct(F.when(grows, F.concat(acc["now"], own)).otherwise(fresh).alias("now"), F.when(grows, acc["out"]).otherwise(flushed(acc)).alias("out"))
        )

    return F.filter(F.aggregate(blocks, empty, step, flushed), lambda c: ~c["text"].rlike(r"\A\s*#{1,6}\s+[^\n]*\s*\z"))


def _joined(q: Column) -> Column:
    return F.array_join(F.transform(q, lambda b: b["text"]), "\n\n")


def _pages(q: Column) -> Column:
    return F.transform(q, lambda b: b["page"])


def chain(leaves: DataFrame, key: str, order: list[str], node: str = "node_id") -> DataFrame:
    """Reading order: previous and next leaf and position in the document; position and number in the section."""
    w, s = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, "section")
    return (
        leaves.withColumn("prev_id", F.lag(node).over(w)).withColumn("next_id", F.lead(node).over(w)).withColumn("position", F.row_number().over(w) - 1)
        .withColumn("in_section", F.row_number().over(s.orderBy(*order)) - 1).withColumn("of_section", F.count(F.lit(1)).over(s))
    )


def node_id(key: Column, level: str, path: Column, *ordinals: Column) -> Column:
    """Ids hold the section's ordinal, so equal paths of one document stay apart."""
    return uuid5(F.concat_ws(SEPARATOR, key.cast("string"), F.lit(level), F.array_join(path, SEPARATOR), *(o.cast("string") for o in ordinals)), NAMESPACE)


def tree(docs: DataFrame, key: str, text: Column, most: int = 200, overlap: int = 20, show: int = 700) -> DataFrame:
    """document, section and chunk nodes: node_id, level, parent_id, root_id, prev_id, next_id, position, path, text, token_count, first_page, last_page.

    A section's text is its whole subtree, a document's its introduction and outline, both cut at `show` tokens. A text without
    headings is one section without a title. Every section makes its own nodes, so texts are read once and shuffled once.
    """
    line = lambda x: F.concat(F.repeat(F.lit("  "), F.size(x["path"]) - 1), F.lit("- "), x["title"])
    plan = F.array_join(F.transform(F.filter("sections", lambda x: x["level"] > 0), line), "\n")
    s = render(of_outline(outline(docs, key, text), key, cut(plan, show).alias("plan")), key, show)
    none = F.array().cast("array<string>")
    root = node_id(F.col(key), "document", none)
    up = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    own = F.when(F.col("depth") > 0, node_id(F.col(key), "section", F.col("path"), F.col("ordinal"))).otherwise(root)
    s = s.withColumn("root_id", root).withColumn("own_id", own).withColumn("up_id", F.when(F.col("parent").isNull(), root).otherwise(node_id(F.col(key), "section", up, F.col("parent_ordinal"))))
    pages = [F.col(c) for c in ("first_page", "last_page")]
    node = lambda level, at, parent, path, t, first, last: F.struct(F.lit(level).alias("level"), at.cast("int").alias("at"), parent.alias("parent_id"), path.alias("path"), t.alias("text"), first.alias("first_page"), last.alias("last_page"))
    chunks = F.transform(pack(cut_blocks(F.col("blocks"), most), most, overlap), lambda c, i: node("chunk", i, F.col("own_id"), F.col("path"), c["text"], c["first_page"], c["last_page"]))
    section = F.when(F.col("depth") > 0, F.array(node("section", F.lit(0), F.col("up_id"), F.col("path"), F.col("rendered"), *pages)))
    whole = cut(F.concat_ws("\n\n", F.when((F.col("depth") == 0) & (F.col("rendered") != ""), F.col("rendered")), F.when(F.col("plan") != "", F.col("plan"))), show)
    all_pages = Window.partitionBy(key)
    document = F.when(F.col("plan").isNotNull(), F.array(node("document", F.lit(0), F.lit(None).cast("string"), none, whole, F.col("__first"), F.col("__last"))))
    s = s.withColumn("__first", F.min("first_page").over(all_pages)).withColumn("__last", F.max("last_page").over(all_pages))
    x = s.select(key, "section", "ordinal", "root_id", "own_id", F.explode(F.flatten(F.array_compact(F.array(document, section, chunks)))).alias("n")).select("*", "n.*")
    ids = F.when(F.col("level") == "document", F.col("root_id")).when(F.col("level") == "section", F.col("own_id")).otherwise(node_id(F.col(key), "chunk", F.col("path"), F.col("ordinal"), F.col("at")))
    w = Window.partitionBy(key, "level").orderBy("section", "at")
    leaf = lambda c: F.when(F.col("level") == "chunk", c)
    x = x.withColumn("node_id", ids).withColumn("prev_id", leaf(F.lag("node_id").over(w))).withColumn("next_id", leaf(F.lead("node_id").over(w)))
    x = x.withColumn("position", leaf(F.row_number().over(w) - 1))
    position = F.coalesce("position", F.when(F.col("level") == "section", F.col("section")), F.lit(0))
    return x.select(key, "node_id", "level", "parent_id", "root_id", "prev_id", "next_id", position.alias("position"), "path", "text", "first_page", "last_page", n_tokens(F.col("text")).alias("token_count"))


def within_parent(chunk: Column, parent: Column, probe: int = 150) -> Column:
    """Whether both ends of a chunk occur in its parent, white space aside."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    c, p = flat(chunk), flat(parent)
    return F.contains(p, F.left(c, F.lit(probe))) & F.contains(p, F.right(c, F.lit(probe)))


def blank_code(text: Column) -> Column:
    """A text without its fenced code and code spans."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
