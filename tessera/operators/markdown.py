"""Markdown read once: every text becomes its tree of sections, each with its typed blocks, without a shuffle.

A fence hides headings, separators and page marks until the next fence, both styles alike. A heading closes its own level and deeper ones.
A block is a fence with all that is in it, a table, a list with its blank and indented lines, or a paragraph; a page mark ends a
paragraph, but neither a table nor a list; a separator alone on its line is a `break`. Headings deeper than `levels` are blocks of kind `heading`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import n_tokens

LEVELS = 6
SPACE = " \t\n\r\f\v"
CUT = "\n[…]"
BLOCK = "struct<kind:string,page:int,text:string>"
SECTIONS = f"array<struct<section:int,level:int,title:string,path:array<string>,ordinal:int,parent:int,parent_ordinal:int,last:int,body:string,first_page:int,last_page:int,n_lines:long,blocks:array<{BLOCK}>>>"

_FENCE = re.compile(r"\s*(?:```|~~~)")
_HEADING = re.compile(r"(#{1,6})[ \t\r\f\v]+(\S.*)", re.S | re.A)
_PAGE = re.compile(r"<!--\s*[Pp]age\s+(\d+)\s*-->\s*\Z", re.A)
_BREAK = re.compile(r"(?:---+|\*\*\*+|___+|<!-- chunk -->)\s*\Z", re.A)
_TABLE = re.compile(r"\s*\|", re.A)
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s", re.A)


class Blocks:
    """The blocks of one section, fed line by line."""

    def __init__(self, page: int | None):
        self.out: list[dict] = []
        self.page, self.kind, self.lines, self.begun = page, None, [], page

    def close(self) -> None:
        text = "\n".join(self.lines).strip(SPACE)
        if text:
            self.out.append({"kind": self.kind, "page": self.begun, "text": text})
        self.kind, self.lines = None, []

    def add(self, kind: str, line: str) -> None:
        if not self.lines:
            self.kind, self.begun = kind, self.page
        self.lines.append(line)

    def feed(self, line: str, kind: str) -> None:
        """kind: code, fence (closing line of a code block), open, page, break, blank, heading, table, list or text."""
        if kind == "open":
            self.close()
            self.add("code", line)
        elif kind in ("code", "fence"):
            self.add("code", line)
            if kind == "fence":
                self.close()
        elif kind == "page":
            if self.kind not in ("table", "list"):
                self.close()
        elif kind in ("break", "heading"):
            self.close()
            self.out.append({"kind": kind, "page": self.page, "text": line.strip(SPACE)})
        elif kind == "blank":
            if self.kind == "list":
                self.add("list", line)
            else:
                self.close()
        else:
            goes_on = self.kind == kind or (self.kind == "list" and line[0] in " \t")
            if self.kind and not goes_on:
                self.close()
            self.add(self.kind or kind, line)


def read_text(text: str, levels: int = LEVELS) -> list[dict]:
    """The sections of one text in reading order; section is the line of the heading, -1 for what stands before any."""
    out: list[dict] = []
    open_: list[dict] = []
    seen: dict[tuple, int] = {}
    blocks, page, inside = Blocks(None), None, False

    def begin(section: int, level: int, title: str | None) -> None:
        nonlocal blocks
        blocks.close()
        while open_ and open_[-1]["level"] >= level:
            open_.pop()
        up = open_[-1] if open_ else None
        path = [*(up["path"] if up else []), *([title] if level else [])]
        seen[tuple(path)] = seen.get(tuple(path), 0) + 1
        blocks = Blocks(page)
        row = {"section": section, "level": level, "title": title, "path": path, "ordinal": seen[tuple(path)], "parent": up["section"] if up else None, "parent_ordinal": up["ordinal"] if up else None, "body": [], "pages": [], "n_lines": 0, "blocks": blocks.out}
        out.append(row)
        if level:
            open_.append(row)
            for x in open_:
                x["last"] = section
        else:
            row["last"] = section

    for at, line in enumerate(text.split("\n")):
        fence, heading = _FENCE.match(line), None
        if inside:
            kind = "fence" if fence else "code"
        elif fence:
            kind = "open"
        elif mark := _PAGE.match(line):
            kind, page = "page", int(mark[1])
        elif heading := _HEADING.match(line):
            kind = "heading"
        elif _BREAK.match(line):
            kind = "break"
        elif not line.strip(SPACE):
            kind = "blank"
        else:
            kind = "table" if _TABLE.match(line) else "list" if _ITEM.match(line) else "text"
        inside = inside != bool(fence)
        if heading and len(heading[1]) <= levels:
            begin(at, len(heading[1]), heading[2].rstrip(SPACE))
        else:
            if not out:
                begin(-1, 0, None)
            out[-1]["body"].append(line)
            blocks.feed(line, kind)
            blocks.page = page
        out[-1]["n_lines"] += 1
        if page is not None:
            out[-1]["pages"].append(page)
    blocks.close()
    for row in out:
        pages = row.pop("pages")
        row["body"] = "\n".join(row["body"])
        row["first_page"], row["last_page"] = (min(pages), max(pages)) if pages else (None, None)
    return out


def outline(docs: DataFrame, key: str, text: Column, levels: int = LEVELS) -> DataFrame:
    """key, sections: one row a text, read where it lies. A null text is read as empty."""
    rows = docs.select(key, F.coalesce(text, F.lit("")).cast("binary").alias("__text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["sections"].dataType)
        for batch in batches:
            for i in range(batch.num_rows):  # a text at a time, so that memory holds one
                found = read_text(batch.column(1)[i].as_py().decode("utf-8", "replace"), levels)
                yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([found], kind)], names=[key, "sections"])

    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([docs.schema[key], StructField("sections", _parse_datatype_string(SECTIONS))])
    return rows.mapInArrow(run, schema)


def sections(docs: DataFrame, key: str, text: Column, levels: int = LEVELS) -> DataFrame:
    """One row per section with a heading or text: key and the fields of a section, depth being the length of its path."""
    return of_outline(outline(docs, key, text, levels), key)


def of_outline(outlined: DataFrame, key: str, *more: Column) -> DataFrame:
    """The sections of outline(), with the columns of more beside a document's first."""
    x = outlined.select(key, *more, F.posexplode("sections").alias("__i", "s"))
    return x.select(key, "s.*", *(F.when(F.col("__i") == 0, F.col(c)).alias(c) for c in x.columns[1:-2])).withColumn("depth", F.size("path"))


def render(of: DataFrame, key: str, most: int, text: str = "rendered") -> DataFrame:
    """Sections with the text of their subtree: headings and bodies in reading order, cut at `most` estimated tokens with a mark.

    Sections are numbered by nested intervals (section to last), and a subtree is a range of the reading order. Offsets of characters bound that
    range to what can still show, so a section gathers no more than its own cut text, however large its subtree is.
    """
    show = 4 * (most + 1)
    body = F.array_join(F.filter(F.split("body", "\n"), lambda x: ~x.rlike(r"\A<!--\s*[Pp]age\s+\d+\s*-->\s*\z")), "\n")
    body = F.regexp_replace(body, r"\A\s+|\s+\z", "")
    head = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))
    own = F.concat_ws("\n\n", head, F.when(body != "", body))
    order = Window.partitionBy(key).orderBy("section")
    x = of.withColumn("__own", own).withColumn("__size", F.length("__own") + 2)
    x = x.withColumn("__at", F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    near = Window.partitionBy(key).orderBy("__at").rangeBetween(Window.currentRow, show + 2)  # 2 for the line feeds before a section: what is left out lies behind `show` characters
    x = x.withColumn("__near", F.collect_list(F.struct("section", F.left("__own", F.lit(show)).alias("t"))).over(near))
    mine = F.filter("__near", lambda y: (y["section"] >= F.col("section")) & (y["section"] <= F.col("last")))
    whole = F.array_join(F.transform(F.array_sort(mine), lambda y: y["t"]), "\n\n")
    return x.withColumn(text, cut(whole, most)).drop("__own", "__size", "__at", "__near")


def cut(text: Column, most: int) -> Column:
    return F.when(n_tokens(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(4 * most)), F.lit(CUT)))


#: Request methods of HTTP.
METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS")


def endpoint(path: Column) -> Column:
    """The innermost open heading that is a request line: struct(method, path), or null."""
    words = lambda h: F.split(F.trim(h), r"\s+")
    names = F.filter(path, lambda h: (F.size(words(h)) == 2) & F.element_at(words(h), 1).isin(*METHODS) & F.element_at(words(h), -1).startswith("/"))
    last = F.try_element_at(names, F.lit(-1))
    return F.when(last.isNotNull(), F.struct(F.element_at(words(last), 1).alias("method"), F.element_at(words(last), -1).alias("path")))


def annotate(nodes: DataFrame, key: list[str], rules: DataFrame, resources: Sequence[tuple[str, str, str]], themes: list[str], default_theme: Column, corpus: Column) -> DataFrame:
    """Nodes (path array<string>) with method, endpoint, resource, chapter, kind, shared, theme and whether it is forced.

    rules as in rules.section_rules, against the own title first and then the whole breadcrumb, with slots theme, kind and shared; resources are rows (path or chapter,
    name, resource): the longest leading path of the endpoint decides, else the first title. Both are written lists, a few hundred rows long. A theme comes from a
    rule, then, if it is one of themes, from the path (forced) or the chapter (hinted), then from the default (hinted).
    """
    from .rules import section_rules

    targets = nodes.filter(F.size("path") > 0).select(*key, corpus.alias("corpus"), F.posexplode(F.array(F.element_at("path", -1), F.array_join("path", " > "))).alias("target_pos", "target"))
    found = section_rules(targets, key, rules).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("value", "hint")))).alias("__r"))
    names = lambda kind: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("resource")) for k, n, r in resources if k == kind))
    under = lambda r: (F.col("__e.path") == r["name"]) | F.col("__e.path").startswith(F.concat(r["name"], F.lit("/")))
    by_path = F.array_max(F.transform(F.filter(names("path"), under), lambda r: F.struct(F.length(r["name"]).alias("n"), r["resource"].alias("resource"))))["resource"]
    by_chapter = F.try_element_at(F.filter(names("chapter"), lambda r: r["name"] == F.try_element_at("path", F.lit(1))), F.lit(1))["resource"]
    x = nodes.withColumn("__e", endpoint(F.col("path"))).join(found, key, "left").withColumn("__p", by_path).withColumn("__c", by_chapter)
    slot = lambda s: F.try_element_at("__r", F.lit(s))
    known = lambda c: F.coalesce(F.col(c).isin(*themes), F.lit(False))
    rule = slot("theme")
    theme = F.when(rule.isNotNull(), rule["value"]).when(known("__p"), F.col("__p")).when(known("__c"), F.col("__c")).otherwise(default_theme)
    forced = F.when(rule.isNotNull(), ~rule["hint"]).otherwise(known("__p"))
    kind = F.coalesce(slot("kind")["value"], F.when(F.col("__e").isNotNull(), "endpoint"), F.when(F.size("path") == 0, "document"), F.lit("content"))
    return x.select(
        *nodes.columns, F.col("__e.method").alias("method"), F.col("__e.path").alias("endpoint"), F.coalesce("__p", "__c").alias("resource"),
        F.when(F.size("path") > 0, F.array_join(F.slice("path", 1, 2), " > ")).alias("chapter"), kind.alias("kind"),
        F.coalesce(slot("shared")["value"] == "true", F.lit(False)).alias("shared"), theme.alias("theme"), forced.alias("theme_forced"),
    )
