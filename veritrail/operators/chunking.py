"""Résumé texts to sections and bounded chunks, in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import section_heading, strip

#: Most and least characters of a chunk, and most chunks by the prefix of their ids.
MOST, LEAST, CAPS = 1200, 40, {"c": 200, "cl": 100}
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sections(pages: DataFrame, id: str = "resume_id") -> DataFrame:
    """id, at, section, page, body: lines between headings; what stands before the first heading is 'other'.

    pages: id, page_no, text.  A heading's line belongs to no section.
    """
    lines = pages.select(id, "page_no", F.posexplode(F.split("text", LINE_END)).alias("line_no", "line"))
    by = Window.partitionBy(id).orderBy("page_no", "line_no")
    marked = lines.withColumn("heading", section_heading(F.col("line")))
    marked = marked.withColumn("at", F.count("heading").over(by))
    head = F.struct(F.col("heading").alias("section"), F.col("page_no").alias("page"))
    grouped = marked.groupBy(id, "at").agg(
        F.max(F.when(F.col("heading").isNotNull(), head)).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("page_no", "line_no", "line")))).alias("lines"),
    )
    body = strip(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return grouped.select(id, "at", F.coalesce("head.section", F.lit("other")).alias("section"), F.coalesce("head.page", F.lit(0)).alias("page"), body.alias("body")).where("body <> ''")


def packed(lengths: Column, gap: int, reopened: int) -> Column:
    """The number, from 1, of the pack that each of some texts goes to, by their lengths.

    A text costs its length and the gap behind it; a pack is full when the next cost would lift it above MOST.  The text
    that opens a pack after a full one costs `reopened` in place of the gap.  Texts longer than MOST stand alone.
    """
    n0 = F.lit(0)

    def step(pack: Column, n: Column) -> Column:
        alone, full = n > MOST, pack["held"] + n + gap > MOST
        number = pack["number"] + (alone | full | (pack["held"] == 0)).cast("int")
        held = F.when(alone, n0).when(full, n + reopened).otherwise(pack["held"] + n + gap)
        return F.struct(number.alias("number"), held.alias("held"), F.concat(pack["numbers"], F.array(number)).alias("numbers"))

    start = F.struct(n0.alias("number"), n0.alias("held"), F.array().cast("array<int>").alias("numbers"))
    return F.aggregate(lengths, start, step, lambda pack: pack["numbers"])


def chunks(pages: DataFrame, id: str = "resume_id", prefix: str = "c") -> DataFrame:
    """id, chunk_id, section, page, text: chunks of 40 to 1200 characters, numbered from 1, capped per résumé.

    Paragraphs are packed; a paragraph that is too long is packed sentence by sentence, a sentence that is too long cut.
    """
    good = lambda a: F.filter(a, lambda t: t != "")
    sizes = lambda a: F.transform(a, lambda t: F.length(t))
    rows = sections(pages, id).withColumn("texts", good(F.transform(F.split("body", r"(?U)\n\s*\n+"), strip)))
    rows = rows.withColumn("packs", packed(sizes(F.col("texts")), 2, 0))
    rows = rows.select(id, "at", "section", "page", F.posexplode(F.arrays_zip("texts", "packs")).alias("paragraph", "x"))
    rows = rows.select(id, "at", "section", "page", "paragraph", F.col("x.texts").alias("text"), F.col("x.packs").alias("pack"))
    long = F.length("text") > MOST
    rows = rows.withColumn("texts", F.when(long, good(F.split("text", r"(?U)(?<=[.!?])\s+"))).otherwise(F.array("text")))
    rows = rows.withColumn("packs", F.when(long, packed(sizes(F.col("texts")), 1, 1)).otherwise(F.array(F.lit(0))))
    rows = rows.select(id, "at", "section", "page", "paragraph", "pack", F.posexplode(F.arrays_zip("texts", "packs")).alias("sentence", "x"))
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("x.texts") / MOST).cast("int") - 1))).alias("cut")
    rows = rows.select(id, "at", "section", "page", "paragraph", "pack", "sentence", F.col("x.texts").alias("text"), F.col("x.packs").alias("part"), cut)
    piece = F.struct("paragraph", "sentence", F.substring(F.col("text"), F.col("cut") * MOST + 1, F.lit(MOST)).alias("text"))
    packs = rows.groupBy(id, "at", "pack", "part", "cut").agg(F.first("section").alias("section"), F.first("page").alias("page"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    pieces = F.transform("pieces", lambda p: p["text"])
    text = strip(F.when(F.col("part") > 0, F.array_join(pieces, " ")).otherwise(F.array_join(pieces, "\n\n")))
    whole = packs.withColumn("text", text).where(F.length("text") >= LEAST)
    numbered = whole.withColumn("n", F.row_number().over(Window.partitionBy(id).orderBy("at", "pack", "part", "cut")))
    return numbered.where(F.col("n") <= CAPS.get(prefix, 200)).select(id, F.format_string(f"{prefix}_%03d", "n").alias("chunk_id"), "section", "page", "text")


def chunk_texts(chunks_: Column, cover: Column) -> Column:
    """The chunks of a résumé and of its cover letter by id (map<string,string>); the cover letter's win."""
    from .redaction import overlay

    by_id = lambda rows: F.map_from_entries(F.transform(F.array_distinct(F.transform(F.filter(rows, lambda c: c["id"].isNotNull()), lambda c: c["id"])), lambda i: F.struct(i.alias("key"), F.element_at(F.filter(rows, lambda c: c["id"] == i), -1)["text"].alias("value"))))
    return overlay(by_id(chunks_), by_id(cover))
