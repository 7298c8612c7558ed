"""Chunkers: line windows and Markdown sections as DataFrame plans.

Both take documents (doc, text[, path]) and give one row per chunk, with 1-based inclusive
lines.  Lines of a document never leave its row: windows and sections are cut with
higher-order functions, so chunking shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions.text import image_count, text_lines

# Lines per window, the text of a page of images alone, and the extensions of each chunker.
MAX_LINES, PDF_LINES, MIN_LINES = 60, 25, 4
EMPTY_PAGE = "[page {} has no extractable text, only images (a scanned page or a figure)]"
MARKDOWN = (".md", ".mdx", ".markdown")
CODE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx",
    ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".rb": "ruby",
}


def extension(path: Column) -> Column:
    """The last suffix of the file name, in lower case; '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1))


def dispatch(path: Column) -> Column:
    """Which chunker a path goes to: pdf, markdown, code or text."""
    ext = extension(path)
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*CODE), "code").otherwise("text")


def windows(first: Column, last: Column, size: int = MAX_LINES) -> Column:
    """array<struct<s, e>>: the lines first..last (0-based, inclusive) tiled by windows of size lines."""
    starts = F.when(last >= first, F.sequence(first, last, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + (size - 1), last).alias("e")))


def section_starts(lines: Column) -> Column:
    """0-based first lines of sections: line 0 and every heading outside fences.

    A line that opens with a fence marker toggles the fence.  The lines between fence lines
    are the odd and even pieces of the text cut at those lines, so one pass marks the headings
    of the pieces outside, however many there are.
    """
    pieces = F.split(F.array_join(lines, "\n"), r"(?dm)^[\x20\t]*(?:```|~~~)[^\n]*", -1)

    def heads(piece: Column, i: Column) -> Column:
        # the last entry of a piece is the fence line after it, which the next piece begins with again
        own = F.transform(F.split(piece, "\n", -1), lambda x: x.startswith("#") & (i % 2 == 0))
        return F.when(i == 0, own).otherwise(F.slice(own, 2, F.size(own)))

    flags = F.flatten(F.transform(pieces, heads))
    found = F.filter(F.transform(flags, lambda head, at: F.when(head & (at > 0), at)), lambda at: at.isNotNull())
    return F.concat(F.array(F.lit(0)), found)


def _emit(docs: DataFrame, spans: Column, kind: str) -> DataFrame:
    """One row per span that has a non-blank line."""
    keep = [c for c in docs.columns if c not in ("text", "_lines")]
    rows = docs.select(*keep, "_lines", F.explode(spans).alias("_w"))
    body = F.array_join(F.slice("_lines", F.col("_w.s") + 1, F.col("_w.e") - F.col("_w.s") + 1), "\n")
    out = rows.select(*keep, (F.col("_w.s") + 1).alias("line_start"), (F.col("_w.e") + 1).alias("line_end"), F.lit(kind).alias("kind"), body.alias("text"))
    return out.filter(F.col("text").rlike(r"\S")).withColumn("images", image_count(F.col("text")))


def line_windows(docs: DataFrame, size: int = MAX_LINES, kind: str = "text") -> DataFrame:
    """Fixed windows without overlap; blank chunks are dropped; an empty text has none."""
    lined = docs.withColumn("_lines", text_lines(F.col("text")))
    return _emit(lined, windows(F.lit(0), F.size("_lines") - 1, size), kind)


def markdown_sections(docs: DataFrame, size: int = MAX_LINES) -> DataFrame:
    """Sections from heading to heading, long ones in windows."""
    lined = docs.withColumn("_lines", text_lines(F.col("text")))
    starts = section_starts(F.col("_lines"))
    ends = F.concat(F.slice(starts, 2, F.size("_lines") + 1), F.array(F.size("_lines")))
    spans = F.flatten(F.zip_with(starts, ends, lambda a, b: windows(a, b - 1, size)))
    return _emit(lined, F.when(F.size("_lines") > 0, spans).otherwise(F.array().cast("array<struct<s:int,e:int>>")), "section")


def pdf_pages(pages: DataFrame, size: int = PDF_LINES) -> DataFrame:
    """Chunks of extracted pages (path, page, text, n_images): the page is the line range; a page of images alone gets a placeholder."""
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    note = F.format_string(EMPTY_PAGE.replace("{}", "%s"), F.col("page"))
    filled = pages.withColumn("text", F.when(blank & (F.col("n_images") > 0), note).otherwise(F.coalesce("text", F.lit(""))))
    out = line_windows(filled, size, "pdf_page")
    return out.select("path", F.col("page").alias("line_start"), F.col("page").alias("line_end"), "kind", "text", F.col("n_images").alias("images"))
