"""Structure of legal, order, judicial and data documents, as rows; each is a scan without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .sections import order_part, pack_parts, split_at

# Fixed values.
JUDICIAL_HEADINGS = r"(?i)\b(?:facts of the case|facts|issues|arguments|held|judgment|order|conclusion|ratio)\s*:"
CHAPTER_HEADING = r"(?i)Chapter\s+(?:[IVX]+|\d+)[^\n]*"
LEGAL_HEADING = r"(?i)(?:Section|Article)\s+\d+(?:\([a-z]\))?[^\n]*"
SUBSECTION = r"(?m)^\s*\((?:[a-z]|i{1,3}|[0-9]+)\)\s*[^\n]+"
HOLDING = r"(?i)[^.!?]*\b(?:held|observed|ruled|decided|concluded)\b[^.!?]*[.!?]"
SUMMARY = r"(?i)[^.!?]*\b(?:total|average|percentage|increase|decrease|shows)\b[^.!?]*[.!?]"
TABLE_LINE = r"\d.*\s.*\d"
REFERENCES = (r"(?i)Section\s+(\d+(?:\([a-z]\))?)", r"(?i)Article\s+(\d+)", r"(?i)Rule\s+(\d+)", r"(?i)G\.?O\.?\s*(?:Ms\.?|Rt\.?)?\s*No\.?\s*(\d+)", r"(?i)Chapter\s+(\d+)", r"(?i)clause\s+\(([a-z])\)", r"(?i)sub-section\s+\((\d+)\)")


def sentences(text: Column, pattern: str) -> Column:
    """What ``SUMMARY`` or ``HOLDING`` finds: the sentences with one of its words, each looked at once, where the pattern itself tries every place of a sentence."""
    word = pattern.removeprefix("(?i)[^.!?]*").removesuffix("[^.!?]*[.!?]")
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?]*+(?:[.!?]|\z)"), F.lit(0)), lambda x: x.rlike(r"[.!?]\z") & x.rlike("(?i)" + word))


def titled_sections(df: DataFrame, id_col: str, text_col: str, heading: str) -> DataFrame:
    """(id, position, title, text) from one heading to the next; the whole text where there is none."""
    s = split_at(F.col(text_col), heading)
    whole = F.array(F.struct(F.lit("Full Document").alias("title"), F.col(text_col).alias("body")))
    return df.select(id_col, F.posexplode(F.when(F.size(s) > 0, s).otherwise(whole)).alias("position", "s")).select(id_col, "position", F.col("s.title").alias("title"), F.col("s.body").alias("text"))


def judicial_sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return titled_sections(df, id_col, text_col, JUDICIAL_HEADINGS)


def report_chapters(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return titled_sections(df, id_col, text_col, CHAPTER_HEADING)


def subsections(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(SUBSECTION), F.lit(0)), lambda x: F.trim(x))


def holdings(text: Column, least: int = 50) -> Column:
    """Sentences with a holding, longer than ``least`` characters."""
    return F.filter(F.transform(sentences(text, HOLDING), lambda x: F.trim(x)), lambda x: F.length(x) > least)


def facts(text: Column, n: int = 3) -> Column:
    return F.slice(F.filter(F.split(text, "\n\n"), lambda p: F.trim(p) != ""), 1, n)


def runs_of_lines(text: Column, pattern: str) -> Column:
    """(first_line, n_lines, lines) of each run of lines that have the pattern, in order, inside the row."""

    def spans(lines):
        def body(marked):
            at = lambda i: F.coalesce(F.get(marked, i)["m"], F.lit(False))
            first = F.filter(marked, lambda x: x["m"] & ~at(x["i"] - 1))
            last = F.filter(marked, lambda x: x["m"] & ~at(x["i"] + 1))
            return F.zip_with(first, last, lambda s, e: F.struct(s["i"].alias("first_line"), (e["i"] - s["i"] + 1).alias("n_lines"), F.slice(lines, s["i"] + 1, e["i"] - s["i"] + 1).alias("lines")))

        return let(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(pattern).alias("m"))), body)

    return let(F.split(text, "\n"), spans)


def table_runs(df: DataFrame, id_col: str, text_col: str, pattern: str = TABLE_LINE, keep_lines: bool = False) -> DataFrame:
    """(id, first_line, n_lines[, lines]) of each run of lines that look like table rows (gaps and islands inside one text)."""
    r = df.select(id_col, F.explode(runs_of_lines(F.col(text_col), pattern)).alias("r"))
    return r.select(id_col, "r.first_line", "r.n_lines", *["r.lines"] * keep_lines)


def cross_references(text: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in REFERENCES]))


def _numbered(parts: Column, kind: str, lead: str) -> Column:
    """``lead`` with its number before each part."""
    return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("chunk_type"), (i + 1).cast("string").alias("number"), F.concat(F.lit(lead + " "), (i + 1).cast("string"), F.lit(":\n"), x).alias("text")))


def _rows(df: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    return df.select(id_col, F.posexplode(chunks).alias("chunk_no", "c")).select(id_col, "chunk_no", "c.*")


def legal_chunks(df: DataFrame, id_col: str, text_col: str, most: int = 1000) -> DataFrame:
    """(id, chunk_no, chunk_type, number, text): what precedes the first section, then each section under its number and title.

    A section longer than ``most`` gives its sub-sections instead, where it has any.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    head = r"(?i)(?:Section|Article)\s+(\d+(?:\([a-z]\))?)"
    none = F.array().cast("array<struct<chunk_type:string,number:string,text:string>>")
    before = F.regexp_replace(F.get(F.split(t, LEGAL_HEADING, -1), F.lit(0)), r"^\s+|\s+$", "")

    def section(x):
        number = F.regexp_extract(x["title"], head, 1)
        lead = F.concat(F.lit("Section "), number, F.lit(": "), F.trim(F.regexp_replace(x["title"], head.replace("(?i)", "(?i)^"), "")), F.lit("\n\n"))
        inner = subsections(x["body"])
        parts = F.transform(inner, lambda y, i: F.struct(F.lit("legal_subsection").alias("chunk_type"), F.concat(number, F.lit("_"), (i + 1).cast("string")).alias("number"), F.concat(lead, y).alias("text")))
        whole = F.array(F.struct(F.lit("legal_section").alias("chunk_type"), number.alias("number"), F.concat(lead, x["body"]).alias("text")))
        return F.when((F.length(x["body"]) > most) & (F.size(inner) > 0), parts).otherwise(whole)

    first = F.when(before != "", F.array(F.struct(F.lit("legal_preamble").alias("chunk_type"), F.lit("0").alias("number"), before.alias("text")))).otherwise(none)
    return _rows(df, id_col, F.concat(first, F.flatten(F.transform(split_at(t, LEGAL_HEADING), section))))


def order_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chunk_no, chunk_type, number, text): header with preamble, each line of the orders with 200 characters of preamble, the annexures.

    Parts follow each other as in sections.order_parts; blank lines are left out.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    shape = "struct<s:int,header:array<string>,pre:array<string>,orders:array<string>,ann:array<string>>"

    def step(a, line):
        now = F.greatest(a["s"], order_part(line))
        put = lambda k, n: F.when(now == n, F.array_append(a[k], line)).otherwise(a[k])
        return F.struct(now.alias("s"), put("header", 0).alias("header"), put("pre", 1).alias("pre"), put("orders", 2).alias("orders"), put("ann", 3).alias("ann"))

    empty = F.array().cast("array<string>")
    parts = F.aggregate(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), F.struct(F.lit(0).alias("s"), empty.alias("header"), empty.alias("pre"), empty.alias("orders"), empty.alias("ann")).cast(shape), step)
    p = df.select(id_col, parts.alias("_p"))
    pre = F.array_join("_p.pre", "\n")
    shown = F.when(pre != "", F.concat(F.substring(pre, 1, 200), F.lit("..."))).otherwise("")
    none = F.array().cast("array<struct<chunk_type:string,number:string,text:string>>")
    first = F.when(pre != "", F.array(F.struct(F.lit("go_preamble").alias("chunk_type"), F.lit("0").alias("number"), F.concat(F.array_join("_p.header", "\n"), F.lit("\n\nPreamble:\n"), pre).alias("text")))).otherwise(none)
    orders = F.transform("_p.orders", lambda x, i: F.struct(F.lit("go_order").alias("chunk_type"), (i + 1).cast("string").alias("number"), F.concat(F.lit("Context: "), shown, F.lit("\n\nOrder "), (i + 1).cast("string"), F.lit(": "), x).alias("text")))
    annex = _numbered(F.when(F.size("_p.ann") > 0, F.array(F.array_join("_p.ann", "\n"))).otherwise(F.array().cast("array<string>")), "go_annexure", "Annexure")
    return _rows(p, id_col, F.concat(first, orders, annex))


def judicial_chunks(df: DataFrame, id_col: str, text_col: str, least: int = 50) -> DataFrame:
    """(id, chunk_no, chunk_type, number, text): the facts as one chunk, then every holding."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    said = F.array_join(facts(t), "\n\n")
    none = F.array().cast("array<struct<chunk_type:string,number:string,text:string>>")
    first = F.when(said != "", F.array(F.struct(F.lit("judicial_fact").alias("chunk_type"), F.lit("0").alias("number"), F.concat(F.lit("Facts:\n"), said).alias("text")))).otherwise(none)
    return _rows(df, id_col, F.concat(first, _numbered(holdings(t, least), "judicial_holding", "Holding")))


def data_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chunk_type, number, text): the sentences that sum up, and every run of table lines."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    shape = "array<struct<chunk_type:string,number:int,text:string>>"
    found = F.transform(sentences(t, SUMMARY), lambda x, i: F.struct(F.lit("data_summary"), i + 1, F.regexp_replace(x, r"^\s+|\s+$", ""))).cast(shape)
    runs = runs_of_lines(t, TABLE_LINE)
    tables = F.transform(runs, lambda r, i: F.struct(F.lit("data_table"), i + 1, F.concat(F.lit("Table "), (i + 1).cast("string"), F.lit(":\n"), F.array_join(r["lines"], "\n")))).cast(shape)
    return df.select(id_col, F.explode(F.concat(found, tables)).alias("c")).select(id_col, "c.*")


def enrich(text: Column, title: Column | None = None, prefix: int = 100) -> dict[str, Column]:
    """Words, sentences, and the first place of the chunk's first ``prefix`` characters in its document (``title``: the document's text)."""
    return {
        "word_count": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")),
        "sentence_count": F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(r"\S"))),
        "start": F.instr(text if title is None else title, F.substring(text, 1, prefix)) - 1,
    }


def chunk_type(doc_type: Column) -> Column:
    """Which chunker a type takes; the first that its name contains."""
    t = F.lower(F.coalesce(doc_type, F.lit("")))
    return F.when(t.rlike("act|rule|legal"), "legal").when(t.rlike("order|go"), "order").when(t.rlike("judicial|case"), "judicial").when(t.rlike("data|report"), "data").otherwise("general")


def chunk_documents(df: DataFrame, id_col: str, text_col: str, type_col: str, most: int = 1000, overlap: int = 100) -> DataFrame:
    """(id, chunk_no, chunk_type, text) by the chunker of each document's type, all in one pass.

    Legal texts give their sections, order texts their lines packed, judicial ones facts and holdings,
    data ones their summary sentences, others packed paragraphs. A text that its chunker finds
    nothing in is packed as a general one, so no text is lost.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    paragraphs = F.filter(F.transform(F.split(t, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    lines = F.filter(F.split(t, "\n"), lambda p: F.trim(p) != "")
    as_chunks = lambda a, kind: F.transform(a, lambda x: F.struct(F.lit(kind).alias("chunk_type"), x.alias("text")))
    sections = F.transform(split_at(t, LEGAL_HEADING), lambda s: F.concat_ws("\n", s["title"], s["body"]))
    general = as_chunks(pack_parts(paragraphs, most, "\n\n", overlap), "general_paragraph")
    kind = chunk_type(F.col(type_col))
    own = (
        F.when(kind == "legal", as_chunks(sections, "legal_section"))
        .when(kind == "order", as_chunks(pack_parts(lines, most, "\n"), "go_order"))
        .when(kind == "judicial", F.concat(as_chunks(facts(t), "judicial_fact"), as_chunks(holdings(t), "judicial_holding")))
        .when(kind == "data", as_chunks(F.transform(sentences(t, SUMMARY), lambda x: F.trim(x)), "data_summary"))
        .otherwise(general)
    )
    rows = df.select(id_col, F.posexplode(F.when(F.size(own) > 0, own).otherwise(general)).alias("chunk_no", "c"))
    return rows.select(id_col, "chunk_no", "c.chunk_type", "c.text")


