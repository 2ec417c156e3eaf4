"""Layout items of a paper (C1-C6, P14, T24), all with higher-order functions on one array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Threshold of an indent in the 0-1000 space, and what headers look like.
INDENT = 30
ABSTRACT_TITLE = r"(?iU)^a\s*b\s*s\s*t\s*r\s*a\s*c\s*t$"
REFERENCES_TITLE = r"(?iU)^r\s*e\s*f\s*e\s*r\s*e\s*n\s*c\s*e\s*s?$"

ITEM = "struct<type:string,text:string,text_level:int,bbox:array<double>,page_idx:int,sub_type:string,img_path:string,image_caption:array<string>,table_body:string,table_caption:array<string>,list_items:array<string>,code_body:string,guess_lang:string>"


def _level(x: Column) -> Column:
    return F.coalesce(x["text_level"], F.lit(0))


def _title(x: Column) -> Column:
    return F.trim(F.coalesce(x["text"], F.lit("")))


def first_index(items: Column, test) -> Column:
    """Index from 0 of the first item that passes, -1 if none."""
    return F.coalesce(F.array_position(F.transform(items, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0)).cast("int") - 1


def last_index(items: Column, test, before: Column | None = None) -> Column:
    """Index of the last item that passes, -1 if none."""
    marked = F.transform(items, lambda x, i: F.when(F.coalesce(test(x, i), F.lit(False)), i).otherwise(-1))
    return F.coalesce(F.array_max(marked), F.lit(-1))


def filter_layout(df: DataFrame, items: str = "items") -> DataFrame:
    """Adds layout_reason, an array with why each item goes ('' for kept ones), and has_abstract, references_idx and page_end.

    Order of reasons: before_intro, after_references, reproducibility, acknowledgments, footnote, header.
    """
    it = F.col(items)
    df = df.withColumn("_abs", first_index(it, lambda x: (_level(x) > 0) & _title(x).rlike(ABSTRACT_TITLE)))
    df = df.withColumn("has_abstract", F.col("_abs") >= 0)
    df = df.withColumn("_abs", F.when(F.col("has_abstract"), F.col("_abs")).otherwise(first_index(it, lambda x: _level(x) == 1)))
    df = df.withColumn("_head", F.get(it, F.col("_abs") + 1)).withColumn("_left", F.get(F.col("_head.bbox"), 0))
    n = F.size(it)
    stop = F.array_min(
        F.filter(
            F.transform(it, lambda x, i: F.when((i >= F.col("_abs") + 2) & ((F.coalesce(F.col("_left") - F.get(x["bbox"], 0), F.lit(0.0)) > INDENT) | (_level(x) == 1)), i)),
            lambda i: i.isNotNull(),
        )
    )
    plain = F.when(F.col("_abs") + 2 < n, F.col("_abs") + 2).otherwise(F.col("_abs") + 1)
    df = df.withColumn("_intro", F.when(F.col("_left").isNotNull(), F.coalesce(stop, F.col("_abs") + 1)).otherwise(plain))
    df = df.withColumn("references_idx", first_index(it, lambda x: (_level(x) > 0) & _title(x).rlike(REFERENCES_TITLE)))
    ref = F.col("references_idx")
    last_ref = last_index(it, lambda x, i: (i > ref) & (x["type"] == "list") & (x["sub_type"] == "ref_text"))
    df = df.withColumn("_ref_end", F.when(ref >= 0, F.when(last_ref >= 0, last_ref + 1).otherwise(ref + 1)).otherwise(n))
    most = F.coalesce(F.array_max(F.transform(it, lambda x: F.coalesce(x["page_idx"], F.lit(0)))), F.lit(0))
    df = df.withColumn("page_end", F.when(ref >= 0, F.coalesce(F.get(it, F.col("_ref_end") - 1)["page_idx"], F.lit(0))).otherwise(most))
    df = df.withColumn("_until", F.when(ref > 0, ref).otherwise(n))
    for name, word in (("repro", "repro"), ("ack", "acknowledg")):

        def hit(x: Column, i: Column, word: str = word) -> Column:
            title = F.lower(_title(x))
            mine = F.contains(title, F.lit(word)) if word == "repro" else F.contains(title, F.lit(word)) & ~F.contains(title, F.lit("repro"))
            return (i >= F.col("_intro")) & (i < F.col("_until")) & (_level(x) == 1) & mine

        df = df.withColumn(f"_{name}", last_index(it, hit))
        end = F.array_min(F.filter(F.transform(it, lambda x, i: F.when((i > F.col(f"_{name}")) & (i < F.col("_until")) & (_level(x) == 1), i)), lambda i: i.isNotNull()))
        df = df.withColumn(f"_{name}_end", F.coalesce(end, F.col("_until")))
    inside = lambda i, name: (F.col(f"_{name}") >= 0) & (i >= F.col(f"_{name}")) & (i < F.col(f"_{name}_end"))
    reason = F.transform(
        it,
        lambda x, i: F.when(i < F.col("_intro"), "before_intro")
        .when(i >= F.col("_ref_end"), "after_references")
        .when(inside(i, "repro"), "reproducibility")
        .when(inside(i, "ack"), "acknowledgments")
        .when(x["type"].isin("page_footnote", "footer") & ((F.coalesce(x["page_idx"], F.lit(0)) == 0) | F.contains(F.lower(F.coalesce(x["text"], F.lit(""))), F.lit("github"))), "footnote")
        .when(x["type"] == "header", "header")
        .otherwise(""),
    )
    df = df.withColumn("layout_reason", F.when(F.col("_abs") >= 0, reason).otherwise(F.transform(it, lambda x: F.lit("no_abstract"))))
    return df.drop("_abs", "_head", "_left", "_intro", "_ref_end", "_until", "_repro", "_repro_end", "_ack", "_ack_end")


def kept_items(items: Column, reasons: Column) -> Column:
    """Kept items, level-1 headers in upper case."""
    kept = F.filter(F.arrays_zip(items.alias("item"), reasons.alias("why")), lambda z: z["why"] == "")
    return F.transform(kept, lambda z: F.when(_level(z["item"]) == 1, z["item"].withField("text", F.upper(z["item"]["text"]))).otherwise(z["item"]))


def render_markdown(items: Column) -> Column:
    """Items as markdown; unknown types and empty images, tables, equations and code give nothing."""
    nl = F.lit("\n")

    def one(x: Column) -> Column:
        text, level = F.coalesce(x["text"], F.lit("")), _level(x)
        caption = lambda name: F.array_join(F.coalesce(x[name], F.array().cast("array<string>")), " ")
        image = lambda name: F.concat(nl, F.lit("!["), caption(name), F.lit("]("), x["img_path"], F.lit(")"), nl)
        some = lambda c: F.coalesce(c, F.lit("")) != ""
        table = F.concat_ws("\n", F.when(caption("table_caption") != "", F.concat(nl, caption("table_caption"), nl)), F.concat(nl, x["table_body"], nl))
        items_text = F.array_join(F.transform(F.coalesce(x["list_items"], F.array().cast("array<string>")), lambda li: F.concat(F.lit("- "), li, nl)), "\n")
        return (
            F.when((x["type"] == "text") & (level > 0), F.concat(nl, F.repeat(F.lit("#"), level), F.lit(" "), text, nl))
            .when(x["type"] == "text", F.concat(nl, text, nl))
            .when((x["type"] == "image") & some(x["img_path"]), image("image_caption"))
            .when((x["type"] == "table") & some(x["table_body"]), table)
            .when((x["type"] == "table") & some(x["img_path"]), image("table_caption"))
            .when((x["type"] == "equation") & (text != ""), F.concat(F.lit("\n$$\n"), text, F.lit("\n$$\n")))
            .when((x["type"] == "list") & (items_text != ""), items_text)
            .when((x["type"] == "code") & some(x["code_body"]), F.concat(F.lit("\n```"), F.coalesce(x["guess_lang"], F.lit("")), nl, x["code_body"], F.lit("\n```\n")))
        )

    return F.array_join(F.array_compact(F.transform(items, one)), "\n")


def to_points(bbox: Column, width: Column, height: Column) -> Column:
    """A box in the 0-1000 space in points of a page."""
    return F.transform(bbox, lambda v, i: v / 1000.0 * F.when(i % 2 == 0, width).otherwise(height))


def normalised_papers(df: DataFrame, items: str = "items") -> DataFrame:
    """Df with markdown, counts of removed items by reason, has_abstract, page_end, and success and error: why a paper has no markdown."""
    got = filter_layout(df, items)
    kept = kept_items(F.col(items), F.col("layout_reason"))
    error = F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "Empty content list").when(F.size(kept) == 0, "No content after filtering")
    reasons = ("before_intro", "after_references", "reproducibility", "acknowledgments", "footnote", "header")

    def count(reason: str) -> Column:
        return F.size(F.filter(F.coalesce("layout_reason", F.array().cast("array<string>")), lambda x: x == reason))

    counts = {f"removed_{r}": count(r) for r in reasons}
    return got.withColumn("error", error).withColumn("success", F.col("error").isNull()).withColumn("markdown", F.when(F.col("success"), render_markdown(kept))).withColumns(counts).drop("layout_reason")
