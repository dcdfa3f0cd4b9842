"""Benchmark decontamination by template windows: re-parameterised questions are found too.

Texts are canonicalised word for word: numbers become ``#``, a unit at a number ``%``, a
capitalised word within a sentence ``@``; case and punctuation go. Windows of five template
words are hash-joined with those of the benchmark. Matches on one diagonal (place in the document
minus place in the item) must be slot-consistent: each value of the item's slots stands for one
value of the document. An item is found where consistent diagonals hold 0.8 of its windows.

Windows of placeholders alone say nothing and take no part. Beside its template windows an item has
those of its plain words in lower case, names and numbers as they are; it is found by either form, so
a copy in other case or one of numbers alone is found word for word. Items of two to four words
are found where they stand word for word, items of one word where they are the whole document.

Candidates come from each item's windows that the fewest documents hold, as many as no document with
0.8 of them can miss; only candidates meet the item's other windows. Diagonals are taken from the longest
on, each if its slots agree with those taken before.

All steps are DataFrame operations. Bitmaps of fixed size, set from the benchmark's windows
and from the first and last words of these, drop most windows of documents before they become rows; the join
decides on the rest.

Defined results: null texts and items have no words; items and documents without words are in no
result, nor do empty tables give rows. Rows equal in id and text are one document. Repeated
items are found each under its own id, null ids included. Texts are read whole, however long. Ties
between diagonals go to the earlier place in the document. Further columns, of whatever name, are kept by
``cleaned`` and ignored by ``contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, row_key, staged, table
from .shingles import bitmap, columns_of, edge_hits, edges, window_edges, window_hashes, words_of

WIDTH, CONTAINED = 5, 0.8
#: Forms of a window: of the template, and (by their width) of plain words.
TEMPLATE = 0
PLACEHOLDERS = ("#", "%", "@")
UNITS = ("km", "cm", "mm", "m", "miles", "mile", "kg", "g", "mg", "lb", "lbs", "s", "sec", "seconds", "min", "minutes",
         "h", "hours", "days", "weeks", "months", "years", "l", "ml", "kw", "w", "v", "hz", "mb", "gb", "usd", "eur",
         "dollars", "euros", "percent", "degrees")
PUNCTUATION = r"""[,.;:!?"'()\[\]]+"""


def template(text: Column) -> Column:
    """The text with typed placeholders; words keep their number and order."""
    numbered = F.regexp_replace(text, r"\d+(?:[.,:/]\d+)*", "#")
    unit = F.regexp_replace(numbered, rf"#(\s?)(?i:{'|'.join(UNITS)})\b", "#$1%")
    named = F.regexp_replace(unit, r"\p{Lu}(?<=[\p{Ll},] .)\p{L}*", "@")
    return F.regexp_replace(F.lower(named), PUNCTUATION, "")


def canonical(rows: DataFrame) -> DataFrame:
    """``rows`` (_text) with the words ``_w`` of the template and ``_o`` of the text, one for one."""
    # columns first: words_of reads its text twice, and would make it twice
    plain = columns_of(rows, _wt=template(F.col("_text")), _ot=F.lower(F.regexp_replace("_text", PUNCTUATION, "")))
    return columns_of(plain, _w=words_of(F.col("_wt")), _o=words_of(F.col("_ot"))).drop("_wt", "_ot")


def hashed(rows: DataFrame, widths: list[int]) -> DataFrame:
    """``rows`` with the window hashes of each form: ``_h0`` of the template, ``_h5`` of WIDTH plain
    words, and those of the smaller ``widths``."""
    made = {f"_h{TEMPLATE}": window_hashes("_w", WIDTH), f"_h{WIDTH}": window_hashes("_o", WIDTH)}
    for n in widths:
        short = window_hashes("_o", n)
        made[f"_h{n}"] = short if n > 1 else F.when(F.size("_o") == 1, short).otherwise(F.array().cast("array<bigint>"))
    return columns_of(rows, **made)


def _windows(form: int, hashes: Column) -> Column:
    """Form, place, hash, original words and template words of each window."""
    width = form or WIDTH
    return F.transform(hashes, lambda x: F.struct(
        F.lit(form).alias("form"), x["i"].alias("i"), x["h"].alias("h"), F.slice("_o", x["i"] + 1, F.lit(width)).alias("o"),
        F.slice("_w" if form == TEMPLATE else "_o", x["i"] + 1, F.lit(width)).alias("w")))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, item_id, form, n, j, h, b, t): the windows of each item and, by form, how many differ."""
    asked = canonical(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))).select(
        F.xxhash64("item_id", F.concat_ws(" ", "_o")).alias("item"), "item_id", "_w", "_o").dropDuplicates(["item"])
    asked = hashed(asked, list(range(1, WIDTH)))

    def placed(form: int) -> Column:
        at = F.transform(F.col(f"_h{form}"), lambda h, i: F.struct(i.alias("i"), h.alias("h")))
        whole = F.size("_o") == form if 0 < form < WIDTH else F.lit(True)
        return F.when(whole, _windows(form, at)).otherwise(F.array().cast(
            "array<struct<form:int,i:int,h:bigint,o:array<string>,w:array<string>>>"))
    rows = asked.select("item", "item_id", F.explode(F.concat(*[placed(f) for f in range(WIDTH + 1)])).alias("x")).where(
        (F.col("x.form") != TEMPLATE) | F.exists("x.w", lambda w: ~w.isin(*PLACEHOLDERS)))
    rows = rows.select("item", "item_id", "x.form", F.col("x.i").alias("j"), "x.h", F.col("x.o").alias("b"), F.col("x.w").alias("t"))
    sizes = rows.groupBy("item", "form").agg(F.count_distinct("h").alias("n"))
    return rows.join(sizes, ["item", "form"])


def candidates(found: DataFrame, asked: DataFrame, contained: float) -> DataFrame:
    """(_k1, _k2, item, form): documents that hold one of the item's rarest windows.

    A document with ``contained`` of n windows lacks n - ceil(contained * n) at most, so one of any
    greater number of windows is in it."""
    held = found.groupBy("form", "h").agg(F.count("*").alias("held"))
    ranked = asked.select("item", "form", "n", "h").distinct().join(held, ["form", "h"], "left").withColumn("rank", F.row_number().over(
        Window.partitionBy("item", "form").orderBy(F.coalesce("held", F.lit(0)), "h")))
    rare = ranked.where(F.col("held").isNotNull() & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * contained - 1e-9) + 1))
    return found.select("_k1", "_k2", "form", "h").join(rare.select("item", "form", "h"), ["form", "h"]).select(
        "_k1", "_k2", "item", "form").distinct()


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, contained, changed, _k1, _k2); ``items``: item_id, text."""
    asked = staged(item_windows(items), "items")
    widths = sorted(r["form"] for r in asked.where(F.col("form").between(1, WIDTH - 1)).select("form").distinct().collect())
    bits, known = bitmap(asked), bitmap(asked.select(edges(F.get("t", F.lit(0)), F.element_at("t", -1)).alias("h")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    forms = {f: ("_w" if f == TEMPLATE else "_o", f or WIDTH) for f in (TEMPLATE, *widths, WIDTH)}
    keyed = columns_of(canonical(rows.select("doc_id", *row_key("doc_id", "_text"), "_text")),
                       **{f"_e{f}": window_edges(*made) for f, made in forms.items()})

    def held(form: int) -> Column:
        met = edge_hits(*forms[form], f"_e{form}", known, bits)
        return _windows(form, met if form != 1 else F.filter(met, lambda x: F.size("_o") == 1))
    found = staged(keyed.select("doc_id", "_k1", "_k2", F.explode(F.concat(*map(held, forms))).alias("x")).select(
        "doc_id", "_k1", "_k2", "x.form", F.col("x.i").alias("i"), "x.h", F.col("x.o").alias("d")).join(
        asked.select("form", "h").distinct(), ["form", "h"], "left_semi"), "windows")
    # a slot is a word that the template changes
    slots = F.filter(F.zip_with("b", F.zip_with("t", "d", lambda t, d: F.struct(t.alias("t"), d.alias("d"))),
                                lambda b, td: F.struct(b.alias("b"), td["t"].alias("t"), td["d"].alias("d"))),
                     lambda s: s["b"] != s["t"])
    met = candidates(found, asked, contained).join(asked, ["item", "form"]).join(found, ["_k1", "_k2", "form", "h"]).select(
        "doc_id", "_k1", "_k2", "item", "item_id", "form", "n", "h", (F.col("i") - F.col("j")).alias("diagonal"),
        F.transform(slots, lambda s: F.struct(s["b"].alias("b"), s["d"].alias("d"))).alias("slots"))
    at = ["_k1", "_k2", "item", "form"]
    lines = met.groupBy(*at, "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n").alias("n"),
        F.collect_set("h").alias("hs"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("pairs"))
    pairs = lines.groupBy(*at).agg(
        F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct((-F.size("hs")).alias("size"), "diagonal", "hs", "pairs"))).alias("lines"))

    def steady(pairs: Column) -> Column:
        return F.size(pairs) == F.size(F.array_distinct(pairs["b"]))

    def taken(state: Column, line: Column) -> Column:
        both = F.array_union(state["pairs"], line["pairs"])
        return F.when(steady(both), F.struct(F.array_union(state["hs"], line["hs"]).alias("hs"), both.alias("pairs"))).otherwise(state)
    start = F.struct(F.array().cast("array<bigint>").alias("hs"), F.array().cast("array<struct<b:string,d:string>>").alias("pairs"))
    forms = pairs.withColumn("got", F.aggregate("lines", start, taken)).select(
        *at, "doc_id", "item_id", (F.size("got.hs") / F.col("n")).alias("contained"),
        F.exists("got.pairs", lambda p: p["b"] != p["d"]).alias("changed"))
    return forms.where(F.col("contained") >= contained).groupBy("_k1", "_k2", "item").agg(
        F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"),
        F.max("contained").alias("contained"), F.min("changed").alias("changed")).drop("item")


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    k1, k2 = fresh(docs, "_k1", "_k2")
    bad = contaminated(docs, items).select(F.col("_k1").alias(k1), F.col("_k2").alias(k2)).distinct()
    keys = row_key(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("*", *[k.alias(name) for k, name in zip(keys, (k1, k2))])
    return rows.join(bad, [k1, k2], "left_anti").select(docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "contained", "changed")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs, table(spark, sf_dir, "benchmark"))
