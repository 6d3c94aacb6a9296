"""Rows of tables from positioned words of pages, as one grouping by page and expressions over its words; tests of labels and cells as expressions.

Words are ``doc, page, page_width, text, x0, x1, top, size``. What lines hold follows from one word after the other (a line takes
the words within reach of its first one); that is a fold over the words of a page. Columns come from gaps between right edges, by
another fold; cells from a page's words and its few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import let
from .bands import once

PAGE = ["doc", "page"]
#: Geometry in points, and shares of rows and of the page's width from which values are a column (fixed values).
LINE_GAP, COLUMN_GAP, COLUMN_SLACK, LABEL_GAP, FOOTNOTE, COLUMN_SHARE, COLUMN_LEFT = 3.0, 16.0, 12.0, 4.0, 1.2, 0.35, 0.25
TITLE_REACH, TITLE_WORDS, TITLE_SIZE = 95.0, 9, 1.05
#: Acceptance of tables: words of a label, filled cells, and rows and words where there is one column (fixed values).
LABEL_WORDS, FILLED, LONE_ROWS, LONE_WORDS = 7, 0.45, 4, 5
#: Texts that stand for no value, numbers, periods, and words that go on (fixed values and patterns).
PLACEHOLDERS = ("-", "–", "—", "nm", "n/a")
NUMBER = r"^\(?-?[\d,]*\.?\d+\)?(%|bps)?$"
PERIOD = r"^((19|20)\d{2}[A-Za-z]?|[Qq][1-4]'?\d{0,4}|FY'?\d{2,4}|H[12]'?\d{0,4})$"
DANGLING = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")
GOING_ON = ("amortisation", "and", "for", "in", "of", "on", "or", "shareholders", "taxation", "the", "to", "ventures", "with")


def words_of(label: Column) -> Column:
    return F.filter(F.split(label, r"\s+"), lambda w: w != "")


def is_value(text: Column) -> Column:
    """A number with brackets, separators or a unit, or a sign that stands for none."""
    return F.lower(F.trim(text)).isin(*PLACEHOLDERS) | F.trim(text).rlike(NUMBER)


def is_period(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("")).rlike(PERIOD)


def clean_header(text: Column) -> Column:
    """Without superscripts and a footnote figure of one or two digits that stands apart at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[¹²³\x{2070}-\x{2079}]", ""), r"\s+\d{1,2}$", ""), r"\s+", " "))


def mostly_text(cells: Column) -> Column:
    """Whether half or more of the filled cells begin with something that is no value; false if none is filled."""
    filled = F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != "")
    texts = F.filter(filled, lambda c: ~is_value(F.get(words_of(c), F.lit(0))))
    return (F.size(filled) > 0) & (F.size(texts) * 2 >= F.size(filled))


def period_row(label: Column, cells: Column) -> Column:
    """Two filled cells or more, all of them periods, and at most three words without figures beside them."""
    filled = F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != "")
    return (F.size(filled) >= 2) & F.forall(filled, is_period) & (F.size(words_of(label)) <= 3) & ~label.rlike(r"\d")


def without_garble(label: Column) -> Column:
    """A label without words of eight letters or more and hardly a vowel; never an empty one."""
    letters = lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", ""))
    vowels = lambda w: F.length(F.regexp_replace(w, "[^aeiouAEIOU]", ""))
    kept = F.array_join(F.filter(words_of(label), lambda w: (letters(w) < 8) | (vowels(w) >= letters(w) * 0.12)), " ")
    return F.when(kept != "", kept).otherwise(label)


def is_open(label: Column) -> Column:
    """A label that asks for more: an open bracket, a trailing ``&`` or conjunction."""
    count = lambda x: F.length(label) - F.length(F.replace(label, F.lit(x), F.lit("")))
    last = F.regexp_replace(F.lower(F.coalesce(F.element_at(words_of(label), -1), F.lit(""))), ",+$", "")
    return F.rtrim(label).endswith("&") | (count("(") > count(")")) | last.isin(*DANGLING)


def goes_on(label: Column) -> Column:
    """A label that continues the one before: it begins in lower case or with a bracket."""
    return F.trim(label).rlike(r"^[\p{Ll}()\[\]]")


def is_section(label: Column) -> Column:
    """A label that may stand over rows of its own: six words at most, capitalised, no word that goes on."""
    words = words_of(label)
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    return (F.size(words) <= 6) & first.rlike(r"^\p{Lu}") & ~F.lower(first).isin(*GOING_ON)


def lines(words: Column) -> Column:
    """``anchor, at, n`` of the lines of a page's words from the top down (``words[at - 1]`` is the first of ``n``): a line takes the words within reach of its first one."""
    line = lambda top, at, n: F.struct(top.alias("anchor"), at.alias("at"), n.alias("n"))
    start = F.struct(line(F.lit(None).cast("double"), F.lit(1), F.lit(0)).alias("now"), F.array().cast("array<struct<anchor:double,at:int,n:int>>").alias("done"))

    def step(acc: Column, w: Column) -> Column:
        now, top = acc["now"], w["top"]
        begun = F.struct(line(top, now["at"] + now["n"], F.lit(1)).alias("now"), F.when(now["n"] > 0, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"))
        near = F.coalesce(F.abs(top - now["anchor"]) <= LINE_GAP, F.lit(False))
        return F.when(near, F.struct(line(now["anchor"], now["at"], now["n"] + 1).alias("now"), acc["done"].alias("done"))).otherwise(begun)

    return F.aggregate(words, start, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def value_columns(words: Column, n_lines: Column) -> Column:
    """``col, left, right`` of a page's columns of right-aligned values that enough lines fill, from left to right."""
    kind = "struct<left:double,right:double,total:double,n:int,width:double>"
    values = F.sort_array(F.transform(F.filter(words, lambda w: w["value"]), lambda w: F.struct(w["x1"].alias("x1"), w["x0"].alias("x0"), w["page_width"].alias("width"))))
    start = F.struct(F.lit(None).cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("done"))
    cluster = lambda left, right, total, n, width: F.struct(left.alias("left"), right.alias("right"), total.alias("total"), n.alias("n"), width.alias("width"))

    def step(acc: Column, v: Column) -> Column:
        now = acc["now"]
        begun = F.struct(cluster(v["x0"], v["x1"], v["x1"], F.lit(1), v["width"]).alias("now"), F.when(now.isNotNull(), F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"))
        more = cluster(F.least(now["left"], v["x0"]), v["x1"], now["total"] + v["x1"], now["n"] + 1, now["width"])
        return F.when(v["x1"] - now["right"] <= COLUMN_GAP, F.struct(more.alias("now"), acc["done"].alias("done"))).otherwise(begun)

    found = F.aggregate(values, start, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["now"])), lambda c: c.isNotNull()))
    enough = F.greatest(F.lit(2), F.floor(n_lines * COLUMN_SHARE))
    kept = F.filter(found, lambda c: (c["n"] >= enough) & (c["total"] / c["n"] > c["width"] * COLUMN_LEFT))
    return F.transform(F.sort_array(F.transform(kept, lambda c: F.struct(c["left"].alias("left"), c["right"].alias("right")))), lambda c, i: F.struct(i.alias("col"), c["left"].alias("left"), c["right"].alias("right")))


def _middle(numbers: Column) -> Column:
    """The median of an array."""
    of = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return let(F.sort_array(F.filter(numbers, lambda x: x.isNotNull())), of)


def rows(words: DataFrame) -> DataFrame:
    """``doc, page, line, top, size, label, cells``: each line's label and its text in each column, of pages that have columns.

    A word stands in the first column that its middle lies over; else it is of the label if it ends before the first column.
    Small figures are footnote marks and go. Words are brought together once a page; all else is worked out from the page's words.
    """
    word = F.struct(F.round(F.col("top") / LINE_GAP).alias("band"), "x0", F.col("top").cast("double").alias("top"), "text", "x1", "size", "page_width", is_value(F.col("text")).alias("value"))
    paged = once(words.groupBy(*PAGE).agg(F.collect_list(word).alias("found")), "words", F.sort_array("found")).drop("found")
    paged = once(paged, "lines", lines(F.col("words")))
    paged = once(paged, "columns", value_columns(F.col("words"), F.size("lines"))).where(F.size("columns") > 0)
    paged = once(paged, "usual", _middle(F.transform("words", lambda w: w["size"])))
    n_columns, begin = F.size("columns"), F.get("columns", F.lit(0))["left"]

    def column_of(w: Column) -> Column:
        mid = (w["x0"] + w["x1"]) / 2
        return let(mid, lambda m: F.get(F.filter("columns", lambda c: (m >= c["left"] - COLUMN_SLACK) & (m <= c["right"] + COLUMN_SLACK)), F.lit(0))["col"])

    in_label = lambda w: (w["x1"] < begin - LABEL_GAP) & ~(w["value"] & (w["size"] < F.col("usual") - FOOTNOTE))
    placed = F.transform("words", lambda w: let(column_of(w), lambda c: F.struct(F.when(c.isNotNull(), c).when(in_label(w), -1).alias("col"), w["x0"].alias("x0"), w["text"].alias("text"), w["size"].alias("size"))))
    said = lambda ws, i: F.array_join(F.transform(F.filter(ws, lambda w: w["col"] == i), lambda w: w["text"]), " ")

    def told(x: Column, i: Column) -> Column:
        own = F.slice("placed", x["at"], x["n"])
        size = F.array_max(F.transform(own, lambda w: w["size"]))
        return let(F.sort_array(own), lambda ws: F.struct(i.alias("line"), x["anchor"].alias("top"), size.alias("size"), said(ws, F.lit(-1)).alias("label"), F.transform(F.sequence(F.lit(0), n_columns - 1), lambda k: said(ws, k)).alias("cells")))

    return once(paged, "placed", placed).select(*PAGE, F.inline(F.transform("lines", told)))


def accepted(found: DataFrame) -> DataFrame:
    """``doc, page, accepted``: whether the rows of a page make a table, by the words of labels and by how many cells are filled."""
    filled = F.size(F.filter("cells", lambda c: c != ""))
    of = found.groupBy(*PAGE).agg(F.avg(F.size(words_of(F.col("label")))).alias("words"), (F.sum(filled) / F.sum(F.size("cells"))).alias("density"), F.count("*").alias("n"), F.max(F.size("cells")).alias("columns"))
    lone = (F.col("columns") == 1) & ((F.col("n") < LONE_ROWS) | (F.col("words") > LONE_WORDS))
    rejected = (F.col("words") > LABEL_WORDS) | (F.col("columns") > 1) & (F.col("density") < FILLED) | lone
    return of.select(*PAGE, (~rejected).alias("accepted"))


def titles(heads: DataFrame, tables: DataFrame) -> DataFrame:
    """``doc, page, title``: for each table (``top``, ``size`` of its text) the heading above it with the best score.

    ``heads``: ``doc, page, text, top, size, bold``. A heading is near, short, and larger than the text or bold; its score is its size,
    2 more if bold, less a fiftieth of the distance.
    """
    distance = F.col("t.top") - F.col("h.top")
    fits = (distance > 0) & (distance <= TITLE_REACH) & (F.size(words_of(F.col("h.text"))) <= TITLE_WORDS) & ((F.col("h.size") > F.col("t.size") * TITLE_SIZE) | F.col("h.bold"))
    score = F.col("h.size") + F.when(F.col("h.bold"), 2.0).otherwise(0.0) - distance * 0.02
    near = tables.alias("t").join(heads.alias("h"), PAGE).where(fits)
    return near.groupBy(*PAGE).agg(F.max_by("h.text", F.struct(score.alias("score"), F.col("h.top"), F.col("h.text"))).alias("title"))
