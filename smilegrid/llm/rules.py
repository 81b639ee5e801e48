"""Quality rules whose thresholds follow each language and source: mergeable quantile sketches, then a joined filter.

A document's metrics are whole numbers (a share is in thousandths). A sketch counts a metric's values in cells that keep the
leading six bits of a number, so a quantile is at most 1/32 too low; sketches merge by adding cells, and any order of
partial sums gives the same thresholds. Cells are added up by (language, source), by language and over all; a group of
fewer than LEAST_ROWS documents takes its language's thresholds, a language of fewer those of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .words import join_back, written

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
LEAST_WORDS = 20
LEAST_ROWS = 100
FENCE = 3
#: A key with more rows than this is broadcast with its thresholds: at most one such key for each so many rows.
HOT_ROWS = 1_000_000
#: metric: what it may exceed its fences by (thousandths), so that metrics that hardly vary reject nothing by accident
SLACK = {"word_length": 300, "symbols": 100, "dup_lines": 500, "repeats": 300}


def _text(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _doubled(rows: DataFrame, keyed: str, out: str) -> DataFrame:
    """``out``: in order, the numbers ``i`` of those structs (x, i) in ``keyed`` whose x occurs in another one."""
    rows = rows.withColumn("_s", F.sort_array(keyed))
    after = F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0)))
    rows = rows.withColumn("_e", F.zip_with("_s", after, lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["x"] == b["x"], F.lit(False)).alias("e"))))
    before = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(False).alias("e"))), F.col("_e"))
    both = F.zip_with("_e", before, lambda a, b: F.when(a["e"] | b["e"], a["i"]))
    return rows.withColumn(out, F.sort_array(F.filter(both, lambda i: i.isNotNull()))).drop("_s", "_e")


def base_metrics(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words in place of text.

    n_lines counts lines with a word; the others are the contract's. Windows are found by a hash and confirmed by their words.
    """
    text, words_at = _text(), lambda i: [F.get("_w", i - 1 + j) for j in range(window)]  # (a slice would copy the whole array each time)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, _SPACES, "")) > 0)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    rows = docs.withColumns({
        "word_chars": F.length(F.translate(text, _SPACES, "")).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_lines": lines, "_w": words,
    }).drop("text")
    spots = F.when(F.size("_w") < window, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1))))
    rows = rows.withColumns({
        "n_words": F.size("_w").cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.transform(spots, lambda i: F.xxhash64(*words_at(i))),
    }).drop("_lines")
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    hashed = F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.transform("_h", lambda h, i: F.struct(h.alias("x"), (i + 1).alias("i")))).otherwise(none)
    rows = _doubled(rows.withColumn("_k", hashed).drop("_h"), "_k", "_maybe")
    rows = rows.withColumn("_k", F.transform("_maybe", lambda i: F.struct(F.concat_ws(" ", *words_at(i)).alias("x"), i.alias("i"))))
    rows = _doubled(rows.drop("_maybe"), "_k", "_at").drop("_k", "_w")
    gaps = F.zip_with("_at", F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
    return rows.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)).drop("_at")


def _shares(rows: DataFrame) -> DataFrame:
    share = lambda x, n: F.call_function("div", 1000 * F.col(x), F.greatest(F.col(n), F.lit(1)))
    return rows.withColumns({"word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")})


def cell(value: Column) -> Column:
    """The least number of a value's sketch cell: its leading six bits, the others 0."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def quantile_sketches(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, cell, n): how many rows of each group have each metric in each cell; NULLs are left out."""
    entry = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), cell(F.col(m)).alias("cell")) for m in metrics])).alias("x")
    return rows.select(*keys, entry).select(*keys, "x.*").where("cell IS NOT NULL").groupBy(*keys, "metric", "cell").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, metric, n, one column a share): the least cell by which so many of a group's rows are counted, a share as (part, of)."""
    by = Window.partitionBy(*keys, "metric")
    rows = sketches.withColumns({"upto": F.sum("n").over(by.orderBy("cell")), "total": F.sum("n").over(by)})
    return rows.groupBy(*keys, "metric").agg(F.first("total").alias("n"), *[F.min(F.when(F.col("upto") * of >= F.col("total") * part, F.col("cell"))).alias(name) for name, (part, of) in shares.items()])


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, bounds): for each group the least and the most that each metric may be, quartiles widened by FENCE times their distance and the slack."""
    quarter = quantiles(sketches, keys, {"q1": (1, 4), "q3": (3, 4)})
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("metric"))
    wide = (F.col("q3") - F.col("q1")) * FENCE + slack
    pair = F.struct((F.col("q1") - wide).alias("least"), (F.col("q3") + wide).alias("most"))
    bounds = F.struct(*[F.max(F.when(F.col("metric") == m, pair)).alias(m) for m in SLACK])
    return quarter.groupBy(*keys).agg(F.max("n").alias("rows"), bounds.alias("bounds"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``: doc_id, the metrics, base_failed, failed (names of the fences passed) and kept.

    Documents that fail a base rule (under LEAST_WORDS words, or over 30 % of the words in repeated windows) aren't kept, and don't
    enter the sketches either, so that junk of that kind doesn't move the quartiles. Of the rest those are kept whose mean word
    length lies within their group's fences and whose symbols, repeated lines and repeated words don't exceed them.
    ``docs`` needs doc_id, text, lang and source; a null text is empty and fails, null languages and sources are groups of
    their own, repeated rows and null ids are judged like others, a table without rows gives none; other columns are not read.
    """
    rows = _shares(base_metrics(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))))
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    none = F.lit("\x00")  # a key for NULL, which no join would match
    rows = rows.withColumns({"lang": F.coalesce("lang", none), "source": F.coalesce("source", none)}).withColumn("group", F.concat_ws("\x01", "lang", "source"))
    rows = written(rows, "rule-metrics")  # a few numbers a document; the texts are read once
    cells = quantile_sketches(rows.where("NOT base_failed"), ["group", "lang"], list(SLACK))
    by_lang = merged(cells, ["lang"])
    own, lang, all_ = fences(cells, ["group", "lang"]), fences(by_lang, ["lang"]), fences(merged(by_lang.withColumn("all", F.lit(1)), ["all"]), ["all"])
    lang = lang.select("lang", F.when(F.col("rows") >= LEAST_ROWS, F.col("bounds")).alias("of_lang"))
    own = own.join(lang, "lang", "left").crossJoin(all_.select(F.col("bounds").alias("of_all")))  # of_all is one row
    own = own.select("group", F.col("rows").alias("n"), F.coalesce(F.when(F.col("rows") >= LEAST_ROWS, F.col("bounds")), "of_lang", "of_all").alias("bounds"))
    judged = join_back(rows.where("NOT base_failed"), written(own, "rule-fences"), "group", narrow=F.length("group") < 1_000, blanks=False, most_rows=HOT_ROWS)
    past = [F.when((F.col(m) > F.col(f"bounds.{m}.most")) | ((F.col(m) < F.col(f"bounds.{m}.least")) & F.lit(m == "word_length")), F.lit(m)) for m in SLACK]
    judged = judged.withColumn("failed", F.array_compact(F.array(*past))).drop("bounds")
    rows = judged.unionByName(rows.where("base_failed").withColumn("failed", F.array().cast("array<string>")))
    back = {c: F.when(F.col(c) != none, F.col(c)).alias(c) for c in ("lang", "source")}
    return rows.select("doc_id", *back.values(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    kept = quality_rules(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi")
