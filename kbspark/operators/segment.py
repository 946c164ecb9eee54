"""C11: words of scripts without blanks, as best paths over a word graph whose counts are learned from the corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from kbspark.functions.text import CJK
from kbspark.jobs import settle, sized

LONGEST = 4  # characters of a word
UNIT = 1_000_000  # costs are whole millionths of a natural logarithm, so that equal paths are equal


def _pieces(c: Column, script: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{script}]+|[^\\s{script}]+"), F.lit(0))


def _with_grams(runs: DataFrame, longest: int) -> DataFrame:
    """The rows of runs(run) with every piece of 1 to ``longest`` characters as at (from 0), size, word."""
    spelt = runs.withColumn("_chars", F.regexp_extract_all("run", F.lit("."), F.lit(0)))
    # a row a place carries only the few characters that its words can have, not its run
    near = F.transform(F.sequence(F.lit(0), F.size("_chars") - 1), lambda at: F.slice("_chars", at + 1, F.lit(longest)))
    each = spelt.select(*runs.columns, F.posexplode(near).alias("at", "_near"))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.size("_near"))).alias("size"))
    return each.withColumn("word", F.array_join(F.slice("_near", F.lit(1), F.col("size")), "")).drop("_near")


def learned_words(chunks: DataFrame, script: str = CJK, longest: int = LONGEST, least: int = 5, cohesion: float = 2.0) -> DataFrame:
    """word, size, n, cost: all characters of a script in chunks(text), and the runs of 2 to ``longest`` that hold together.

    These occur ``least`` times or more and, however they are cut in two, at least exp(``cohesion``) times as often as two
    independent parts would stand side by side. cost is -ln of a word's share of all occurrences, in millionths. Null texts
    count as empty; a corpus without the script gives no rows.
    """
    runs = chunks.select(F.explode(_pieces(F.col("text"), script)).alias("run")).where(F.col("run").rlike(f"^[{script}]")).groupBy("run").agg(F.count("*").alias("times"))
    grams = settle(_with_grams(runs, longest).groupBy("word", "size").agg(F.sum("times").alias("n")), "segment-grams")
    total = grams.where("size = 1").agg(F.sum("n")).first()[0] or 1
    often = grams.where((F.col("size") > 1) & (F.col("n") >= least))
    cuts = often.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("word", "size", "n", F.col("word").substr(F.lit(1), F.col("at")).alias("a"), F.col("word").substr(F.col("at") + 1, F.col("size")).alias("b"))
    cuts = cuts.join(grams.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(grams.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    held = cuts.groupBy("word", "size", "n").agg(F.min(F.col("n") * total / (F.col("na") * F.col("nb"))).alias("odds")).where(F.log("odds") >= cohesion)
    words = settle(grams.where("size = 1").unionByName(held.select("word", "size", "n")), "segment-words")
    kept = words.agg(F.sum("n")).first()[0] or 1
    return words.withColumn("cost", F.round(-F.log(F.col("n") / kept) * UNIT).cast("long"))


@F.pandas_udf(ArrayType(StringType()))
def _best_path(runs: pd.Series, arcs: pd.Series) -> pd.Series:
    """Words of the cheapest path of each run over arcs (end, size, cost); of equal ones fewer words, then a longer last one."""

    def one(run: str, found) -> list[str]:
        best = {0: (0, 0, 0)}
        for arc in sorted(found, key=lambda x: x["end"]):
            cost, words, _ = best[arc["end"] - arc["size"]]
            way = (cost + arc["cost"], words + 1, -arc["size"])
            if arc["end"] not in best or way < best[arc["end"]]:
                best[arc["end"]] = way
        out, at = [], len(run)
        while at:
            out.append(run[at + best[at][2] : at])
            at += best[at][2]
        return out[::-1]

    return pd.Series([one(run, found) for run, found in zip(runs, arcs, strict=True)], dtype=object)


def segmented(runs: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """run, words of the distinct, not empty runs(run): the path of least cost over words(word, cost).

    A character that was never seen costs more than any word. Pieces are joined with the words, which are broadcast
    only if they are few; memory of a task grows with its longest run.
    """
    dear = (words.agg(F.max("cost")).first()[0] or 0) + UNIT
    numbered = settle(runs.where("run <> ''").select("run").distinct().withColumn("_id", F.monotonically_increasing_id()), "segment-runs")
    pieces = _with_grams(numbered, longest).drop("run").join(sized(words.select("word", "cost")), "word", "left").where("cost is not null or size = 1")
    arcs = pieces.groupBy("_id").agg(F.collect_list(F.struct((F.col("at") + F.col("size")).alias("end"), "size", F.coalesce("cost", F.lit(dear)).alias("cost"))).alias("arcs"))
    return numbered.join(arcs, "_id").select("run", _best_path("run", "arcs").alias("words"))


def segmented_tokens(chunks: DataFrame, words: DataFrame, script: str = CJK) -> DataFrame:
    """The rows of chunks(text) with tokens: lower-cased, between white space, runs of the script cut into words.

    As ``index_tokens``, but with words in place of bigrams. Rows without the script are not shuffled. Null texts have
    no tokens; rows may repeat.
    """
    rows = settle(chunks.withColumns({"tokens": F.coalesce(_pieces(F.col("text"), script), F.array().cast("array<string>")), "_row": F.monotonically_increasing_id()}), "segment-rows")
    inside = F.coalesce(F.lower("text").rlike(f"[{script}]"), F.lit(False))
    each = rows.where(inside).select("_row", F.posexplode("tokens").alias("pos", "run"))
    of_script = F.col("run").rlike(f"^[{script}]")
    cut = segmented(each.where(of_script), words)
    parts = each.where(of_script).join(cut, "run").select("_row", "pos", "words").unionByName(each.where(~of_script).select("_row", "pos", F.array("run").alias("words")))
    told = parts.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "words"))), lambda x: x["words"])).alias("_told"))
    return rows.where(~inside).drop("_row").unionByName(rows.where(inside).join(told, "_row").withColumn("tokens", F.col("_told")).drop("_row", "_told"))
