"""Ordered word corrections that apply to books by the keywords of their titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are few; beyond so many they are not applied within a row but refused.
MAX_RULES = 5000


def rules_by_title(rules: DataFrame, titles: DataFrame) -> DataFrame:
    """``title, steps``: the replacements that apply to each distinct title, in order.

    A rule applies if the title has all of its keywords; one without keywords to every title.
    Distinct titles meet all rules (at most MAX_RULES), which are broadcast: a theta join.
    """
    listed = rules.select("rule_order", "name", F.coalesce("title_keywords", F.array().cast("array<string>")).alias("keywords"), "replacements")
    distinct = titles.where(F.col("title").isNotNull()).select("title").distinct()
    fits = F.forall("keywords", lambda k: F.col("title").contains(k))
    met = distinct.join(F.broadcast(listed), fits)
    step = F.struct("rule_order", "name", "replacements")
    return met.groupBy("title").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def corrected(text: Column, steps: Column) -> Column:
    """``text`` after all replacements of all steps in order, each literal and everywhere."""

    def apply(t: Column, step: Column) -> Column:
        return F.aggregate(
            F.coalesce(step["replacements"], F.array().cast("array<struct<wrong:string,right:string>>")),
            t,
            lambda acc, r: F.when(F.coalesce(r["wrong"], F.lit("")) == "", acc).otherwise(F.replace(acc, r["wrong"], F.coalesce(r["right"], F.lit("")))),
        )

    return F.aggregate(F.coalesce(steps, F.array().cast("array<struct<rule_order:int,name:string,replacements:array<struct<wrong:string,right:string>>>>")), text, apply)


def apply_rules(pages: DataFrame, rules: DataFrame, title: str = "book") -> DataFrame:
    """Pages with ``text`` corrected and ``n_changed``: by how many rules the text was changed."""
    if rules.count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    known = rules_by_title(rules, pages.select(F.col(title).alias("title")))
    rows = pages.join(known, pages[title] == known["title"], "left").drop(known["title"])
    start = F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, rule: Column) -> Column:
        new = corrected(acc["text"], F.array(rule))
        return F.struct(new.alias("text"), (acc["n"] + F.when(F.coalesce(new != acc["text"], F.lit(False)), 1).otherwise(0)).alias("n"))

    none = F.array().cast("array<struct<rule_order:int,name:string,replacements:array<struct<wrong:string,right:string>>>>")
    done = rows.withColumn("_done", F.aggregate(F.coalesce("steps", none), start, step))
    others = [c for c in pages.columns if c != "text"]
    return done.select(*others, F.col("_done.text").alias("text"), F.col("_done.n").alias("n_changed"))


def upsert_replacement(rules: DataFrame, name: str, keywords: list[str], wrong: str, right: str) -> DataFrame:
    """Rules with one replacement set in the rule of that name and those keywords, in that order.

    An existing ``wrong`` gets the new ``right`` in its place; else it is added last, in a new
    last rule if need be. Words must be one line and not empty.
    """
    if not wrong.strip() or "\n" in wrong + right:
        raise ValueError("a replacement is one non-empty line")
    wanted = F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")
    same = (F.col("name") == name) & (F.coalesce("title_keywords", F.array().cast("array<string>")) == wanted)
    pair = F.struct(F.lit(wrong).alias("wrong"), F.lit(right).alias("right"))
    held = F.exists("replacements", lambda r: r["wrong"] == wrong)
    changed = F.when(held, F.transform("replacements", lambda r: F.when(r["wrong"] == wrong, pair).otherwise(r))).otherwise(F.concat("replacements", F.array(pair)))
    out = rules.withColumn("replacements", F.when(same, changed).otherwise(F.col("replacements")))
    if rules.where(same).isEmpty():
        last = rules.agg(F.coalesce(F.max("rule_order"), F.lit(0)) + 1).first()[0]
        fresh = rules.sparkSession.range(1).select(F.lit(last).cast("int").alias("rule_order"), F.lit(name).alias("name"), wanted.alias("title_keywords"), F.array(pair).alias("replacements"))
        out = out.unionByName(fresh)
    return out
