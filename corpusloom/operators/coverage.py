"""Glossary coverage, gaps, prompt sections and reports as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def _pairs(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """Every term with every language, its own array exploded: both come from one small file."""
    all_languages = languages.agg(F.array_sort(F.collect_list(F.struct("lang_pos", "lang"))).alias("ls"))
    each = terms.join(F.broadcast(all_languages)).select("*", F.explode("ls").alias("l")).drop("ls")  # one row
    return each.select("*", F.col("l.lang_pos").alias("lang_pos"), F.col("l.lang").alias("lang")).drop("l").withColumn("translation", F.try_element_at("translations", "lang"))


def translated(terms: DataFrame, languages: DataFrame) -> DataFrame:
    return _pairs(terms, languages).where(_given(F.col("translation"))).select("term_pos", "canonical", "lang_pos", "lang", "translation")


def missing(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """``canonical, missing_languages`` of terms that lack a language, in the languages' order; an empty translation lacks."""
    gaps = _pairs(terms, languages).where(~_given(F.col("translation")))
    found = gaps.groupBy("term_pos", "canonical").agg(F.array_sort(F.collect_list(F.struct("lang_pos", "lang"))).alias("m"))
    return found.select("term_pos", "canonical", F.transform("m", lambda x: x["lang"]).alias("missing_languages"))


def coverage(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """``lang, translated, total, terms``; a language without terms stays."""
    done = translated(terms, languages).groupBy("lang").agg(F.count("*").alias("translated"), F.array_sort(F.collect_list(F.struct("term_pos", "canonical"))).alias("t"))
    total = terms.agg(F.count("*").alias("total"))
    out = languages.join(done, "lang", "left").join(F.broadcast(total))  # one row
    return out.select("lang_pos", "lang", F.coalesce("translated", F.lit(0)).alias("translated"), "total", F.coalesce(F.transform("t", lambda x: x["canonical"]), F.array().cast("array<string>")).alias("terms"))


def stub_count(terms: DataFrame, languages: DataFrame) -> DataFrame:
    return missing(terms, languages).agg(F.coalesce(F.sum(F.size("missing_languages")), F.lit(0)).alias("stubs"))


def _quoted(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ", ")


def prompt_section(terms: DataFrame, lang: str) -> DataFrame:
    """One row ``section``: the terms a prompt for ``lang`` should name, or an empty text."""
    own, bad = F.try_element_at("translations", F.lit(lang)), F.try_element_at("do_not_use", F.lit(lang))
    named = terms.where(_given(own) | bad.isNotNull())
    line = F.concat(F.lit('- "'), "canonical", F.lit('" → "'), F.coalesce(own, F.col("canonical")), F.lit('"'))
    line = F.concat(line, F.when(F.size(F.coalesce(bad, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" (do NOT use: "), _quoted(bad), F.lit(")"))).otherwise(""))
    lines = named.select("term_pos", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("term_pos", "line"))).alias("l"))
    head = F.lit("\nGlossary — use these canonical translations and avoid forbidden terms:\n")
    return lines.select(F.when(F.size("l") == 0, F.lit("")).otherwise(F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"))).alias("section"))


def review(terms: DataFrame, languages: DataFrame) -> DataFrame:
    """One row ``report``: the glossary in Markdown."""

    def entries(keys, values, text):
        return F.array_join(F.transform(keys, lambda k: F.concat(F.lit("  - `"), k, F.lit("`: "), text(F.try_element_at(values, k)), F.lit("\n"))), "")

    own = entries(F.col("langs"), F.col("translations"), lambda v: v)
    bad = F.when(F.size("bad_langs") > 0, F.concat(F.lit("- **Do not use:**\n"), entries(F.col("bad_langs"), F.col("do_not_use"), lambda v: F.array_join(v, ", ")))).otherwise("")
    block = F.concat(F.lit("### "), "canonical", F.lit("\n\n- **Type:** "), F.coalesce("type", F.lit("")), F.lit("\n- **Translations:**\n"), own, bad)
    parts = terms.select("term_pos", block.alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("term_pos", "b"))).alias("l"))
    langs = languages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang_pos", "lang"))), lambda x: x["lang"]), ", ").alias("langs"))
    head = F.concat(F.lit("# Glossary Review Report\n\n**Total Terms:** "), F.col("n").cast("string"), F.lit("\n**Languages:** "), "langs", F.lit("\n\n## Terms\n\n"))
    return parts.join(F.broadcast(langs)).select(F.concat(head, F.array_join(F.transform("l", lambda x: x["b"]), "\n")).alias("report"))  # one row each
