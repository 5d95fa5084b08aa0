"""Display titles of groups, merged from the file names of their members."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomatch.functions.text import let, stem
from foliomatch.functions.udfs import deferred

# What stands for an unknown part, and spellings of it.
UNKNOWN = "ㅁㅁㅁㅁ"
UNKNOWN_SPELLINGS = ("", "알수없음", "알 수 없음", "unknown", UNKNOWN, "?")
# Bracketed words that name no author.
EDITION_WORDS = (
    "컬러", "컬러판", "color", "colour", "흑백", "흑백판", "bw", "번역", "번역판", "무삭제", "검열", "검열판", "모자이크", "고화질",
    "저화질", "리사이즈", "resize", "resized", "scan", "scanned", "한국어", "일본어", "영어", "kor", "kr", "jp", "jpn", "eng",
)
# A part in brackets, and a circle with its author.
BRACKETED = r"\[[^\[\]]*\]|\((?:[^()]|\([^()]*\))*\)"
CIRCLE = r"^(.*?)\((.*?)\)$"
PARTS = ("circle", "author", "title", "attribute")
VALUES = "array<struct<part:string,i:int,value:string>>"


@deferred("array<string>")
def nfc_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [] if xs is None else [unicodedata.normalize("NFC", x) for x in xs if x is not None])


def title_parts(path: Column) -> Column:
    """Struct of arrays ``circle``, ``author``, ``title`` and ``attribute`` with the values of one file name in NFC.

    The maker is the first part in square brackets before any other text that is a circle with its author or no edition
    word; all other parts in brackets are attributes, and what stands outside them is the title.
    """
    def judged(x: Column) -> Column:
        inside = F.transform(x["parts"], lambda p: F.trim(F.substring(p, F.lit(2), F.length(p) - 2)))
        number = F.transform(x["parts"], lambda p, i: i + 1)

        def makes(i: Column) -> Column:
            before = F.array_join(F.slice(x["plain"], F.lit(1), i), "")
            name = F.element_at(inside, i)
            leads = F.element_at(x["parts"], i).startswith("[") & (F.trim(before) == "")
            return leads & (name.rlike(CIRCLE) | ~F.lower(name).isin(*EDITION_WORDS))

        maker = F.try_element_at(F.filter(number, makes), F.lit(1))

        def by_maker(m: Column) -> Column:
            name = F.try_element_at(inside, m["at"])
            paired = F.coalesce(name.rlike(CIRCLE), F.lit(False))
            group = lambda g: F.regexp_extract(name, CIRCLE, g)
            return F.struct(
                F.array(F.when(paired, group(1))).alias("circle"),
                F.array(F.when(paired, group(2)).otherwise(name)).alias("author"),
                F.array(F.regexp_replace(F.trim(F.array_join(x["plain"], " ")), r"\s+", " ")).alias("title"),
                F.filter(inside, lambda v, i: m["at"].isNull() | (i + 1 != m["at"])).alias("attribute"),
            )

        return let(F.struct(maker.alias("at")), by_maker)

    name = F.translate(stem(path), "［］（）", "[]()")
    split = lambda t: F.struct(F.regexp_extract_all(t, F.lit(BRACKETED), F.lit(0)).alias("parts"), F.split(t, BRACKETED, -1).alias("plain"))
    return let(let(name, split), judged)


def distinct_known(values: Column) -> Column:
    """Known values in order of appearance, each once whatever its case, in the spelling that comes first."""
    known = F.filter(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.trim(v)), lambda v: ~F.lower(v).isin(*UNKNOWN_SPELLINGS))
    return let(known, lambda k: F.filter(k, lambda v, i: F.array_position(F.transform(k, lambda w: F.lower(w)), F.lower(v)) == i + 1))


def work_label(paths: Column) -> Column:
    """``[circle(author)] title (attributes)`` of an array of paths; several values of a part are joined by slashes.

    Null paths do not count, and a part that no path names is ``UNKNOWN``.
    """
    def joined(parts: Column) -> Column:
        def one(name: str) -> Column:
            text = F.array_join(distinct_known(F.flatten(F.transform(parts, lambda p: p[name]))), " / ")
            return F.when(text == "", UNKNOWN).otherwise(text)

        circle, author, title, attribute = (one(p) for p in PARTS)
        return F.concat(F.lit("["), circle, F.lit("("), author, F.lit(")] "), title, F.lit(" ("), attribute, F.lit(")"))

    return let(F.transform(nfc_all(paths), title_parts), joined)


def work_labels(names: DataFrame) -> DataFrame:
    """``(component, label)``: ``work_label`` of the paths of each component of ``names(component, at, path)`` in order of ``at``.

    Equal paths are read once, and a value is kept once for each spelling whatever its case, by aggregation; so what a
    component gathers is what its label holds, and no more.
    """
    composed = names.select("component", "at", F.get(nfc_all(F.array("path")), F.lit(0)).alias("path"))
    paths = composed.groupBy("component", "path").agg(F.min("at").alias("at"))
    parts = paths.select("component", "at", title_parts(F.col("path")).alias("t"))

    def named(name: str) -> Column:
        return F.transform(F.col(f"t.{name}"), lambda v, i: F.struct(F.lit(name).alias("part"), i.alias("i"), F.trim(v).alias("value")))

    values = F.filter(F.concat(*[named(p) for p in PARTS]), lambda x: x["value"].isNotNull() & ~F.lower(x["value"]).isin(*UNKNOWN_SPELLINGS))
    rows = parts.select("component", "at", F.explode_outer(F.coalesce(values, F.array().cast(VALUES))).alias("v"))
    firsts = rows.groupBy("component", "v.part", F.lower("v.value").alias("same")).agg(F.min(F.struct("at", "v.i", "v.value")).alias("f"))

    def one(name: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("part") == name, F.col("f"))))
        return F.array_join(F.transform(found, lambda f: f["value"]), " / ").alias(name)

    joined = firsts.groupBy("component").agg(*[one(p) for p in PARTS])
    circle, author, title, attribute = (F.when(F.col(p) == "", UNKNOWN).otherwise(F.col(p)) for p in PARTS)
    return joined.select("component", F.concat(F.lit("["), circle, F.lit("("), author, F.lit(")] "), title, F.lit(" ("), attribute, F.lit(")")).alias("label"))
