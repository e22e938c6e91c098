"""JSON payloads and labelled blocks inside texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVALUATION = "struct<evaluation:array<struct<category:string,comment:string>>,grade:string,suggested_fix:string,is_excellent:boolean>"


def salvaged(c: Column) -> Column:
    """The outermost braces of a reply, code fences aside; null where there are none."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "(?s)(\\{.*\\})", 1), F.lit(""))


def evaluation(c: Column) -> Column:
    """A reply as a struct; null where it can't be read."""
    return F.from_json(salvaged(c), EVALUATION)


def reply_grade(c: Column, default: str = "Needs Revision") -> Column:
    e = evaluation(c)
    return F.coalesce(e["grade"], F.when(e["is_excellent"], "Excellent"), F.lit(default))


def comments(c: Column) -> Column:
    return F.array_join(F.transform(evaluation(c)["evaluation"], lambda x: F.concat_ws(": ", x["category"], x["comment"])), "; ")


def block(text: Column, name: str) -> Column:
    """What stands after the label ``[상세 - name]`` up to the next such label or the end."""
    return F.regexp_replace(F.regexp_extract(text, f"(?s)\\[상세 - \\Q{name}\\E\\](.*?)(?:\\n\\[상세 - |\\z)", 1), "^\\s+|\\s+$", "")


def field(text: Column, labels: list[str]) -> Column:
    """The rest of the first line that starts with one of the labels and a colon."""
    return F.trim(F.regexp_extract(text, "(?m)^(?:" + "|".join(labels) + "):[ \\t]*(.*)$", 1))


def words(c: Column) -> Column:
    """The runs between white space, that of Unicode included."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "(?U)[\\s\\uFEFF]+"), lambda w: w != "")


def word_changes(original: Column, suggested: Column) -> Column:
    """Each suggested word as ``same``, ``case`` or ``new`` beside the words of the original."""
    own = words(original)
    low = F.transform(own, F.lower)
    return F.transform(words(suggested), lambda w: F.struct(w.alias("word"), F.when(F.array_contains(own, w), "same").when(F.array_contains(low, F.lower(w)), "case").otherwise("new").alias("change")))


#: Blocks of a report's item whose contents decide its status.
CASING, GLOSSARY, ANSWER = "casing", "glossary", "answer"
# Marks in an item's blocks
NO_EXTRA, NOT_CASED, NO_REMARK, FAILED = "추가 대문자 수: 0개", "문장형 아님", "별도 지적 사항 없음", ["[AI QA 오류]", "[Gemini QA 오류]"]
REVISE, SUGGEST = ["Needs Revision", "수정 필요", "오류"], ["수정 제안", "Good", "양호"]


def item_status(casing: Column, glossary: Column, answer: Column) -> Column:
    """``struct<status, tags>`` of a report's item: pass, warn or fail by the answer's JSON, or by its words where it is none; tags casing, glossary, error and suggestion."""
    text = F.coalesce(answer, F.lit(""))
    has = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: text.contains(m))
    told = F.try_parse_json(F.when(F.trim(text).startswith("{"), text))
    get = lambda path, kind: F.try_variant_get(told, path, kind)
    grade, excellent = get("$.grade", "string"), get("$.is_excellent", "boolean")
    good = F.coalesce(excellent, F.lit(False)) | (F.coalesce(grade, F.lit("")) == "Excellent")
    revise = (F.coalesce(grade, F.lit("")) == "Needs Revision") | ~F.coalesce(excellent, F.lit(True))
    fix = (F.trim(F.coalesce(get("$.suggested_fix", "string"), F.lit(""))) != "") | (F.coalesce(grade, F.lit("")) == "Good")
    by_json = F.when(revise, "fail").when(fix | ~good, "warn").otherwise("pass")
    by_words = F.when(has(REVISE), "fail").when(has(SUGGEST), "warn").otherwise("pass")
    status = F.when(text == "", "pass").when(has(FAILED), "fail").when(told.isNotNull(), by_json).otherwise(by_words)
    own = F.coalesce(casing, F.lit(""))
    words = F.coalesce(glossary, F.lit(""))
    tags = F.array_compact(F.array(
        F.when(own.contains(NOT_CASED) & ~own.contains(NO_EXTRA), CASING), F.when((words != "") & ~words.contains(NO_REMARK), GLOSSARY), F.when(has(FAILED), "error"), F.when((status == "warn") & (text != ""), "suggestion")
    ))
    return F.struct(status.alias("status"), tags.alias("tags"))
