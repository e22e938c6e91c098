"""Glossary terms in texts: longest-match extraction, look-ups with fallbacks, and the deterministic checks.

Texts are matched against all terms at once, and the matches joined to the glossary by equality, so no text is
paired with every term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Up to so many distinct terms one pattern matches them; beyond it an automaton in Python does.
MAX_TERMS = 20_000
#: Characters of all terms together that are sent to the workers.
MAX_LETTERS = 64_000_000
#: Rows of a glossary that are sent round for the join; longer ones are joined by a shuffle.
MAX_ROWS = 100_000


def term_pattern(terms: list[str], boundary: bool = True) -> str:
    """One alternation, the longest first; a side of a term that is an ASCII letter or digit must not go on in one."""
    if len(terms) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms: term_rows takes them")
    parts = []
    for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        right = "(?![a-zA-Z0-9])" if boundary and re.search("[a-zA-Z0-9]$", t) else ""
        own = re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", t) + right
        parts.append((own, bool(boundary and re.match("[a-zA-Z0-9]", t))))
    if not parts:
        return "(?!)"
    # the look-behind stands once before all terms that need it, unless that would change their order
    if all(x for _, x in parts):
        return "(?iu)(?<![a-zA-Z0-9])(?:" + "|".join(p for p, _ in parts) + ")"
    return "(?iu)" + "|".join(("(?<![a-zA-Z0-9])" if x else "") + p for p, x in parts)


def matched_terms(text: Column, pattern: str) -> Column:
    """The distinct terms in a text, in lower case; a term inside a longer match isn't reported."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0), F.lower))


def _matched_many(spark: SparkSession, terms: list[str]):
    """The same matches by an automaton, for glossaries beyond one pattern."""
    shared = spark.sparkContext.broadcast(sorted({t.lower() for t in terms if t}))
    alnum = re.compile("[a-zA-Z0-9]")

    @F.pandas_udf("array<string>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in shared.value:
            found.add_word(t, len(t))
        found.make_automaton()

        def one(text: str | None) -> list[str]:
            low, out, at = (text or "").lower(), [], 0
            hits = sorted((end - n + 1, -n) for end, n in found.iter(low)) if len(shared.value) else []
            for start, n in hits:  # leftmost, then longest, each with free sides
                end = start - n
                left, right = low[start - 1 : start], low[end : end + 1]
                if start < at or (left and alnum.match(left) and alnum.match(low[start])) or (right and alnum.match(right) and alnum.match(low[end - 1])):
                    continue
                out.append(low[start:end])
                at = end
            return list(dict.fromkeys(out))

        for b in batches:
            yield b.map(one)

    return match


def term_rows(texts: DataFrame, key: str | list[str], text: str, terms: DataFrame, term: str, max_terms: int = MAX_TERMS, max_rows: int = MAX_ROWS) -> DataFrame:
    """The key columns and the matching rows of ``terms``: an equality join on the extracted matches.

    No row of the glossary is left out: more than ``max_terms`` distinct terms are matched by an automaton, and
    more than ``max_rows`` rows are joined by a shuffle.
    """
    keys = [key] if isinstance(key, str) else key
    named = terms.where(F.col(term).isNotNull() & (F.col(term) != ""))
    n, letters = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(term)), F.lit(0))).first()
    if letters > MAX_LETTERS:
        raise ValueError(f"the glossary has more than {MAX_LETTERS} letters: match it in parts")
    listed = [r[0] for r in named.select(term).distinct().collect()]
    found = matched_terms(F.col(text), term_pattern(listed)) if len(listed) <= max_terms else _matched_many(texts.sparkSession, listed)(F.col(text))
    hits = texts.select(*keys, F.explode(found).alias("_m"))
    rows = named.withColumn("_m", F.lower(F.col(term)))
    return hits.join(F.broadcast(rows) if n <= max_rows else rows, "_m").drop("_m")


def without_exception(value: Column) -> Column:
    """A glossary value without its ``(EXCEPTION: ...)`` remark."""
    return F.trim(F.regexp_replace(value, "(?i)\\s*\\(EXCEPTION:[^)]*\\)", ""))


def longest_first(values: Column) -> Column:
    """Distinct, trimmed, not empty, the longest first, equal lengths by letter."""
    clean = F.array_distinct(F.filter(F.transform(values, without_exception), lambda x: x != ""))
    return F.transform(F.array_sort(F.transform(clean, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("v")))), lambda s: s["v"])


def flexible_value(entries: Column, wanted: Column) -> Column:
    """Value of a key in an array of ``struct<key, value>``: the exact key (if its value isn't empty), then without letter case, then where one contains the other; the first in order each time."""
    low = F.lower(wanted)
    first = lambda test: F.get(F.filter(entries, test), F.lit(0))["value"]
    exact = first(lambda e: (e["key"] == wanted) & (e["value"] != ""))
    folded = first(lambda e: F.lower(e["key"]) == low)
    part = first(lambda e: F.lower(e["key"]).contains(low) | low.contains(F.lower(e["key"])))
    return F.coalesce(exact, folded, part)


def longest_contained(entries: Column, wanted: Column) -> Column:
    """Value of the exact key, letter case aside, else of the longest key that stands in the name; equally long ones by letter."""
    low = F.lower(wanted)
    same = F.get(F.filter(entries, lambda e: F.lower(e["key"]) == low), F.lit(0))["value"]
    inside = F.filter(entries, lambda e: (e["key"] != "") & low.contains(F.lower(e["key"])))
    ranked = F.array_sort(F.transform(inside, lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.coalesce(same, F.get(ranked, F.lit(0))["value"])


def glossary_line(term: Column, code: Column, value: Column, rule: Column) -> Column:
    """One line of a glossary for a prompt; null without a value."""
    told = F.when(F.coalesce(rule, F.lit("")) != "", F.concat(F.lit(" (rule: "), rule, F.lit(")"))).otherwise("")
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit("- "), term, F.lit(" → "), code, F.lit(": "), value, told))


def glossary_entry(value: Column, rule: Column, row_key: Column) -> Column:
    """A value as a prompt's glossary has it: with a remark where it must stand without brackets, outside titles and buttons."""
    remark = F.concat(value, F.lit(" (EXCEPTION: Do NOT wrap '"), value, F.lit("' in brackets)"))
    return F.when((T.context_mode(row_key) != "title_button") & T.needs_no_brackets(rule), remark).otherwise(value)


def is_missing(target: Column, value: Column) -> Column:
    """The glossary's value stands nowhere in the text, letter case aside."""
    return (value != "") & ~F.contains(F.lower(F.coalesce(target, F.lit(""))), F.lower(value))


def casing_differs(target: Column, value: Column) -> Column:
    """The first place where the value stands, letter case aside, is written differently."""
    at = F.instr(F.lower(target), F.lower(value))
    return (value != "") & (at > 0) & (F.substring(target, at, F.length(value)) != value)


def literal(c: Column) -> Column:
    """A value quoted for use in a pattern."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _paths_masked(text: Column, opening: str, closing: str) -> Column:
    """Each quoted run with a ``>`` in it as one mark; quotes are paired in order."""
    run = f"{opening}[^{closing}]*{closing}"
    rests, runs = F.split(text, run, -1), F.regexp_extract_all(text, F.lit(run), 0)
    masked = F.transform(runs, lambda q: F.when(q.contains(">"), F.lit("\u0001")).otherwise(q))
    return F.array_join(F.zip_with(rests, masked, lambda r, q: F.concat(r, F.coalesce(q, F.lit("")))), "")


def bracket_issue(target: Column, value: Column, language: Column, row_key: Column, rule: Column) -> Column:
    """``missing`` where the value stands without its brackets, ``forbidden`` where it has some but is free of them by its row or rule; else null.

    All places are looked at, letter case aside, but in a disclaimer those inside navigation paths; a remark in
    the value's round brackets is no part of it; a term that is switched off has no issue.
    """
    opening, closing = T.bracket_pair(language)
    bare = F.trim(F.regexp_replace(value, "\\(.*?\\)", ""))
    plain = F.coalesce(target, F.lit(""))
    masked = _paths_masked(plain, '"', '"')
    masked = F.when(F.coalesce(language, F.lit("")).contains("Japan"), _paths_masked(masked, "「", "」")).otherwise(masked)
    text = F.when(T.context_mode(row_key) == "disclaimer", masked).otherwise(plain)
    rests = F.split(text, F.concat(F.lit("(?iu)"), literal(bare)), -1)
    inside = F.zip_with(F.slice(rests, 1, F.size(rests) - 1), F.slice(rests, 2, F.size(rests) - 1), lambda a, b: a.endswith(opening) & b.startswith(closing))
    free = (T.context_mode(row_key) == "title_button") | T.needs_no_brackets(rule)
    found = F.when(free & F.exists(inside, lambda x: x), "forbidden").when(~free & F.exists(inside, lambda x: ~x), "missing")
    return F.when((bare != "") & ~T.switched_off(rule), found)


def navigation_paths(text: Column, japanese: Column | None = None) -> Column:
    """Quoted runs with a ``>`` in them; with ``japanese`` those in corner brackets too."""
    runs = F.regexp_extract_all(text, F.lit('"[^"]*"'), 0)
    corner = F.regexp_extract_all(text, F.lit("「[^」]*」"), 0)
    runs = F.concat(runs, corner if japanese is None else F.when(japanese, corner).otherwise(F.array().cast("array<string>")))
    return F.filter(runs, lambda x: x.contains(">"))


def sentences(text: Column) -> Column:
    """The pieces after ``.!?`` and white space, that of Unicode included."""
    return F.filter(F.split(F.regexp_replace(text, "(?U)\\A\\s+|\\s+\\z", ""), "(?U)(?<=[.!?])\\s+"), lambda x: x != "")


def extra_capitals(text: Column) -> Column:
    """Capitals beyond the first letter of each sentence."""
    total = F.regexp_count(text, F.lit("\\p{Lu}"))
    first = F.size(F.filter(sentences(text), lambda s: F.regexp_extract(s, "\\p{L}", 0).rlike("\\p{Lu}")))
    return F.greatest(total - first, F.lit(0))


_HEAD, _REST = "^([^\\p{L}]*)\\p{L}", "(?s)^[^\\p{L}]*\\p{L}(.*)$"


def _cased(s: Column) -> Column:
    first = F.regexp_extract(s, "\\p{L}", 0)
    return F.when(first == "", s).otherwise(F.concat(F.regexp_extract(s, _HEAD, 1), F.upper(first), F.lower(F.regexp_extract(s, _REST, 1))))


def sentence_case(text: Column) -> Column:
    """Each sentence in lower case but for its first letter; a sentence without a letter stays."""
    return F.array_join(F.transform(sentences(text), _cased), " ")


def sentence_case_report(text: Column, language: Column) -> Column:
    """``array<struct<sentence, cased, extra>>`` for the sentences that hold a letter: whether only the first letter is a capital, and how many others are; null for languages without sentence case and for blank texts."""
    told = F.transform(
        sentences(text),
        lambda s, i: F.struct(
            (i + 1).alias("sentence"),
            (F.regexp_extract(s, "\\p{L}", 0).rlike("\\p{Lu}") & (F.regexp_extract(s, _REST, 1) == F.lower(F.regexp_extract(s, _REST, 1)))).alias("cased"),
            F.regexp_count(F.regexp_extract(s, _REST, 1), F.lit("\\p{Lu}")).alias("extra"),
            F.regexp_extract(s, "\\p{L}", 0).alias("first"),
        ),
    )
    held = F.transform(F.filter(told, lambda x: x["first"] != ""), lambda x: F.struct(x["sentence"], x["cased"], x["extra"]))
    return F.when(T.writes_sentence_case(language) & (F.size(sentences(text)) > 0), held)


def sentence_case_fix(text: Column, language: Column, values: list[str] = ()) -> Column:
    """The text in sentence case with the values in their own letter case; null where nothing changes or the language has none."""
    fixed = restore_casing(sentence_case(text), list(values))
    return F.when(T.writes_sentence_case(language) & (F.size(sentences(text)) > 0) & (fixed != text), fixed)


def restore_casing(text: Column, values: list[str]) -> Column:
    """Each value put back in its own letter case, the longest first; a side that is a letter or digit must not go on in an ASCII one."""
    out = text
    for v in sorted({v for v in values if v}, key=lambda v: (-len(v), v)):
        left = "(?<![a-zA-Z0-9])" if v[0].isalnum() else ""
        right = "(?![a-zA-Z0-9])" if v[-1].isalnum() else ""
        out = F.regexp_replace(out, F.lit(f"(?iu){left}\\Q{v}\\E{right}"), F.lit(v.replace("\\", "\\\\").replace("$", "\\$")))
    return out


def without_brackets(text: Column, values: list[str]) -> Column:
    """Square and corner brackets round the values taken off, with the spaces inside them."""
    out = text
    for v in sorted({v for v in values if v}, key=lambda v: (-len(v), v)):
        out = F.regexp_replace(out, F.lit(f"(?iu)[\\[「]\\s*(\\Q{v}\\E)\\s*[\\]」]"), F.lit("$1"))
    return out


def highlight_terms(value: Column) -> Column:
    """A value, the value without brackets, and its parts between commas or slashes where there are several."""
    whole = F.trim(value)
    bare = F.trim(F.regexp_replace(whole, "\\([^)]*\\)", ""))
    parts = F.transform(F.split(bare, "[,/]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.array_union(F.array(whole, bare), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))), lambda x: x != ""))


def text_segments(text: Column, pattern: str) -> Column:
    """The text cut into matches and what stands between: ``array<struct<text, hit>>``."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 0)
    rests = F.split(text, pattern)
    pairs = F.transform(F.sequence(F.lit(0), F.size(rests) - 1), lambda i: F.array(F.struct(rests[i].alias("text"), F.lit(False).alias("hit")), F.struct(F.coalesce(F.get(hits, i), F.lit("")).alias("text"), F.lit(True).alias("hit"))))
    return F.filter(F.flatten(pairs), lambda s: s["text"] != "")
