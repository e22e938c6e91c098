"""Column expressions on texts, labels and codes. All are built from Spark's own functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic quotes and their ASCII twins
QUOTES, PLAIN_QUOTES = "“”‘’", "\"\"''"
# Short texts that are never taken for a placeholder
KEPT_SHORT = ["ok", "on", "off", "ai", "5g", "go", "up", "usb", "nfc"]
# Sheet heads whose source is Korean; all others have an English source
FROM_KOREAN = ["JA", "CN", "TW", "US"]
# Languages that write sentence case, as a language's name begins
CASED_LANGUAGES = ["English", "German", "French", "Spanish", "Portuguese", "Italian", "Dutch", "Swedish", "Polish", "Turkish", "Indonesian", "Vietnamese", "Russian"]
# Marks of a rule that switches a term off, or frees it from brackets
SWITCHED_OFF, NO_BRACKETS = "비활성화|deactivate|disable", "no bracket|대괄호 제외|괄호 제외"
# Full names of languages and the code of their sheet
LANGUAGE_HEADS = {
    "korean": "KR", "english": "US", "english_us": "US", "english_uk": "UK", "english_au": "AU", "english_sg": "SG", "german": "DE", "japanese": "JA", "french": "FR",
    "french_belgium": "BE", "french_canada": "CA", "italian": "IT", "spanish": "ES", "dutch": "NL", "swedish": "SE", "arabic": "AE", "russian": "RU", "turkish": "TR",
    "polish": "PL", "vietnamese": "VN", "thai": "TH", "indonesian": "ID", "chinese": "CN", "chinese_simplified": "CN", "chinese_traditional": "TW", "taiwanese": "TW",
    "portuguese": "PT", "portuguese_br": "BR", "portuguese_brazil": "BR",
}


def compose(c: Column) -> Column:
    """Unicode NFKC inside the JVM, by the ICU library that Spark ships for its collations; ``c`` must not be null."""
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


def straight(c: Column) -> Column:
    """Typographic quotes made straight, white space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), QUOTES, PLAIN_QUOTES), "(?U)\\s+", " "))


def normalize_text(c: Column) -> Column:
    """``straight`` after Unicode NFKC; plain ASCII needs none."""
    plain = F.coalesce(c, F.lit(""))
    return straight(F.when(plain.rlike("[^\\x00-\\x7F]"), compose(plain)).otherwise(plain))


def is_placeholder_text(c: Column, marks: Iterable[str] = ("x", "none")) -> Column:
    """Null, blank, or one of the marks in any letter case."""
    return c.isNull() | F.lower(F.trim(c)).isin("", *marks)


def skip_pair(source: Column, target: Column, kept: Iterable[str] = ()) -> Column:
    """Pairs that need no check: an ``x`` on a side, equal and short, or blank on both sides; listed short texts are never skipped."""
    s, t = F.trim(F.coalesce(source, F.lit(""))), F.trim(F.coalesce(target, F.lit("")))
    ls, lt = F.lower(s), F.lower(t)
    listed = [*KEPT_SHORT, *(k.lower() for k in kept)]
    same = ls == lt
    skip = (ls == "x") | (lt == "x") | (same & (F.length(s) <= 2) & (F.length(t) <= 2)) | ((s == "") & (t == "")) | (same & (F.length(s) < 10))
    return F.when(ls.isin(listed) | lt.isin(listed), F.lit(False)).otherwise(skip)


def label_head(c: Column) -> Column:
    """What stands before the first bracket of a sheet name, in capitals."""
    return F.upper(F.trim(F.split(c, "[(（]")[0]))


def source_group(sheet: Column) -> Column:
    """``kr`` for the sheets translated from Korean, else ``us``; null for a null sheet."""
    return F.when(label_head(sheet).isin(FROM_KOREAN), "kr").when(sheet.isNotNull(), "us")


def has_korean(c: Column) -> Column:
    return c.rlike("[가-힣]")


def collection_of(language: Column) -> Column:
    """``kr`` if the language's name has ``korea`` in it or is ``ko``, else ``us``."""
    low = F.lower(F.coalesce(language, F.lit("")))
    return F.when(low.contains("korea") | (low == "ko"), "kr").otherwise("us")


def language_code(c: Column, strict: bool = False) -> Column:
    """A head of two or three letters in capitals, else a full name by the table (blanks and hyphens as underscores); else null, or with ``strict`` an error."""
    whole = F.trim(c)
    head = F.trim(F.split(whole, "[(（]")[0])
    named = F.create_map(*[F.lit(x) for kv in LANGUAGE_HEADS.items() for x in kv])[F.translate(F.lower(whole), " -", "__")]
    code = F.when(head.rlike("^[A-Za-z]{2,3}$"), F.upper(head)).otherwise(named)
    return F.when(code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit("no language: "), F.coalesce(c, F.lit("null"))))) if strict else code


def context_mode(row_key: Column) -> Column:
    """The kind of row a key stands for; the order of the tests matters."""
    k = F.lower(F.coalesce(row_key, F.lit("")))
    return (
        F.when(k.contains("disclaimer"), "disclaimer")
        .when(k.contains("description"), "description")
        .when(k.contains("title") | k.contains("button") | k.rlike("[0-9]$"), "title_button")
        .otherwise("description")
    )


def writes_sentence_case(language: Column) -> Column:
    return language.rlike("^(" + "|".join(CASED_LANGUAGES) + ")")


def switched_off(rule: Column) -> Column:
    """True where a term's rule switches the term off; spaces in the rule don't matter."""
    return F.regexp_replace(F.lower(F.coalesce(rule, F.lit(""))), " ", "").rlike(SWITCHED_OFF)


def needs_no_brackets(rule: Column) -> Column:
    return F.lower(F.coalesce(rule, F.lit(""))).rlike(NO_BRACKETS)


def bracket_pair(language: Column) -> tuple[Column, Column]:
    """The opening and closing bracket in use: corner brackets in Japanese, square ones elsewhere."""
    ja = F.coalesce(language, F.lit("")).contains("Japan")
    return F.when(ja, "「").otherwise("["), F.when(ja, "」").otherwise("]")


def story_code(c: Column) -> Column:
    """The digits at the end, padded to three places but never cut; null where there are none."""
    digits = F.regexp_extract(F.trim(c), "([0-9]+)$", 1)
    return F.when(digits == "", None).when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)


def clean_text(c: Column) -> Column:
    """Trimmed; an empty text becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def token_estimate(c: Column) -> Column:
    """Tokens by rule of thumb: a token for each 1.5 characters of East Asian script and for each four others, rounded half to even."""
    n = F.regexp_count(c, F.lit("[\\u3000-\\u9FFF\\uF900-\\uFAFF\\uAC00-\\uD7A3]"))
    return F.bround(n / F.lit(1.5) + (F.length(c) - n) / F.lit(4.0), 0).cast("long")


def html_escape(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def markdown_bold(c: Column) -> Column:
    return F.regexp_replace(c, "\\*\\*(.+?)\\*\\*", "<strong>$1</strong>")


def preview(c: Column, most: int = 80) -> Column:
    """The first characters, with an ellipsis where something was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def percent(part: Column, whole: Column) -> Column:
    """A share in whole percent, half up; an empty whole counts as one."""
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), 0).cast("long")


def column_number(letters: Column) -> Column:
    """Spreadsheet column letters to a number from one on (up to three letters)."""
    at = lambda i: F.coalesce(F.ascii(F.substring(F.lpad(F.upper(letters), 3, "@"), i, 1)) - 64, F.lit(0))
    return at(1) * 676 + at(2) * 26 + at(3)


def cell_name(cell: Column, col: Column, row: Column) -> Column:
    """``cell`` in capitals if given, else made of a column (letter or number) and a row; null where neither is whole."""
    number = col.try_cast("int")
    low = F.char(F.lit(65) + F.pmod(number - 1, F.lit(26)))
    high = F.when(number > 26, F.char(F.lit(64) + F.floor((number - 1) / 26).cast("int"))).otherwise("")
    letters = F.when(number.isNotNull(), F.concat(high, low)).otherwise(F.upper(col))
    return F.coalesce(F.upper(F.nullif(F.trim(cell), F.lit(""))), F.concat(letters, row.cast("string")))


def formula_key(formula: Column, story: Column) -> Column:
    """The value of a key formula such as ``="//section_"&RIGHT($C$5,3)&"_1_button"``; other contents as they are.

    Literal parts are joined with the last three digits of the story's number; the outcome counts only if it
    starts with ``//``.
    """
    number = F.lpad(F.right(F.regexp_extract(F.coalesce(story, F.lit("")), "(\\d+)\\D*$", 1), F.lit(3)), 3, "0")
    parts = F.split(F.regexp_replace(formula, "^=", ""), "&")
    value = F.array_join(F.transform(parts, lambda p: F.when(F.trim(p).startswith('"'), F.regexp_replace(F.trim(p), '^"|"$', "")).otherwise(number)), "")
    return F.when(formula.startswith("=") & value.startswith("//"), value).otherwise(formula)


def input_formatting(language: Column, row_key: Column) -> Column:
    """``struct<prefix, suffix>`` round glossary terms: empty for titles and buttons."""
    opening, closing = bracket_pair(language)
    bare = context_mode(row_key) == "title_button"
    return F.struct(F.when(bare, "").otherwise(opening).alias("prefix"), F.when(bare, "").otherwise(closing).alias("suffix"))


def model_choice(c: Column) -> Column:
    """``model:variant`` as ``struct<model, thinking_budget, reasoning_effort>``; other variants leave the defaults."""
    parts = F.split(c, ":")
    variant = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    effort = F.when(variant.isin("reasoning_high", "reasoning_medium", "reasoning_low"), F.substring(variant, 11, 20))
    return F.struct(parts[0].alias("model"), F.when(variant == "thinking_off", 0).alias("thinking_budget"), effort.alias("reasoning_effort"))


def provider(model: Column, marks: str = "gpt|o1|o3|o4", named: str = "gpt", other: str = "default") -> Column:
    """Which of two providers a model's name belongs to."""
    return F.when(F.lower(model).rlike(marks), named).otherwise(other)


def capability_level(app: Column, source: Column, memory: Column, vectors: Column, key: Column, glossary: Column, python: Column) -> Column:
    """From 1 (workbooks only) over 2 (memory) and 3 (vectors) to 4 (all), by what is at hand."""
    semantic = memory & vectors & key
    return F.when(~(app & source), 1).when(semantic & glossary & python, 4).when(semantic, 3).when(memory, 2).otherwise(1)


def first_given(**choices: Column) -> Column:
    """``struct<name, value>`` of the first choice that is neither null nor blank, in the order given; both null where there is none."""
    name = value = None
    for n, c in choices.items():
        held = F.trim(F.coalesce(c, F.lit(""))) != ""
        name = F.when(held, n) if name is None else name.when(held, n)
        value = F.when(held, c) if value is None else value.when(held, c)
    return F.struct(name.alias("name"), value.alias("value"))


def dated(given: Column, today: Column | None = None) -> Column:
    """A given date as it is, else today's as ``yyyy.MM.dd``."""
    return F.coalesce(clean_text(given), F.date_format(F.current_date() if today is None else today, "yyyy.MM.dd"))


def stamped(name: Column, at: Column) -> Column:
    """A file's name with a time before its ending."""
    return F.concat(F.regexp_replace(name, "\\.[^.]*$", ""), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.regexp_extract(name, "(\\.[^.]*)$", 1))
