"""One consistent form for texts that look alike: width, composition, invisible marks, spaces, look-alike letters.

Everything runs inside the JVM. Width and compatibility forms and decomposed letters are composed (NFKC)
without touching punctuation; invisible marks go; odd spaces become U+0020. Look-alike letters are repaired
by script: the dominant script of a token is found, and in a token of mixed scripts the foreign letters are
replaced if the result is a word of the corpus. The corpus vocabulary (words of the repaired forms) is never
gathered anywhere: only the candidate words are, and the corpus is joined to them.

The method repairs mixed tokens only. Two kinds of case go beyond it, as the problem asks for every letter of
another script that stands in for the text's own; ``kinds`` tells them apart: ``form`` (width, composition,
invisible marks, spaces), ``mixed`` (the method's rule), ``whole`` (a token wholly of look-alikes in a text or
beside a word of another script, if its repair is a word of the corpus), ``unknown`` (a mixed token whose
repair is no word of the corpus: reported, not changed).

Defined cases: null stays null, an empty text stays empty; a mixed token with a foreign letter that looks like
none is ordinary text; of two repairs equally frequent the first in order of letters is taken; repeated rows
are repaired alike. Texts of any length are treated whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compose
from ..session import cut
from .forms import INVISIBLE, LOOKALIKE_FROM, LOOKALIKE_TO

ALPHABETS = "[\\p{IsCyrillic}\\p{IsGreek}]"
TOKEN = "[\\p{L}\\p{M}]+"
# compatibility jamo have no precomposed twin and are ordinary letters in chat; they are left alone
_JAMO = "".join(map(chr, range(0x3131, 0x318F)))
_HIDE = "".join(map(chr, range(0xE000, 0xE000 + len(_JAMO))))
_CUT = "\x01"
#: A text of these characters only holds no case: ASCII, accented Latin, Greek, Cyrillic,
#: Hangul, kana, Han, usual punctuation (look-alike letters are looked for on their own, below).
#: It is one short list of ranges, as this look is taken at every character of the corpus.
USUAL = "\\A[\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u01C3\\u0386-\\u03CE\\u0400-\\u045F\\u1E00-\\u1EFF\\uAC00-\\uD7A3\\u3041-\\u3096\\u30A1-\\u30FE\\u4E00-\\u9FFF\\u3001-\\u3011\\uFF01-\\uFF0F\\uFF1A-\\uFF1F\\u2010-\\u2027]*\\z"
#: A Latin letter beside a letter of another alphabet, marks and hidden characters between them included.
MIXED = f"\\p{{IsLatin}}[\\p{{M}}{INVISIBLE}]*{ALPHABETS}|{ALPHABETS}[\\p{{M}}{INVISIBLE}]*\\p{{IsLatin}}"
#: Letters of the other alphabets that no Latin letter looks like: a text that has one holds real words of them.
OWN = f"[\\p{{IsCyrillic}}\\p{{IsGreek}}&&[^{LOOKALIKE_FROM}]]"
# Latin letters as their Cyrillic twins, from the same table
_BACK = {b: a for a, b in reversed(list(zip(LOOKALIKE_FROM, LOOKALIKE_TO))) if "Ѐ" <= a <= "ӿ"}
_LATIN, _CYRILLIC = "".join(_BACK), "".join(_BACK.values())
#: A token wholly of Latin look-alikes right after a Cyrillic word.
INTRUDER = f"(?<=\\p{{IsCyrillic}} )[{_LATIN}]+(?![\\p{{L}}\\p{{M}}\\p{{N}}])"


def unusual(c: Column) -> Column:
    """True where ``c`` holds a character beyond the usual ones; plain ASCII is settled first."""
    return c.rlike("[^\\x00-\\x7F]") & ~c.rlike(USUAL)


def plain_letters(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "[^\\p{L}\\p{M}\\p{N}]+", " "), _JAMO, "")


def form_case(c: Column) -> Column:
    """True where ``c`` holds a width, compatibility or decomposed form, an invisible mark or an odd space."""
    letters = plain_letters(F.regexp_replace(c, f"[{INVISIBLE}]", ""))
    return F.when(unusual(c), c.rlike(f"[{INVISIBLE}\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000]") | (compose(F.coalesce(letters, F.lit(""))) != letters)).otherwise(False)


def form_repaired(c: Column) -> Column:
    """``c`` composed, without invisible marks, with ordinary spaces; punctuation keeps its width."""
    shown = F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]", ""), "[\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000]", " ")
    hidden = F.translate(F.coalesce(shown, F.lit("")), _JAMO, _HIDE)
    pieces = F.regexp_extract_all(hidden, F.lit("[\\p{L}\\p{M}\\p{N}\\uE000-\\uE0FF]+|[^\\p{L}\\p{M}\\p{N}\\uE000-\\uE0FF]+"), 0)
    # NFKC runs on the whole text with punctuation and symbols taken out and put back by position
    words = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[\\p{L}\\p{M}\\p{N}\\uE000-\\uE0FF]"), p).otherwise("")), "\\u0001".encode().decode("unicode_escape"))
    composed = F.split(compose(words), "\\u0001".encode().decode("unicode_escape"))
    joined = F.array_join(F.zip_with(pieces, composed, lambda p, w: F.when(p.rlike("^[\\p{L}\\p{M}\\p{N}\\uE000-\\uE0FF]"), w).otherwise(p)), "")
    return F.when(unusual(c), F.translate(joined, _HIDE, _JAMO)).otherwise(c)


def texts_of(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, text`` for all texts that are not null."""
    cells = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]), lambda x: x["text"].isNotNull()))
    return rows.select(F.col(key).alias("key"), cells.alias("_c")).select("key", "_c.field", "_c.text")


def _candidates(long: DataFrame) -> DataFrame:
    """``key, field, token, word, mixed``: tokens that may hide look-alikes, with what they may stand for."""
    latin = F.length(F.regexp_replace("text", "[^\\p{IsLatin}]", ""))
    other = F.length(F.regexp_replace("text", f"[^{ALPHABETS[1:-1]}]", ""))
    foreign = long.where(F.col("text").rlike(ALPHABETS)).select("key", "field", "text", ((latin >= other) & ~F.col("text").rlike(OWN)).alias("_latin_text"))
    # a text with real words of another alphabet is no suspect unless a token mixes alphabets
    foreign = foreign.where(F.col("_latin_text") | F.col("text").rlike(f"{MIXED}|{INTRUDER}")).select("key", "field", "_latin_text", form_repaired(F.col("text")).alias("_r"))
    own = F.filter(F.regexp_extract_all("_r", F.lit(TOKEN), 0), lambda t: t.rlike(ALPHABETS))
    intruders = F.when(F.col("_latin_text"), F.array().cast("array<string>")).otherwise(F.regexp_extract_all("_r", F.lit(INTRUDER), 0))
    tokens = foreign.select("key", "field", "_latin_text", F.explode(F.array_union(own, intruders)).alias("token"))
    mixed = F.col("token").rlike("\\p{IsLatin}") & F.col("token").rlike(ALPHABETS)
    to_latin = F.translate("token", LOOKALIKE_FROM, LOOKALIKE_TO)
    to_cyrillic = F.translate("token", _LATIN, _CYRILLIC)
    options = F.filter(
        F.array(
            F.when((mixed | F.col("_latin_text")) & ~to_latin.rlike(ALPHABETS), to_latin),
            F.when((mixed | ~F.col("_latin_text")) & ~to_cyrillic.rlike("[\\p{IsLatin}\\p{IsGreek}]") & (to_cyrillic != F.col("token")), to_cyrillic),
        ),
        lambda x: x.isNotNull(),
    )
    latin_letters = F.length(F.regexp_replace("token", "[^\\p{IsLatin}]", ""))
    return tokens.select(
        "key", "field", "token", mixed.alias("mixed"), "_latin_text", (latin_letters * 2 >= F.length("token")).alias("_latin_token"), F.explode(options).alias("word")
    )


def repairs(long: DataFrame, corpus: DataFrame) -> DataFrame:
    """``key, field, token, word, kind`` for each token to be repaired; ``word`` is null where no repair is a corpus word but the token mixes alphabets.

    ``corpus`` has a column ``text``; its words are counted where they are candidates, all texts included.
    """
    found = cut(_candidates(long))  # read twice below
    wanted = found.select(F.lower("word").alias("_w")).distinct()
    # repeated texts are read for words once, and words are counted before they move
    texts = corpus.groupBy("text").agg(F.count(F.lit(1)).alias("_c"))
    clean = texts.select("_c", F.explode(F.split(F.lower(form_repaired(F.col("text"))), "[^\\p{L}\\p{M}]+")).alias("_w"))
    known = clean.groupBy("_w").agg(F.sum("_c").alias("_n")).join(wanted, "_w", "left_semi")
    scored = found.withColumn("_w", F.lower("word")).join(known, "_w", "left")
    suits = F.coalesce(F.col("_n"), F.lit(0)) * F.when(F.col("_latin_token") == F.col("word").rlike("\\p{IsLatin}"), 4).otherwise(1)
    best = scored.groupBy("key", "field", "token").agg(F.max("mixed").alias("mixed"), F.max_by("word", F.when(suits > 0, F.struct(suits, -F.ascii("word"), "word"))).alias("word"))
    kind = F.when(F.col("word").isNull(), "unknown").when(F.col("mixed"), "mixed").otherwise("whole")
    return best.where("mixed or word is not null").select("key", "field", "token", "word", kind.alias("kind"))


def canonical_texts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, text, canonical, is_case, kinds`` for every text that is not null."""
    long = texts_of(rows, key, fields)
    fixed = repairs(long, long)
    book = fixed.groupBy("key", "field").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("word", "token").alias("word")))).alias("_book"), F.sort_array(F.collect_set("kind")).alias("_kinds"))
    pieces = F.regexp_extract_all("_r", F.lit(f"{TOKEN}|[^\\p{{L}}\\p{{M}}]+"), 0)
    marked = long.select("key", "field", "text", form_repaired(F.col("text")).alias("_r"), form_case(F.col("text")).alias("_form")).join(book, ["key", "field"], "left")
    whole = F.when(F.col("_book").isNull(), F.col("_r")).otherwise(F.array_join(F.transform(pieces, lambda p: F.coalesce(F.col("_book")[p], p)), ""))
    none = F.array().cast("array<string>")
    kinds = F.concat(F.when(F.col("_form"), F.array(F.lit("form"))).otherwise(none), F.coalesce("_kinds", none))
    return marked.select(F.col("key").alias(key), "field", "text", whole.alias("canonical"), (F.col("_form") | F.col("_book").isNotNull()).alias("is_case"), kinds.alias("kinds"))


def form_cases(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field`` of the texts with a case of width, composition, invisible marks or spaces."""
    return texts_of(rows, key, fields).where(form_case(F.col("text"))).select(F.col("key").alias(key), "field")


def disguised(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field`` of the texts that hold any case; the same repairs as ``canonical_texts``."""
    long = texts_of(rows, key, fields)
    forms = long.where(form_case(F.col("text"))).select("key", "field")
    letters = repairs(long, long).select("key", "field")
    return forms.unionByName(letters).distinct().select(F.col("key").alias(key), "field")
