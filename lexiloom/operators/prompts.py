"""Prompts as text, and calls of a model that the user provides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def assembled(*sections: Column) -> Column:
    """Sections that aren't blank, a blank line between them."""
    held = F.filter(F.array(*[F.coalesce(s, F.lit("")) for s in sections]), lambda x: F.trim(x) != "")
    return F.regexp_replace(F.array_join(held, "\n\n"), "^\\s+|\\s+$", "")


def formatting_section(language: Column, row_key: Column) -> Column:
    """How glossary terms are to be written in a row."""
    opening, closing = T.bracket_pair(language)
    bare = T.context_mode(row_key) == "title_button"
    return F.when(bare, "Glossary terms stand without brackets.").otherwise(F.concat(F.lit("Glossary terms stand in "), opening, closing, F.lit(".")))


def translation_prompt(source_language: Column, language: Column, row_key: Column, rule: Column, examples: Column, style: Column) -> Column:
    """Task, language rule, style, examples, formatting and output format; optional sections may be null."""
    task = F.concat(F.lit("Translate from "), source_language, F.lit(" into "), language, F.lit("."))
    use = F.when(F.trim(F.coalesce(examples, F.lit(""))) != "", F.concat(examples, F.lit("\nKeep to the style and terms of these examples.")))
    return assembled(task, rule, style, use, formatting_section(language, row_key), F.lit('Return only a JSON object with a "translation" key.'))


def audit_prompt(source_language: Column, language: Column, code: Column, row_key: Column, rule: Column, glossary: Column) -> Column:
    """Task, language rule, formatting, the glossary's target where there is a glossary, and output format."""
    task = F.concat(F.lit("Review a translation from "), source_language, F.lit(" into "), language, F.lit("."))
    target = F.when(F.trim(F.coalesce(glossary, F.lit(""))) != "", F.concat(F.lit("[Glossary Target]\nTarget code: "), F.coalesce(code, language)))
    return assembled(task, rule, formatting_section(language, row_key), target, F.lit("Return only a JSON object with the keys evaluation, grade and suggested_fix."))


def style_prompt(source: Column, translation: Column, language: Column, voice: Column) -> Column:
    """Asks whether a translation keeps to a voice."""
    return assembled(F.lit("Judge whether the translation keeps to the voice."), F.concat(F.lit("Source: "), source, F.lit("\nTranslation: "), translation, F.lit("\nLanguage: "), language), F.concat(F.lit("Voice: "), voice), F.lit("Begin with [PASS] or [FAIL]."))


def modules(language: Column, row_key: Column, rule: Column, examples: Column, style: Column) -> Column:
    """Which sections a prompt has: ``struct<language, mode, prefix, suffix, has_rule, has_examples, has_style>``."""
    form = T.input_formatting(language, row_key)
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.struct(
        language.alias("language"), T.context_mode(row_key).alias("mode"), form["prefix"].alias("prefix"), form["suffix"].alias("suffix"), given(rule).alias("has_rule"), given(examples).alias("has_examples"), given(style).alias("has_style")
    )


def called(texts: Column, model: Callable[[list[str]], list], kind: str, batch: int = 50) -> Column:
    """What a model says of each text: ``model`` takes up to ``batch`` texts and returns as many results; null texts aren't asked.

    A model that fails leaves the results of its batch null, as the next run may have more luck; the caller sees
    them missing. ``kind`` is the result's type, such as ``string`` or ``array<double>``.
    """

    @F.pandas_udf(kind)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = pd.Series([None] * len(b), dtype=object)
            held = [i for i, t in enumerate(b) if isinstance(t, str)]
            for at in range(0, len(held), batch):
                some = held[at : at + batch]
                try:
                    got = model([b.iloc[i] for i in some])
                except Exception:  # the provider's own errors are of any kind
                    continue
                for i, x in zip(some, got):
                    out.iloc[i] = x
            yield out

    return ask(texts)
