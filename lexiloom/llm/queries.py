"""The queries of the ten problems, over whole tables with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import canonical, dressed, langid, leakage, near, packing, pii, survivor, tokens
from .forms import INVISIBLE, ODD_SPACE
from .locale_match import Matcher, reference_frequency, typed_values


def _matcher(spark: SparkSession, d: str) -> Matcher:
    langs = load(spark, d, "sheet_langs")
    return Matcher(langs, reference_frequency(load(spark, d, "rag_pairs"), langs))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.disguised(load(spark, d, "rag_pairs"), "pair_id", ["source_text", "target_text"])


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_texts(load(spark, d, "rag_pairs"), "pair_id", ["source_text", "target_text"])


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """The cases of ``p1_found`` that need no vocabulary, which SQL can follow."""
    return canonical.form_cases(load(spark, d, "rag_pairs"), "pair_id", ["source_text", "target_text"])


def p2_token_totals(spark: SparkSession, d: str) -> DataFrame:
    code = _matcher(spark, d).named(F.col("target_lang"))
    slices = {"source_group": F.col("source_group"), "original_file": F.col("original_file"), "language": code, "section_kind": tokens.section_kind(F.col("section_code"))}
    return tokens.token_totals(load(spark, d, "rag_pairs"), "target_text", tokens.longest_match(spark), slices)


def p2_row_tokens(spark: SparkSession, d: str) -> DataFrame:
    count = tokens.longest_match(spark)
    return load(spark, d, "rag_pairs").select("pair_id", count(F.col("target_text")).alias("tokens"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "rag_pairs").select("pair_id", "target_lang", "source_text")
    rows = rows.select("pair_id", _matcher(spark, d).named(F.col("target_lang")).alias("code"), "source_text")
    return dressed.duplicate_groups(rows, "pair_id", ["code"], "source_text").select("pair_id", "group_id")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "rag_pairs").select("pair_id", _matcher(spark, d).named(F.col("target_lang")).alias("code"), "source_text")
    return dressed.collapse(rows.where("code is not null"), "pair_id", ["code"], "source_text")


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "rag_pairs").where(F.lower(F.trim("section_code")).endswith("description"))
    return rows.select("pair_id", _matcher(spark, d).named(F.col("target_lang")).alias("code"), "source_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = near.near_rows(_descriptions(spark, d), "pair_id", "code", "source_text", least=0.45, size=3)
    return found.select(F.col("a").alias("pair_id_a"), F.col("b").alias("pair_id_b")).distinct()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(_descriptions(spark, d), "pair_id", "code", "source_text", least=0.45, size=3)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return typed_values(load(spark, d, "rag_pairs"), load(spark, d, "glossary_locales"), load(spark, d, "sheet_langs"))


def _survivors(spark: SparkSession, d: str, language: Column, half_life_s: float, trusted: bool) -> DataFrame:
    rows = load(spark, d, "rag_pairs").withColumn("_code", language)
    if trusted:
        rows = survivor.file_trust(rows, load(spark, d, "processed_files"))
    group = {"story": survivor.story_number(), "code": F.col("_code"), "cell_row": survivor.cell_row()}
    return survivor.survivors(rows, group, P6_FIELDS, "pair_id", "created_at", trust=F.col("_trust") if trusted else None, half_life_s=half_life_s)


P6_FIELDS = ["target_text", "section_code", "tone_flag"]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    named = _matcher(spark, d).named(F.col("target_lang"))
    return _winners(_survivors(spark, d, named, survivor.STEEP, trusted=False))


def _winners(out: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_from").alias("pair_id")) for f in P6_FIELDS]))
    return out.select("group_id", cells.alias("c")).select("group_id", "c.field", "c.pair_id").where("pair_id is not null")


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """Survivors by trust of the file and a decay of thirty days."""
    return _survivors(spark, d, _matcher(spark, d).named(F.col("target_lang")), 30 * 86400.0, trusted=True)


def p6_by_label(spark: SparkSession, d: str) -> DataFrame:
    """``p6_found`` by target_lang as typed, which SQL can follow."""
    return _winners(_survivors(spark, d, F.col("target_lang"), survivor.STEEP, trusted=False))


def p6_votes_by_label(spark: SparkSession, d: str) -> DataFrame:
    """``p6_records`` by target_lang as typed: trust and decay decide, which SQL can follow."""
    return _winners(_survivors(spark, d, F.col("target_lang"), 30 * 86400.0, trusted=True))


def _languages(spark: SparkSession, d: str, operator) -> DataFrame:
    m = _matcher(spark, d)
    rows = load(spark, d, "rag_pairs").select(
        "pair_id", "target_text", "original_file",
        m.iso(m.named(F.col("target_sheet"))).alias("declared"),
        m.iso(m.named(F.col("target_lang"))).alias("suffix"),
        survivor.story_number().alias("story"),
    )
    pairs, langs = load(spark, d, "rag_pairs"), load(spark, d, "sheet_langs")
    # the list of sheets was checked by the matcher
    targets = pairs.join(F.broadcast(langs.select(F.col("sheet").alias("target_sheet"), "iso")), "target_sheet").select("pair_id", F.col("target_text").alias("text"), "iso")
    # source texts are labelled by their group; they teach languages that are rarely a target
    sources = pairs.select("pair_id", F.col("source_text").alias("text"), F.when(F.col("source_group") == "kr", "ko").when(F.col("source_group") == "us", "en").alias("iso"))
    model = langid.train(targets.unionByName(sources), "text", "iso", "pair_id")
    return operator(rows, model, "pair_id", "target_text", "declared", "suffix", "original_file", "story")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, langid.mislabelled_rows)


def p7_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, langid.languages)


def _limits(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    return packing.kinds(load(spark, d, "pack_limits"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(load(spark, d, "documents"), _limits(spark, d), tokens.byte_pair(spark))


def p8_use_of_space(spark: SparkSession, d: str) -> DataFrame:
    return packing.use_of_space(p8_containers(spark, d), _limits(spark, d))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every packing: all texts with a token placed whole, none above its container's limit."""
    return packing.invariants(p8_containers(spark, d), _limits(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"), whole=False)
    return found.where("exact").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    return pii.found_rows(documents, pii.train(documents))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    documents = load(spark, d, "documents")
    return pii.redact(documents, pii.train(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_canonical": p1_canonical,
        "p1_forms": p1_forms,
        "p2_token_totals": p2_token_totals,
        "p2_row_tokens": p2_row_tokens,
        "p3_found": p3_found,
        "p3_records": p3_records,
        "p4_found": p4_found,
        "p4_groups": p4_groups,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_records": p6_records,
        "p6_by_label": p6_by_label,
        "p6_votes_by_label": p6_votes_by_label,
        "p7_found": p7_found,
        "p7_languages": p7_languages,
        "p8_containers": p8_containers,
        "p8_use_of_space": p8_use_of_space,
        "p8_invariants": p8_invariants,
        "p9_found": p9_found,
        "p9_leaks": p9_leaks,
        "p10_found": p10_found,
        "p10_redacted": p10_redacted,
    }


_TEN_WORDS = """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
dw as (select distinct doc_id, array_to_string(w[i:i + 9], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 8)) as i from d where len(w) >= 10)),
e as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items where text is not null),
ew as (select distinct item_id, array_to_string(w[i:i + 9], ' ') as k from (select item_id, w, unnest(range(1, len(w) - 8)) as i from e where len(w) >= 10))
select distinct doc_id, item_id from dw join ew using (k)
"""


_GROUPS = """
with base as (select pair_id, target_lang as code, created_at, original_file, target_text, section_code, tone_flag,
  try_cast(coalesce(nullif(regexp_extract(story_id, '(\\d+)\\D*$', 1), ''), nullif(regexp_extract(original_file, 'Contents_(\\d+)', 1), '')) as bigint) as story,
  try_cast(nullif(regexp_extract(id, '::(\\d+)\\s*$', 1), '') as bigint) as cell_row, coalesce(created_at, timestamp '0001-01-01') as at_ from rag_pairs),
g as (select story, code, cell_row, min(pair_id) as group_id from base where story is not null and code is not null and cell_row is not null group by all having count(*) >= 2),
c as (select group_id, pair_id, at_, original_file, unnest(['target_text', 'section_code', 'tone_flag']) as field, unnest([target_text, section_code, tone_flag]) as value from base join g using (story, code, cell_row)),
u as (select * from c where value is not null and lower(regexp_replace(value, '^[\\s\\x{00A0}\\x{3000}\\x{FEFF}]+|[\\s\\x{00A0}\\x{3000}\\x{FEFF}]+$', '', 'g')) not in ('', 'x', 'none'))
"""
_NEWEST = _GROUPS + "select group_id, field, arg_max(pair_id, (at_, pair_id)) as pair_id from u group by 1, 2"
_VOTES = _GROUPS + """,
n as (select original_file as f, count(*) as n from rag_pairs where original_file is not null group by 1),
l as (select filename as f, max(record_count) as listed from processed_files where filename is not null group by 1),
t as (select n.f, coalesce(least(n.n, l.listed)::double / greatest(n.n, l.listed), 0.25) as trust from n join l using (f)),
m as (select *, max((at_, pair_id)) over (partition by group_id, field) as top from u),
v as (select m.*, coalesce(t.trust, 0.25) * power(2.0, -(case when top[2] = pair_id then 0 else greatest(epoch_us(top[1]) - epoch_us(at_), 1) end) / (30 * 86400 * 1e6)) as vote from m left join t on t.f = m.original_file),
w as (select group_id, field, lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) as norm, round(sum(vote), 12) as votes, max((at_, pair_id)) as last_ from v group by all)
select group_id, field, arg_max(last_[2], (votes, last_[1], last_[2])) as pair_id from w group by 1, 2
"""


def _forms_sql() -> str:
    """Letters, marks and digits that compatibility composition changes, by rule, and what stands decomposed."""
    import sys
    import unicodedata

    changed = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LMN" and unicodedata.normalize("NFKC", chr(c)) != chr(c) and not 0x3131 <= c < 0x318F]
    runs: list[list[int]] = []
    for c in changed:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    letters = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)
    shown = "".join(f"\\x{{{x[2:]}}}" if x.startswith("\\u") else x for x in re.split(r"(\\u[0-9A-F]{4})", INVISIBLE + ODD_SPACE.replace("\\u2028\\u2029", "").replace("\\u3000", "")))
    hidden = f"[{shown}\\x{{3000}}{letters}]"
    bare = f"regexp_replace(text, '[{''.join(shown)}]', '', 'g')"
    return f"""select pair_id, field from (select pair_id, unnest(['source_text', 'target_text']) as field, unnest([source_text, target_text]) as text from rag_pairs)
 where text is not null and (regexp_matches(text, '{hidden}') or nfc_normalize({bare}) <> {bare})"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it on whole tables; the others are tested against brute force in ``tests/llm``."""
    invariants = "select limit_id, (select count(*) from documents where text <> '') as texts, 0::bigint as overfull, 0::bigint as broken, 0::bigint as split_small from pack_limits where limit_id is not null and max_tokens is not null"
    return {"p1_forms": _forms_sql(), "p6_by_label": _NEWEST, "p6_votes_by_label": _VOTES, "p8_invariants": invariants, "p9_found": _TEN_WORDS}
