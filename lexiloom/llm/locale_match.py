"""Free-entered language and country names mapped to a canonical list (symmetric-delete lookup).

The reference list is small and its size is checked (``MAX_REFERENCE``); its spellings are indexed by
all their deletions up to the edit bound and the index travels to the workers as a broadcast. A typed
value is reduced to its letters and digits, looked up by its own deletions, and the candidates are
ranked by a weighted Damerau-Levenshtein distance, then by how often the reference entry is used.

Defined cases: null or blank gives null; a value that no entry matches within the bound, or that two
different entries match equally well at a distance above zero with the same reference frequency, gives
``unmatched``; names of languages and countries outside the list are entries of their own that mean
``unmatched``, so that a near miss of theirs is not drawn to a listed one. Long values are compared
whole; beyond ``LONGEST`` letters no entry can be within the bound and the value is ``unmatched``.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNMATCHED = "unmatched"
#: The reference list is broadcast; a longer one is refused, to be matched in parts.
MAX_REFERENCE = 100_000
#: Up to so many rows exact names are answered in the JVM by a literal map; longer lists are looked up in the index.
MAX_LITERALS = 1_000
LONGEST = 64

# English names of countries by ISO 3166 code.
COUNTRY = {
    "KR": ["korea", "south korea", "republic of korea"], "US": ["usa", "united states", "united states of america", "america"],
    "GB": ["uk", "united kingdom", "great britain", "britain", "england"], "AU": ["australia"], "FR": ["france"],
    "BE": ["belgium", "belgique", "belgie"], "CA": ["canada"], "DE": ["germany", "deutschland"], "AT": ["austria", "osterreich"],
    "IT": ["italy", "italia"], "ES": ["spain", "espana"], "MX": ["mexico"], "PT": ["portugal"], "BR": ["brazil", "brasil"],
    "NL": ["netherlands", "the netherlands", "holland", "nederland"], "SE": ["sweden", "sverige"], "PL": ["poland", "polska"],
    "TR": ["turkey", "turkiye"], "RU": ["russia", "russian federation", "россия"], "CN": ["china", "中国", "中國"],
    "TW": ["taiwan", "台湾", "臺灣", "台灣"], "JP": ["japan", "日本"], "VN": ["vietnam", "viet nam", "việt nam"],
}
# Names of languages by ISO 639 code, in English, in Korean and in the language itself.
LANGUAGE = {
    "ko": ["korean", "한국어", "한글", "국문", "한국말", "조선어"], "en": ["english", "영어", "영문"],
    "fr": ["french", "francais", "불어", "프랑스어", "불문"], "de": ["german", "deutsch", "독어", "독일어", "독문"],
    "it": ["italian", "italiano", "이탈리아어", "이태리어"], "es": ["spanish", "espanol", "castellano", "서반아어", "스페인어"],
    "pt": ["portuguese", "portugues", "포어", "포르투갈어"], "nl": ["dutch", "nederlands", "화란어", "네덜란드어"],
    "sv": ["swedish", "svenska", "서전어", "스웨덴어"], "pl": ["polish", "polski", "파란어", "폴란드어"],
    "tr": ["turkish", "turkce", "토이기어", "튀르키예어", "터키어"], "ru": ["russian", "русский", "노어", "러시아어"],
    "ja": ["japanese", "日本語", "일어", "일본어", "일문"], "vi": ["vietnamese", "tieng viet", "tiếng việt", "월남어", "베트남어"],
    "zh": ["chinese", "中文", "중국어", "중문", "汉语", "漢語"],
}
# Further names that mean one entry by themselves.
NAMED = {
    "zh_CN": ["simplified chinese", "chinese simplified", "简体中文", "中文简体", "简体", "간체", "중국어 간체", "간체 중국어", "간체자", "중국어 간체자", "zh hans"],
    "zh_TW": ["traditional chinese", "chinese traditional", "繁體中文", "繁体中文", "正體中文", "번체", "중국어 번체", "번체 중국어", "번체자", "zh hant"],
    "en_US": ["american english", "us english", "미국식 영어"], "en_GB": ["british english", "uk english", "영국식 영어"],
    "en_AU": ["australian english", "aussie english"], "fr_FR": ["european french"], "fr_CA": ["canadian french", "quebec french"],
    "fr_BE": ["belgian french"], "de_AT": ["austrian german"], "es_MX": ["mexican spanish", "latin american spanish"],
    "es_ES": ["european spanish", "castilian spanish"], "pt_BR": ["brazilian portuguese", "brazilian"], "pt_PT": ["european portuguese", "유럽 포어", "유럽 포르투갈어", "유럽식 포르투갈어"],
    "tr_TR": ["터키"],
}
# Languages and countries that are often typed but stand on no such list.
ELSEWHERE = [
    "danish", "denmark", "dansk", "덴마크", "덴마크어", "finnish", "finland", "suomi", "핀란드", "핀란드어", "norwegian", "norway", "norsk", "노르웨이", "노르웨이어",
    "ukrainian", "ukraine", "우크라이나", "우크라이나어", "romanian", "romania", "루마니아", "루마니아어", "greek", "greece", "그리스", "그리스어", "czech", "czechia", "체코", "체코어",
    "hungarian", "hungary", "헝가리", "헝가리어", "croatian", "croatia", "크로아티아", "크로아티아어", "serbian", "serbia", "세르비아", "slovak", "slovakia", "슬로바키아",
    "slovenian", "slovenia", "슬로베니아", "bulgarian", "bulgaria", "불가리아", "thai", "thailand", "태국", "태국어", "indonesian", "indonesia", "인도네시아", "인도네시아어",
    "malay", "malaysia", "말레이시아", "hindi", "india", "인도", "힌디어", "arabic", "아랍어", "hebrew", "israel", "이스라엘", "persian", "iran", "이란",
    "estonian", "estonia", "에스토니아", "latvian", "latvia", "라트비아", "lithuanian", "lithuania", "리투아니아", "swiss", "switzerland", "스위스", "ireland", "아일랜드", "icelandic", "iceland",
    "catalan", "basque", "galician", "latin", "esperanto", "mongolian", "몽골", "몽골어", "kazakh", "카자흐스탄", "singapore", "싱가포르", "philippines", "필리핀", "argentina", "아르헨티나",
    "chile", "칠레", "colombia", "콜롬비아", "peru", "egypt", "이집트", "hong kong", "홍콩", "new zealand", "뉴질랜드", "luxembourg", "룩셈부르크", "albanian", "albania", "georgia", "armenian",
]
# Country codes of the places above, as they head a sheet name such as RO(...).
ELSEWHERE_CODE = {
    "덴마크": "dk", "핀란드": "fi", "노르웨이": "no", "우크라이나": "ua", "루마니아": "ro", "그리스": "el", "체코": "cz", "헝가리": "hu", "크로아티아": "hr", "세르비아": "rs",
    "슬로바키아": "sk", "슬로베니아": "si", "불가리아": "bg", "태국": "th", "인도네시아": "id", "말레이시아": "my", "인도": "in", "이스라엘": "il", "스위스": "ch", "아일랜드": "ie",
    "에스토니아": "ee", "라트비아": "lv", "리투아니아": "lt", "홍콩": "hk", "뉴질랜드": "nz", "싱가포르": "sg",
}


def compact(value: str) -> str:
    """Letters and digits only, NFKC, lower case, without accents on Latin letters."""
    text = unicodedata.normalize("NFKC", value).replace("ı", "i").lower()
    text = "".join(
        ch if not ("LATIN" in unicodedata.name(ch, "")) else unicodedata.normalize("NFD", ch)[0] for ch in text
    )
    return "".join(ch for ch in text if ch.isalnum())


def spellings(reference: list[dict]) -> dict[str, tuple[str, int]]:
    """Each compact spelling with the code it means and its rank (lower is more telling)."""
    out: dict[str, tuple[str, int]] = {}

    def add(text: str | None, code: str, rank: int) -> None:
        k = compact(text or "")
        if k and (k not in out or rank < out[k][1]):
            out[k] = (code, rank)

    by_country: dict[str, list[str]] = defaultdict(list)
    by_language: dict[str, list[str]] = defaultdict(list)
    for r in reference:
        lang, _, country = (r["code"] or "").partition("_")
        by_country[country].append(r["code"])
        by_language[lang].append(r["code"])
    for r in reference:
        code = r["code"]
        lang, _, country = code.partition("_")
        head, local = (re.split(r"[(（]", r["sheet"] or "") + [""])[:2]
        local = local.rstrip(")）")
        own, _, place = (r["display"] or "").partition("_")
        places = [local, place, *COUNTRY.get(country, [])]
        tongues = [own, *LANGUAGE.get(lang, [])]
        for x in (r["sheet"], r["lang"], code, r["display"]):
            add(x, code, 0)
        add(country + lang, code, 1)
        for x in NAMED.get(code, []):
            add(x, code, 1)
        words = (r["lang"] or "").split()
        add(" ".join(reversed(words)), code, 1)
        for p in places:
            if not p:
                continue
            add(head + p, code, 1)
            add(p + head, code, 2)
            add(country + p, code, 2)
            for t in [*tongues, *LANGUAGE.get(lang, []), *NAMED.get(code, []), r["lang"]]:
                add(t + p, code, 1)
                add(p + t, code, 1)
        for t in tongues:
            for h in (head, country):
                add(t + h, code, 2)
                add(h + t, code, 2)
        if len(by_country[country]) == 1:
            for p in places:
                add(p, code, 1)
            add(head, code, 1)
            add(country, code, 2)
            for x in (local, place):  # "Germany's language", as "독일어"
                if x:
                    add(x + "어", code, 3)
        if by_language[lang][0] == code:  # a language alone means its first entry in the list
            for t in tongues:
                add(t, code, 1 if len(by_language[lang]) == 1 else 3)
            add(lang, code, 4)
            add(r["iso"], code, 4)
    for x in ELSEWHERE:
        add(x, UNMATCHED, 5)
    for x, h in ELSEWHERE_CODE.items():
        add(h + x, UNMATCHED, 5)
    return out


def deletions(word: str, most: int) -> set[str]:
    """The word and all that remains of it after up to ``most`` deletions."""
    found, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found |= edge
    return found


def bound(length: int, most: int) -> int:
    """Edits allowed for a word: none up to three letters, one up to nine, then ``most``."""
    return 0 if length <= 3 else 1 if length <= 9 else most


def distance(a: str, b: str) -> float:
    """Damerau-Levenshtein with weights: a swap or a doubled letter costs 0.8, a vowel for a vowel 0.9, others 1."""
    vowels = "aeiouy"
    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        d[i][0] = float(i)
    for j in range(m + 1):
        d[0][j] = float(j)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            sub = 0.0 if x == y else 0.9 if x in vowels and y in vowels else 1.0
            dele = 0.8 if i > 1 and a[i - 2] == x else 1.0
            ins = 0.8 if j > 1 and b[j - 2] == y else 1.0
            best = min(d[i - 1][j - 1] + sub, d[i - 1][j] + dele, d[i][j - 1] + ins)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, d[i - 2][j - 2] + 0.8)
            d[i][j] = best
    return d[n][m]


class Index:
    """The symmetric-delete index over all spellings."""

    def __init__(self, words: dict[str, tuple[str, int]], frequency: dict[str, int] | None = None, most: int = 2):
        self.words, self.frequency, self.most = words, frequency or {}, most
        self.by_deletion: dict[str, list[str]] = defaultdict(list)
        for w in words:
            for x in deletions(w, bound(len(w), most)):
                self.by_deletion[x].append(w)
        self.memo: dict[str, str | None] = {}

    def find(self, value: str | None) -> str | None:
        """The code meant, ``unmatched``, or None for null and blank."""
        if value is None or not value.strip("  ​\t\r\n　﻿"):
            return None
        known = self.memo.get(value)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            known = self.memo[value] = self._find(compact(value))
        return known

    def _find(self, key: str) -> str:
        if key in self.words:
            return self.words[key][0]
        allowed = bound(len(key), self.most)
        if not key or len(key) > LONGEST or not allowed or key.isdigit():
            return UNMATCHED
        near = {w for x in deletions(key, allowed) for w in self.by_deletion.get(x, ())}
        ranked = []
        for w in near:
            d = distance(key, w)
            if d <= min(allowed, bound(len(w), self.most)):
                code, rank = self.words[w]
                ranked.append((d, -self.frequency.get(code, 0), rank, code))
        if not ranked:
            return UNMATCHED
        ranked.sort()
        tied = {r[3] for r in ranked if r[:2] == ranked[0][:2]}
        return ranked[0][3] if len(tied) == 1 else UNMATCHED


def reference_rows(sheet_langs: DataFrame) -> list[dict]:
    """The canonical list on the driver, after its size was checked."""
    rows = sheet_langs.select("sheet", "lang", "code", "display", "iso").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows and can't be broadcast")
    return [r.asDict() for r in rows if r["code"]]


#: One index per worker and list, by a name that the driver gives it.
_INDEX: dict[str, Index] = {}


class Matcher:
    """Turns a column of typed names into a column of codes, without a shuffle."""

    def __init__(self, sheet_langs: DataFrame, frequency: dict[str, int] | None = None, most: int = 2):
        self.rows = reference_rows(sheet_langs)
        spark: SparkSession = sheet_langs.sparkSession
        shared = spark.sparkContext.broadcast((spellings(self.rows), frequency or {}, most))
        name = uuid.uuid4().hex

        @F.pandas_udf("string")
        def look_up(values: pd.Series) -> pd.Series:
            index = _INDEX.get(name)
            if index is None:
                index = _INDEX[name] = Index(*shared.value)
            return values.map(index.find, na_action="ignore")

        self._udf = look_up

    def _literal(self, field: str) -> Column:
        pairs = [x for r in self.rows for x in (F.lit(r[field]), F.lit(r["code"])) if r[field]]
        return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(None).cast("string"))

    def code(self, c: Column, exact: str = "sheet") -> Column:
        """The code meant by ``c``; exact names are answered by a literal map and never reach Python."""
        if len(self.rows) > MAX_LITERALS:
            return self._udf(c)
        known = self._literal(exact)[c]
        return F.coalesce(known, self._udf(F.when(known.isNull(), c)))

    def iso(self, code: Column) -> Column:
        """The language of a code; countries that share one are one language."""
        pairs = [x for r in self.rows for x in (F.lit(r["code"]), F.lit(r["iso"]))]
        return F.create_map(*pairs)[code] if pairs else F.lit(None).cast("string")

    def named(self, c: Column) -> Column:
        """Like ``code``, but null where nothing on the list is meant."""
        code = self.code(c)
        return F.when(code != UNMATCHED, code)


def reference_frequency(pairs: DataFrame, sheet_langs: DataFrame) -> dict[str, int]:
    """How often each entry is used under its literal name: one count per entry of the checked list."""
    names = F.broadcast(sheet_langs.select("sheet", "code").limit(MAX_REFERENCE))
    counted = pairs.select(F.col("target_lang").alias("sheet")).join(names, "sheet").groupBy("code").count()
    return {r["code"]: r["count"] for r in counted.collect()}


def typed_values(pairs: DataFrame, locales: DataFrame, sheet_langs: DataFrame) -> DataFrame:
    """``tbl, row_id, code`` for every non-blank value that is not literally on the list."""
    m = Matcher(sheet_langs, reference_frequency(pairs, sheet_langs))

    def side(df: DataFrame, tbl: str, key: str, col: str, field: str) -> DataFrame:
        literal = [r[field] for r in m.rows if r[field]]
        typed = F.col(col)
        rows = df.select(F.col(key).cast("long").alias("row_id"), typed).where(typed.isNotNull() & (F.trim(typed) != "") & ~typed.isin(literal))
        return rows.select(F.lit(tbl).alias("tbl"), "row_id", m._udf(typed).alias("code")).where("code is not null")

    return side(pairs, "rag_pairs", "pair_id", "target_lang", "sheet").unionByName(side(locales, "glossary_locales", "id", "header_display", "display"))
