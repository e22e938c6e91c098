import json
import os
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import registry
from lexiloom.functions import payload as P
from lexiloom.functions import terms as X
from lexiloom.functions import text as T
from lexiloom.operators import cells as C
from lexiloom.operators import glossary as G
from lexiloom.operators import memory as M
from lexiloom.operators import prompts as B
from lexiloom.operators import reports as R
from lexiloom.operators import retrieve as V
from lexiloom.sources import files, workbook
from lexiloom.streaming import windows as S


def column(spark, values, *exprs, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [tuple(r) if len(exprs) > 1 else r[0] for r in df.select(*exprs).collect()]


def test_normal_forms(spark):
    v = F.col("v")
    assert column(spark, ["“A”  Ｂ‘c’\n d", None, ""], T.normalize_text(v)) == ["\"A\" B'c' d", "", ""]
    assert column(spark, ["DE(독일)", "fr （x）", None], T.label_head(v)) == ["DE", "FR", None]
    names = {"Japanese": "JA", "DE(독일)": "DE", " fr （x） ": "FR", "jpn": "JPN", "English UK": "UK", "english-au": "AU", "Chinese Traditional": "TW", "Portuguese Brazil": "BR", "Thai": "TH", "Indonesian": "ID", "Korean (x)": None, "Klingon tongue": None, "": None}
    assert column(spark, list(names), T.language_code(v)) == list(names.values())
    with pytest.raises(Exception, match="no language: Klingon"):
        column(spark, ["Klingon tongue"], T.language_code(v, strict=True))
    cased = ["English US", "Indonesian", "Vietnamese", "Korean", "Norwegian", "Thai", "Russian", None]
    assert [bool(x) for x in column(spark, cased, T.writes_sentence_case(v))] == [True, True, True, False, False, False, True, False]
    assert column(spark, ["Korean", "ko", "South Korea", "English", None], T.collection_of(v)) == ["kr", "kr", "kr", "us", "us"]
    assert column(spark, ["ｆｕｌｌ　ｗｉｄｔｈ", unicodedata.normalize("NFD", "조명"), "ﬁ"], T.normalize_text(v)) == ["full width", "조명", "fi"]
    got = column(spark, ["m:thinking_off", "m:reasoning_low", "m:thinking_on", "gpt-x"], T.model_choice(v), T.provider(v))
    assert [(tuple(a), b) for a, b in got] == [(("m", 0, None), "default"), (("m", None, "low"), "default"), (("m", None, None), "default"), (("gpt-x", None, None), "gpt")]
    assert tuple(spark.range(1).select(T.percent(F.lit(1), F.lit(3)), T.percent(F.lit(1), F.lit(0))).first()) == (33, 100)
    assert column(spark, ["story_7", "1234", "x"], T.story_code(v)) == ["007", "1234", None]
    assert column(spark, ["ab가나다", ""], T.token_estimate(v)) == [2, 0]
    assert column(spark, ["A", "z", "AA", "AZ", "ZZ"], T.column_number(v)) == [1, 26, 27, 52, 702]
    assert column(spark, ["**b** x"], T.markdown_bold(v)) == ["<strong>b</strong> x"]
    assert column(spark, ["//story_title", "//section_1_disclaimer", "//x_7", "other", None], T.context_mode(v)) == ["title_button", "disclaimer", "title_button", "description", "description"]


def test_formula_keys(spark):
    df = spark.createDataFrame([('="//section_"&RIGHT($C$5,3)&"_1_button"', "story_19"), ("plain", "s"), ('="x"&"y"', "1")], "f string, s string")
    assert [r[0] for r in df.select(T.formula_key(F.col("f"), F.col("s"))).collect()] == ["//section_019_1_button", "plain", '="x"&"y"']


def test_skip(spark):
    df = spark.createDataFrame([("x", "a"), ("On", "on"), ("ab", "AB"), ("", None), ("same text", "Same Text"), ("a long text here", "a long text here"), ("Hallo", "Welt")], "s string, t string")
    assert [r[0] for r in df.select(T.skip_pair(F.col("s"), F.col("t"))).collect()] == [True, False, True, True, True, False, False]


def test_longest_terms_only(spark):
    pattern = X.term_pattern(["lock", "door lock", "AI", "C++", "스마트"])
    got = column(spark, ["The door lock and a LOCK", "said AI가 aid", "use C++ now", "스마트홈", None], X.matched_terms(F.col("v"), pattern))
    assert got == [["door lock", "lock"], ["ai"], ["c++"], ["스마트"], []]
    assert column(spark, ["lock it, 스마트 AI"], X.matched_terms(F.col("v"), X.term_pattern(["lock", "AI"]))) == [["lock", "ai"]]
    terms = spark.createDataFrame([("lock", 1), ("door lock", 2)], "term string, n int")
    texts = spark.createDataFrame([(1, "a door lock"), (2, "lock it"), (3, None)], "id int, text string")
    assert {tuple(r) for r in X.term_rows(texts, "id", "text", terms, "term").select("id", "n").collect()} == {(1, 2), (2, 1)}


def test_glossaries_of_any_size_lose_no_row(spark):
    # one row more than each bound: an automaton instead of a pattern, a shuffled join instead of a broadcast
    names = [f"term{i}x" for i in range(40)] + ["term7x plus", "C++"]
    terms = spark.createDataFrame([(n, k, f"{n}-{k}") for n in names for k in range(3)], "term string, lang int, value string")
    texts = spark.createDataFrame([(1, "a Term7x plus term7x, C++ and aterm9x"), (2, " ".join(names)), (3, None), (4, "")], "id int, text string")
    run = lambda **bounds: {tuple(r) for r in X.term_rows(texts, "id", "text", terms, "term", **bounds).select("id", "value").collect()}
    want = run()
    assert len({v for i, v in want if i == 2}) == 42 * 3 and {v for i, v in want if i == 1} == {f"{n}-{k}" for n in ("term7x plus", "term7x", "C++") for k in range(3)}
    assert run(max_terms=41) == want and run(max_rows=125) == want and run(max_terms=41, max_rows=125) == want


def test_checks(spark):
    df = spark.createDataFrame([("Der [Kühlschrank] und kühlschrank", "Kühlschrank"), ('öffne "Menü > Kühlschrank" dann', "Kühlschrank"), ("nichts", "Kühlschrank"), (None, "x")], "t string, v string")
    t, v = F.col("t"), F.col("v")
    rows = df.select(X.is_missing(t, v), X.casing_differs(t, v)).collect()
    assert [tuple(r) for r in rows[:3]] == [(False, False), (False, False), (True, False)]
    assert rows[3][0]
    cases = [
        ("tap [Home] and home", "Home", "German", "//a_description", None, "missing"), ("tap [Home] and [home]", "Home", "German", "//a_description", None, None), ("tap [Home]", "Home", "German", "//a_title", None, "forbidden"),
        ("tap Home", "Home", "German", "//a_title", None, None), ("tap [Home]", "Home", "German", "//a_description", "No brackets", "forbidden"), ("tap Home", "Home", "German", "//a_description", "비활성 화", None),
        ('see "Menu > Home" now', "Home", "German", "//a_disclaimer", None, None), ('see "Menu > Home" now', "Home", "German", "//a_description", None, "missing"), ('"a" Home > "b"', "Home", "German", "//a_disclaimer", None, "missing"),
        ("「Home」で「A > Home」", "Home", "Japanese", "//a_disclaimer", None, None), ("[Home]", "Home", "Japanese", "//a_description", None, "missing"), ("tap [Home]", "Home (x)", "German", None, None, None), ("nothing", "Home", "German", None, None, None), (None, "Home", "German", None, None, None), ("HomeHome", "Home", "German", None, None, "missing"),
        ("[Home", "Home", "German", None, None, "missing"), ("x", "(y)", "German", None, None, None),
    ]
    df = spark.createDataFrame(cases, "t string, v string, l string, k string, r string, want string")
    got = df.select("t", X.bracket_issue(F.col("t"), F.col("v"), F.col("l"), F.col("k"), F.col("r")).alias("got"), "want").collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]
    assert column(spark, ['go "A > B" or "C"'], X.navigation_paths(F.col("v"))) == [['"A > B"']]
    assert column(spark, ["Open The App. Then Go"], X.extra_capitals(F.col("v")), X.sentence_case(F.col("v"))) == [(3, "Open the app. Then go")]
    assert column(spark, ["Open The App. then go."], X.sentence_case(F.col("v"))) == ["Open the app. Then go."]
    assert column(spark, ["use doravemi and ai tools, paid ai한"], X.restore_casing(F.col("v"), ["DoraVemi", "AI"])) == ["use DoraVemi and AI tools, paid AI한"]
    told = column(spark, ["Open the App. 12. tap now! Done", "조명. Ok", " ", None], X.sentence_case_report(F.col("v"), F.lit("German Germany")))
    assert [[tuple(x) for x in r] if r is not None else None for r in told] == [[(1, False, 1), (3, False, 0), (4, True, 0)], [(1, False, 0), (2, True, 0)], None, None]
    assert column(spark, ["Open the App. tap AI", "Open the app."], X.sentence_case_fix(F.col("v"), F.lit("German"), ["AI"]), X.sentence_case_fix(F.col("v"), F.lit("Korean"))) == [("Open the app. Tap AI", None), (None, None)]
    entries = spark.createDataFrame([([("french", "1"), ("french canada", "2"), ("fr", "3")],)], "e array<struct<key:string,value:string>>")
    assert tuple(entries.select(*[X.longest_contained(F.col("e"), F.lit(w)) for w in ("French Canada", "French Canada West", "French", "Dutch")]).first()) == ("2", "2", "1", None)
    assert column(spark, ["tap [ Home ] 「Home」"], X.without_brackets(F.col("v"), ["Home"])) == ["tap Home Home"]
    assert column(spark, ["Home (x), Away"], X.highlight_terms(F.col("v"))) == [["Home (x), Away", "Home , Away", "Home", "Away"]]
    segs = column(spark, ["a lock b"], X.text_segments(F.col("v"), X.term_pattern(["lock"])))
    assert [(s["text"], s["hit"]) for s in segs[0]] == [("a ", False), ("lock", True), (" b", False)]
    assert column(spark, ["Ein Wert (EXCEPTION: nie)"], X.without_exception(F.col("v"))) == ["Ein Wert"]


def test_flexible_value(spark):
    df = spark.createDataFrame([([("de_DE", ""), ("DE_de", "zwei"), ("German", "drei")],)], "e array<struct<key:string,value:string>>")
    got = df.select(*[X.flexible_value(F.col("e"), F.lit(w)) for w in ("de_DE", "german", "ger", "xx")]).first()
    assert tuple(got) == ("", "drei", "drei", None)


def test_payloads(spark):
    good = 'text ```json\n{"evaluation":[{"category":"tone","comment":"ok"}],"grade":"Good","suggested_fix":"x"}```'
    got = column(spark, [good, "no json", '{"is_excellent":true}', None], P.reply_grade(F.col("v")), P.comments(F.col("v")))
    assert got == [("Good", "tone: ok"), ("Needs Revision", None), ("Excellent", None), ("Needs Revision", None)]
    report = "head\n[상세 - A]\none\ntwo\n[상세 - B]\nthree"
    assert column(spark, [report], P.block(F.col("v"), "A"), P.block(F.col("v"), "B")) == [("one\ntwo", "three")]
    df = spark.createDataFrame([("Open the App", "open the Door")], "a string, b string")
    assert [x["change"] for x in df.select(P.word_changes(F.col("a"), F.col("b"))).first()[0]] == ["case", "same", "new"]


def tables(spark, tmp_path, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_figures_of_all_rows_equal_brute_force(spark, tmp_path):
    texts = [("조명을 켜세요.", "Öffne\u00a0die App. ÉTÉ  là!\u3000Ж ß"), ("Tap\u00a0„Öffnen“\tnow", "now „Öffnen“\nTap x"), ("plain ascii", "Plain ascii. Two"), ("a", " \u3000\n"), ("a", ""), (None, "Ä"), ("b", None), ("名前\u3000名前", "名前 新\u2028。")]
    langs = ["German", "vietnamese (x)", "DE(독일)", "Japanese", "Klingon tongue", None, "taiwanese", "jpn"]
    d = tables(spark, tmp_path, rag_pairs=([(i, s, t, n) for i, ((s, t), n) in enumerate(zip(texts, langs))], "pair_id long, source_text string, target_text string, target_lang string"))
    run = lambda name: {tuple(r) for r in registry.queries()[name](spark, d).collect()}
    low = lambda s: [w.lower() for w in s.split()]
    assert run("word_diff") == {(i, len(s.split()), sum(w in s.split() for w in t.split()), sum(w not in s.split() and w.lower() in low(s) for w in t.split())) for i, (s, t) in enumerate(texts) if s is not None and t is not None}
    sentences = lambda t: [x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x]
    assert run("sentence_figures") == {(i, sum(unicodedata.category(c) == "Lu" for c in t), len(sentences(t))) for i, (_, t) in enumerate(texts) if t and t.strip()}
    assert run("language_codes") == {(0, "DE"), (1, "VN"), (2, "DE"), (3, "JA"), (4, None), (6, "TW"), (7, "JPN")} - {(1, "VN")} | {(1, None)}


def test_all_locales_wide_and_long(spark, tmp_path):
    locales = [(1, "한국어", 0), (2, "French", 1), (3, "french", 2), (4, None, 3), (5, "독어_독일", 4), (6, "leer", 5)]
    values = [(7, 1, "가"), (7, 2, "a"), (7, 3, "b"), (7, 4, "c"), (8, 5, "d"), (8, 1, None)]
    d = tables(spark, tmp_path, glossary_terms=([(7, "K", None, 0), (8, "L", None, 1)], "id int, source_key string, rule_text string, sort_order int"),
               glossary_locales=(locales, "id int, header_display string, column_order int"), glossary_translations=(values, "term_id int, locale_id int, value string"))
    wide = registry.queries()["glossary_pivot_all"](spark, d)
    assert wide.columns == ["term_id", "source_key", "한국어", "French#2", "french#3", "#4", "독어_독일", "leer"]
    assert {tuple(r) for r in wide.collect()} == {(7, "K", "가", "a", "b", "c", "", ""), (8, "L", "", "", "", "", "d", "")}
    assert {tuple(r) for r in registry.queries()["glossary_unpivot"](spark, d).collect()} == {v for v in values if v[2]}


def test_glossary_round_trip(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("key,Rule,한국어,영어_미국,독어_독일\n,,ko_KR,en_US,de_DE\nLng,,Korean,English_US,German\nSmartHome,대괄호 제외,스마트홈,SmartHome,SmartHome\nAI,비활성화,AI,AI,KI,extra\n,x,y\n", encoding="utf-8-sig")
    cells = files.glossary_cells(spark, str(path))
    locales, terms, values = G.wide_to_long(cells)
    assert {r["header_display"] for r in locales.collect()} == {"한국어", "영어_미국", "독어_독일"}
    assert {(r["source_key"], r["rule_text"]) for r in terms.collect()} == {("SmartHome", "대괄호 제외"), ("AI", "비활성화")}
    ids = G.with_ids(spark.createDataFrame([], "id int, source_key string, rule_text string, sort_order int"), terms, ["source_key"], ["sort_order"])
    named = locales.select(F.col("pos").alias("id"), "header_display", "header_code", F.col("pos").alias("column_order"))
    long = values.join(ids.select(F.col("id").alias("term_id"), "source_key"), "source_key").select("term_id", F.col("pos").alias("locale_id"), "value")
    wide = G.long_to_wide(ids.drop("created"), named, long, ["한국어", "독어_독일"]).orderBy("sort_order")
    out = tmp_path / "out.csv"
    files.write_glossary(wide, [["key", "Rule", "한국어", "독어_독일"], ["", "", "ko_KR", "de_DE"], ["", "", "", ""]], ["source_key", "rule_text", "한국어", "독어_독일"], str(out))
    again = G.wide_to_long(files.glossary_cells(spark, str(out)))
    assert {tuple(r) for r in again[2].select("source_key", "value").collect()} == {("SmartHome", "스마트홈"), ("SmartHome", "SmartHome"), ("AI", "AI"), ("AI", "KI")}
    assert [r["source_key"] for r in G.active(ids).collect()] == ["SmartHome"]
    entries = {r["source_key"]: [e["key"] for e in r["entries"]] for r in G.targets(ids, named, long).collect()}
    assert entries["AI"] == ["한국어", "ko_KR", "영어_미국", "en_US", "독어_독일", "de_DE"]


def test_glossary_imports(spark):
    old = spark.createDataFrame([(1, "A", "r", 0), (2, "B", None, 1)], "id int, source_key string, rule_text string, sort_order int")
    new = spark.createDataFrame([("A", "r2", 9), ("C", "", 3)], "source_key string, rule_text string, sort_order int")
    merged, counts = G.imported(old, new, "source_key", replace=False)
    assert {tuple(r) for r in merged.collect()} == {(1, "A", "r2", 0), (2, "B", None, 1), (3, "C", "", 3)}
    assert tuple(counts.first()) == (1, 1)
    replaced, counts = G.imported(old, new, "source_key", replace=True)
    assert replaced.count() == 2 and tuple(counts.first()) == (2, 0)
    with pytest.raises(KeyError):
        G.existing_or_fail(old, new, "source_key")


def test_workbook_round_trip(spark, tmp_path):
    cells = [("a.xlsx", "KR", 0, 5, 3, "story_019", None), ("a.xlsx", "KR", 0, 7, 2, None, '="//story_"&RIGHT($C$5,3)&"_title"'), ("a.xlsx", "KR", 0, 7, 3, " 제목 <&> ", None), ("a.xlsx", "DE(독일)", 1, 7, 3, "Titel", None), ("a.xlsx", "DE(독일)", 1, 8, 3, "x", None), ("b.xlsx", "S", 0, 30, 28, "weit", None)]
    df = spark.createDataFrame(cells, "file string, sheet string, sheet_ord int, row int, col int, value string, formula string")
    folder = str(tmp_path / "books")
    workbook.write_workbooks(df, folder)
    (tmp_path / "books" / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "books" / "~$a.xlsx").write_bytes(b"lock")
    back = workbook.read_workbooks(spark, folder)
    assert {tuple(r)[:7] for r in back.where("error is null").collect()} == set(cells)
    assert [r["file"] for r in back.where("error is not null").collect()] == ["bad.xlsx"]
    t = workbook.texts(back.where("error is null")).withColumn("key", T.formula_key(F.col("code"), F.col("story")))
    rows = {(r["sheet"], r["row"]): (r["story"], r["key"], r["text"]) for r in t.where("file = 'a.xlsx'").collect()}
    assert rows["KR", 7] == ("story_019", "//story_019_title", "제목 <&>") and rows["DE(독일)", 7][2] == "Titel"
    src, tgt = t.where("sheet = 'KR'").select("file", "row", "text"), t.where("sheet <> 'KR'").select("file", "row", "sheet", "text")
    assert [r["id"] for r in M.pair_cells(src, tgt).collect()] == ["a.xlsx::DE(독일)::7"]
    listed = files.listing(spark, folder)
    assert {r["filename"] for r in listed.collect()} == {"a.xlsx", "b.xlsx", "bad.xlsx"}
    assert M.unprocessed(listed, listed.where("filename = 'a.xlsx'"), ["filename", "mtime"]).count() == 2


def test_ranges_and_edits(spark):
    cells = spark.createDataFrame([("S", r, c, f"{r}{c}") for r in range(5, 12) for c in range(2, 5)], "sheet string, row int, col int, value string")
    pick = lambda x: {(r["row"], r["col"]) for r in cells.where(C.in_ranges(x, F.col("row"), F.col("col"))).collect()}
    assert pick("C7:C9,c8, D11") == {(7, 3), (8, 3), (9, 3), (11, 4)} and len(pick("B:B")) == 7
    with pytest.raises(ValueError):
        C.in_ranges("7C", F.col("row"), F.col("col"))
    edits = spark.createDataFrame([("S", 7, 3, "neu")], "sheet string, row int, col int, new_value string")
    after, log = C.edited(cells, edits, ["sheet", "row", "col"])
    assert [tuple(r) for r in log.collect()] == [("S", 7, 3, "73", "neu")]
    diff = C.differences(cells, after, ["sheet", "row", "col"], "value")
    assert tuple(C.verified(diff, edits, ["sheet", "row", "col"]).first()) == (0, 0)
    with pytest.raises(ValueError):
        C.edited(cells, edits.withColumn("row", F.lit(99)), ["sheet", "row", "col"])
    with pytest.raises(ValueError):
        C.edited(cells, edits.union(edits), ["sheet", "row", "col"])


def test_layout_groups(spark):
    cells = spark.createDataFrame([("f", "s", 7, "k", "Title"), ("f", "s", 8, "k", "x"), ("f", "s", 10, "k", "T1"), ("f", "s", 12, None, None), ("f", "s", 15, "k", None)], "file string, sheet string, row int, code string, text string")
    got = {r["group_id"]: [f["field"] for f in r["fields"]] for r in C.section_groups(cells).collect()}
    assert got == {0: ["title", "description"], 1: ["title"]}


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a", "f"), (2, "b", None)], "id int, v string, flag string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", None), (1, "A", None)], "id int, v string, flag string")
    once = M.upsert(old, new, ["id"], keep=["flag"])
    assert {tuple(r) for r in once.collect()} == {(1, "A", "f"), (2, "B", None), (3, "c", None)}
    assert {tuple(r) for r in M.upsert(once, new, ["id"], keep=["flag"]).collect()} == {tuple(r) for r in once.collect()}
    assert M.with_missing_columns(old, {"tone": "string", "v": "string"}).columns == ["id", "v", "flag", "tone"]
    assert M.delete(old, F.col("flag") == "f").count() == 1


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m[7] = m[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, []), (902, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    old, V.QUERY_BLOCK = V.QUERY_BLOCK, 3
    try:
        got = {}
        for r in V.nearest(df, df.where("id % 50 = 0 and id < 900"), 5).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    finally:
        V.QUERY_BLOCK = old
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q, hits in got.items():
        d = 1 - unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        assert [i for _, i in sorted(hits)] == order
    assert len(got) == 6
    assert V.nearest(df.limit(0), df.where("id = 0"), 3).count() == 0 and V.nearest(df, df.limit(0), 3).count() == 0


def test_tiers_have_no_repeats(spark):
    a = spark.createDataFrame([(1, "x", 5), (1, "y", 6)], "q int, t string, id int")
    b = spark.createDataFrame([(1, "x", 1), (1, "z", 2), (1, "z", 3), (2, "w", 9)], "q int, t string, id int")
    got = [(r["q"], r["t"], r["rank"]) for r in V.tiered([a, b], "q", ["t"], [F.col("id")], 3).orderBy("q", "rank").collect()]
    assert got == [(1, "x", 1), (1, "y", 2), (1, "z", 3), (2, "w", 1)]
    rows = spark.createDataFrame([(1, "100%"), (2, "100 x"), (3, None)], "id int, t string")
    assert [r["id"] for r in V.browse(rows, {"id": None}, "0%", ["t"]).collect()] == [1]
    assert [r["id"] for r in V.page(rows, [F.col("id")], 2, 2).collect()] == [3]


def test_reports(spark):
    texts = spark.createDataFrame([(1, "head\n--- 1\nGrade: A\n--- 2\n등급: B\nend"), (2, "no marks"), (3, None)], "id int, text string")
    lines = R.lines(texts, "id", "text")
    assert [tuple(r) for r in R.blocks(lines, "id", "line", F.col("value").startswith("---")).orderBy("first").collect()] == [(1, 2, 3), (1, 4, 6)]
    assert {r[0] for r in lines.select(R.grade_of(F.col("value"))).collect()} == {None, "A", "B"}
    said = {"감수안 수용 비추천, 미반영": "reject", "부분 수용": "partial", "유지": "no_apply", "유지함": "conditional_or_other", "추가 적용 없음": "no_apply", "번역사 의견 전체 반영": "accept", "수용.": "accept", "수용": "conditional_or_other", "수용 가능하나 미반영": "reject"}
    assert column(spark, [*said, None], R.judgment(F.col("v"))) == [*said.values(), "conditional_or_other"]
    assert [[tuple(x) for x in r] for r in column(spark, ["[1] DE(독일) | 처리 완료 셀: 12\n[2] FR | 처리 완료 셀: 3", "none"], R.scope_counts(F.col("v")))] == [[("DE(독일)", 12), ("FR", 3)], []]
    marks = (F.col("value") == "# A", F.col("value").startswith("# "))
    doc = R.lines(spark.createDataFrame([(1, "x\n# A\ny\nz\n# B\nw"), (2, "# A\nq"), (3, "no")], "id int, text string"), "id", "text")
    assert {(r["id"], r["value"]) for r in R.between(doc, "id", "line", *marks).collect()} == {(1, "y"), (1, "z"), (2, "q")}
    cells = spark.createDataFrame([("s", "a", "a", None), ("s", "a", "b", "c"), ("s", None, "", ""), ("s", "a", None, None), ("t", "a", None, None)], "sheet string, cur string, rev string, com string")
    assert [tuple(r) for r in R.review_figures(cells, "sheet", F.col("cur"), F.col("rev"), F.col("com")).collect()] == [("s", 3, 1, 1)]
    assert column(spark, [5, 7, 6], R.average_tokens(F.col("v"), F.lit(2)), kind="int") == [2, 4, 3]
    table = spark.createDataFrame([("s", 2, "a|b"), ("s", 1, "x\ny")], "g string, n int, v string")
    assert R.markdown_table(table, "g", ["n", "v"], ["n"]).first()["markdown"] == "| n | v |\n| --- | --- |\n| 1 | x y |\n| 2 | a\\|b |"


def test_json_sources(spark):
    text = json.dumps({"DE(독일)": {"lang": "German", "code": "de_DE"}})
    assert [tuple(r) for r in files.sheet_map(spark, text).collect()] == [("DE(독일)", "German", "de_DE")]
    assert {tuple(r) for r in files.denylist(spark, '{"reason":"r","ids":["a","b","a"]}').collect()} == {("a", "r"), ("b", "r")}
    e = files.edits(spark, '[{"sheet":"S","cell":"c7","new_value":"n"},{"sheet":"S","col":3,"row":8,"new_value":"m"},{"sheet":"S","col":"d","row":9,"new_value":"k"}]')
    assert [r[0] for r in e.select(T.cell_name(F.col("cell"), F.col("col"), F.col("row"))).collect()] == ["C7", "C8", "D9"]


def test_streams_equal_batches(spark, tmp_path):
    import datetime

    t0 = datetime.datetime(2026, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i), None) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    folder = str(tmp_path / "in")
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    stream = S.event_stream(spark, folder, "*.parquet", per_trigger=1)
    q = S.tumbling(stream, "1 hour", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("w1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in S.tumbling(S.at_utc(df), "1 hour", ["event_type"]).collect()}
    assert {tuple(r) for r in spark.table("w1").collect()} == want
    assert sum(p["rows"] for p in S.progress_of(q)) == 60
    # in order of time no event is late, so every closed session is written
    ordered = str(tmp_path / "ordered")
    for k in range(3):
        df.where(F.floor(F.col("event_id") / 20) == k).coalesce(1).write.mode("append").parquet(ordered)
    q = S.sessions(S.event_stream(spark, ordered, "*.parquet", per_trigger=1), "10 minutes", ["user_id"], late="1 hour").writeStream.outputMode("append").format("memory").queryName("w2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    every = S.sessions(S.at_utc(df), "10 minutes", ["user_id"])
    latest = S.at_utc(df).agg(F.max("ts")).first()[0]
    # a session is written once the watermark, an hour behind the latest event, has passed its end
    closed = {tuple(r) for r in every.where(F.col("end") <= F.lit(latest) - F.expr("interval 1 hour")).collect()}
    assert {tuple(r) for r in spark.table("w2").collect()} == closed and len(closed) > 20
    q = S.usage_counters(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("w3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("w3").collect()} == {("a", 30, 870.0), ("b", 30, 900.0)}
    # upserts by batch into a snapshot on disk, swapped whole
    state = {"at": None, "n": 0}

    def read():
        return spark.read.parquet(state["at"]) if state["at"] else df.limit(0).withColumn("ts", F.col("ts").cast("timestamp"))

    def write(out):
        state["n"] += 1
        path = str(tmp_path / f"snap{state['n']}")
        out.write.parquet(path)
        state["at"] = path

    S.upsert_batches(stream, read, write, lambda old, new: M.upsert(old, new.select(*old.columns), ["event_id"]), str(tmp_path / "ckpt")).awaitTermination(120)
    assert read().count() == 60 and state["n"] == 3


def test_load_by_ledger(spark):
    memory = spark.createDataFrame([("a::DE::1", "s1", "a", "old", "f"), ("b::DE::1", "s1", "b", "stale", None), ("c::DE::1", "s2", "c", "same", None), ("d::DE::1", None, "d", "kept", None)], "id string, story_id string, original_file string, t string, tone_flag string")
    ledger = spark.createDataFrame([("a", "s1", "1", 1), ("b", "s1", "1", 1), ("c", "s2", "1", 1)], "filename string, story_id string, mtime string, record_count int")
    files = spark.createDataFrame([("a", "2", "s1"), ("c", "1", "s2"), ("e", "1", None)], "filename string, mtime string, story_id string")
    new = spark.createDataFrame([("a::DE::1", "s1", "a", "new", None), ("a::DE::2", "s1", "a", "more", None), ("c::DE::1", "s2", "c", "other", None)], memory.schema)
    rows, book = M.load_by_ledger(memory, ledger, files, new)
    assert {(r["id"], r["t"], r["tone_flag"]) for r in rows.collect()} == {("a::DE::1", "new", "f"), ("a::DE::2", "more", None), ("c::DE::1", "same", None), ("d::DE::1", "kept", None)}
    assert {tuple(r) for r in book.collect()} == {("a", "s1", "2", 2), ("b", "s1", "1", 1), ("c", "s2", "1", 1), ("e", None, "1", 0)}
    again, same = M.load_by_ledger(rows, book, files, new)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.collect()} and {tuple(r) for r in same.collect()} == {tuple(r) for r in book.collect()}
    forced, _ = M.load_by_ledger(rows, book, files, new, force=True)
    assert {(r["id"], r["t"]) for r in forced.collect()} == {("a::DE::1", "new"), ("a::DE::2", "more"), ("c::DE::1", "other"), ("d::DE::1", "kept")}


def test_examples_by_tiers(spark):
    rows = spark.createDataFrame([(1, "us", "Open", "DE", "Öffnen", "s1"), (2, "us", "Open it", "DE", "Öffne es", "s2"), (3, "us", "Open it", "AT", "Mach auf", "s3"), (4, "us", "Shut", "FR", "Fermer", "s4"), (5, "kr", "Open", "DE", "x", "s5")], "pair_id int, source_group string, source_text string, target_lang string, target_text string, section_code string")
    asked = spark.createDataFrame([(1, "us", "Open", "DE"), (2, "us", "Close", None), (3, "us", "none", "IT")], "query_id int, source_group string, source_text string, target_lang string")
    hits = spark.createDataFrame([(1, "Open", 0.0), (1, "Open it", 0.2), (1, "Shut", 0.3), (2, "Open it", 0.25), (2, "Shut", 0.9), (3, "Open", 0.1)], "query_id int, source_text string, distance double")
    found = V.exact_then_nearest(asked, rows, hits, 2)
    assert sorted(tuple(r)[:5] for r in found.collect()) == [(1, 1, "exact", 1.0, 1), (1, 2, "semantic", 0.8, 2), (2, 1, "semantic", 0.75, 3)]
    text = {r["query_id"]: r["examples"] for r in V.examples_text(found).collect()}
    assert text[1] == '[Translation Memory Examples]\nExample 1 (match: exact, section: s1):\n  Source: "Open"\n  Translation: "Öffnen"\n\nExample 2 (match: semantic, similarity: 0.8, section: s2):\n  Source: "Open it"\n  Translation: "Öffne es"'
    assert V.by_mode("auto", offline=lambda: 1, semantic=None) == 1 and V.by_mode("offline", offline=lambda: 2) == 2
    with pytest.raises(ValueError):
        V.by_mode("semantic", offline=lambda: 1)


def test_prompts_and_calls(spark):
    df = spark.createDataFrame([("a", " "), ("b", "rule")], "t string, r string")
    assert [r[0] for r in df.select(B.assembled(F.col("t"), F.col("r"), F.lit(None).cast("string"), F.lit("end "))).collect()] == ["a\n\nend", "b\n\nrule\n\nend"]
    seen = []

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    texts = spark.createDataFrame([(t,) for t in ["a", None, "b", "bad", "c"]], "v string").coalesce(1)
    assert [r[0] for r in texts.select(B.called(F.col("v"), model, "string", batch=2)).collect()] == ["A", None, "B", None, None]
    assert seen == []
    status = column(spark, ['{"grade":"Needs Revision"}', '{"is_excellent":false}', '{"grade":"Excellent"}', "{broken 오류", "fine", "", "[AI QA 오류] x", '{"grade":"Excellent","suggested_fix":"y"}'], P.item_status(F.lit(""), F.lit(""), F.col("v"))["status"])
    assert status == ["fail", "fail", "pass", "fail", "pass", "pass", "fail", "warn"]


def test_glossary_changes(spark):
    terms = spark.createDataFrame([(1, "A", "r", 0)], "id int, source_key string, rule_text string, sort_order int")
    assert {tuple(r) for r in G.created(terms, " B ", "x").collect()} == {(1, "A", "r", 0), (2, "B", "x", 1)}
    assert {tuple(r) for r in G.created(terms, "A", "x").collect()} == {(1, "A", "x", 0)}
    assert {tuple(r) for r in G.updated(terms, 1, "C").collect()} == {(1, "C", "", 0)}
    with pytest.raises(KeyError):
        G.updated(terms, 9, "C")
    with pytest.raises(ValueError):
        G.created(terms, " ")
    assert G.seeded(terms, terms.drop("id"))[1] is False and G.seeded(terms.limit(0), None)[1] is False and G.seeded(terms.limit(0), terms.drop("id"))[1] is True
    paths = []
    with pytest.raises(RuntimeError):
        G.exported(terms, lambda df, p: open(p, "w").write("x"), lambda p: paths.append(p) or (_ for _ in ()).throw(RuntimeError()))
    assert paths and not os.path.exists(paths[0])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from lexiloom import session

    said = []
    gone = N(isEmpty=lambda: True)
    context = lambda master: N(getConf=lambda: N(get=lambda k, d: None), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: gone)), master=master, setCheckpointDir=said.append)
    fake = lambda master: N(sparkContext=context(master), conf=N(get=lambda k, d: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("local-cluster[2,1,1024]"))
    assert session.shared_dir(fake("local[4]")) == said[0]


def test_core_stands_without_the_optional_package():
    import re
    from pathlib import Path

    root = Path(__file__).parent.parent / "lexiloom"
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not [p for p in own if re.search(r"(from|import)\s+\S*\bllm\b", p.read_text())]
    assert os.path.exists(root / "registry.py")
