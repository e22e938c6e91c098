import unicodedata

from pyspark.sql import functions as F

from lexiloom.llm import canonical, dressed, forms, langid, tokens

SCHEMA = "pair_id long, source_text string, target_text string, key string, field string, text string"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, s, t, "k", "f", "x") for i, (s, t) in enumerate(texts)], SCHEMA)


def test_canonical_repairs_each_case(spark):
    texts = [
        ("Open Tikapimo now", "Тикет готов и открыт"),
        ("Ｏｐｅｎ Ti​kapimo now", "Oуvrir"),
        ("Оpеn Tikapimo now", unicodedata.normalize("NFD", "déjà")),
        ("Open，now！", None),
        ("", "ㅋㅋ 조명"),
        ("Open Tikapimo now", unicodedata.normalize("NFD", "조명")),
    ]
    got = {(r["pair_id"], r["field"]): r for r in canonical.canonical_texts(rows_of(spark, texts), "pair_id", ["source_text", "target_text"]).collect()}
    assert got[1, "source_text"]["canonical"] == "Open Tikapimo now"
    assert got[2, "source_text"]["canonical"] == "Open Tikapimo now"
    assert got[2, "target_text"]["canonical"] == "déjà"
    assert got[3, "source_text"]["canonical"] == "Open，now！" and not got[3, "source_text"]["is_case"]
    assert (3, "target_text") not in got and got[4, "source_text"]["canonical"] == ""
    assert got[4, "target_text"]["canonical"] == "ㅋㅋ 조명" and not got[4, "target_text"]["is_case"]
    assert got[5, "target_text"]["canonical"] == "조명" and got[5, "target_text"]["is_case"]
    # Oуvrir mixes alphabets but its repair is no word of the corpus: it stays and is reported
    assert got[1, "target_text"]["canonical"] == "Oуvrir" and got[1, "target_text"]["is_case"]
    assert not got[0, "target_text"]["is_case"]
    assert (got[1, "source_text"]["kinds"], got[2, "source_text"]["kinds"], got[1, "target_text"]["kinds"], got[0, "target_text"]["kinds"]) == (["form"], ["mixed"], ["unknown"], [])
    found = {tuple(r) for r in canonical.disguised(rows_of(spark, texts), "pair_id", ["source_text", "target_text"]).collect()}
    assert found == {k for k, r in got.items() if r["is_case"]}


def test_latin_letters_among_cyrillic_words(spark):
    texts = [("Подробнее о Bobubili", "Скажите о нём"), ("Подробнее o Bobubili", "Подробнее и o nosso plano"), ("Open o Bobubili", None)]
    got = {(r["pair_id"], r["field"]): r for r in canonical.canonical_texts(rows_of(spark, texts), "pair_id", ["source_text", "target_text"]).collect()}
    assert got[1, "source_text"]["canonical"] == "Подробнее о Bobubili" and got[1, "source_text"]["kinds"] == ["whole"]
    assert not got[0, "source_text"]["is_case"] and not got[2, "source_text"]["is_case"]


def test_equal_repairs_are_settled_alike(spark):
    # both readings are words of the corpus, equally often
    texts = [("сор cop", None), ("сop", None)]
    runs = {canonical.canonical_texts(rows_of(spark, texts).repartition(n), "pair_id", ["source_text"]).where("pair_id = 1").first()["canonical"] for n in (1, 3, 5)}
    assert len(runs) == 1


def test_canonical_is_stable_and_takes_empty_tables(spark):
    texts = [("ﬁlter ８７ ｶﾞ", "x" * 20_000 + " ＡＢ")]
    once = canonical.canonical_texts(rows_of(spark, texts), "pair_id", ["source_text", "target_text"])
    out = {r["field"]: r["canonical"] for r in once.collect()}
    assert out == {"source_text": "filter 87 ガ", "target_text": "x" * 20_000 + " AB"}
    again = canonical.canonical_texts(rows_of(spark, [(out["source_text"], out["target_text"])]), "pair_id", ["source_text", "target_text"])
    assert not any(r["is_case"] for r in again.collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert canonical.canonical_texts(empty, "pair_id", ["source_text"]).count() == 0
    assert canonical.disguised(empty, "pair_id", ["source_text"]).count() == 0


def test_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" X ",), ("None",), ("ok",), (" ",)], "t string")
    assert [r[0] for r in df.select(forms.blank(F.col("t"))).collect()] == [True, True, True, True, False, True]


def test_longest_match_equals_brute_force():
    vocabulary = {b"un", b"unaff", b"aff", b"able", b"affab", b"ab", b"le", b"x", b"\xea\xb0"}
    trie = tokens.Trie(*tokens.build(set(vocabulary)))

    def brute(w):
        n, i = 0, 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in vocabulary), i + 1)
            i, n = j, n + 1
        return n

    import itertools

    for w in ["".join(x) for k in range(1, 5) for x in itertools.product(["un", "aff", "ab", "le", "f", "가"], repeat=k)]:
        assert trie.word(w.encode()) == brute(w.encode()), w


def test_token_totals(spark):
    df = spark.createDataFrame([("us", "a", "ab cd"), ("us", "b", None), ("kr", "a", ""), ("kr", None, "ab cd")], "source string, level string, text string")
    count = tokens.longest_match(spark)
    t = tokens.token_totals(df, "text", count, {"source": F.col("source"), "file": F.col("level")})
    got = {(r["level"], r["source"], r["file"]): (r["texts"], r["tokens"]) for r in t.collect()}
    n = df.select(count(F.col("text")).alias("n")).agg(F.max("n")).first()[0]
    assert got["source", "us", None] == (1, n) and got["source", "kr", None] == (2, n)
    assert got["file", None, "a"] == (2, n) and got["all", "us", "b"] == (0, 0)
    assert tokens.token_totals(df.limit(0), "text", count, {"source": F.col("source")}).count() == 0


def test_exact_byte_pair_counts():
    import tiktoken

    ranks = tokens.read_vocabulary(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = tokens.BytePair(ranks)
    for text in ["", "Hello  world\n\n it's 12,5 %", "저녁이 되면 냉장고", "x" * 3000, "a b\t\t c"]:
        assert own.count(text) == len(enc.encode_ordinary(text))


def test_languages(spark):
    de = ["Der Kühlschrank merkt den Plan.", "Am Abend regelt die Lampe das Licht.", "Öffnen"]
    en = ["The fridge remembers the plan.", "In the evening the lamp controls the light.", "Open"]
    ko = ["냉장고가 계획을 기억합니다.", "저녁이 되면 조명이 켜집니다.", "열기"]
    train = [(t, lang) for lang, ts in (("de", de), ("en", en), ("ko", ko)) for t in ts for _ in range(30)]
    model = langid.fit(train)
    rows = spark.createDataFrame(
        [
            (1, "Der Kühlschrank merkt den Plan.", "de", "de", "f1", "s"), (2, "The fridge remembers the plan.", "de", "de", "f1", "s"), (3, "Der Kühlschrank merkt den Plan. In the evening the lamp controls the light.", "de", "de", "f1", "s"),
            (4, None, "de", "de", "f1", "s"), (5, " x ", "de", "de", "f1", "s"), (6, "12 34", "en", None, None, None), (7, "냉장고가 계획을 기억합니다.", None, None, "f2", "s"), (8, "Open Tikapimo", "en", "en", "f1", "s"),
        ],
        "pair_id long, t string, declared string, suffix string, host string, grp string",
    )
    found = langid.languages(rows, model, "pair_id", "t", "declared", "suffix", "host", "grp")
    bad = {tuple(r) for r in langid.mislabelled(found, "pair_id").collect()}
    assert bad == {(2, "en"), (3, "de"), (3, "en"), (7, "ko")}
    every = {r["pair_id"]: r["languages"] for r in found.collect()}
    assert set(every) == {1, 2, 3, 6, 7, 8} and all(0 < x["confidence"] <= 1 for v in every.values() for x in v)
    assert every[3][0]["segments"] in ([0], [1])
    assert langid.languages(rows.limit(0), model, "pair_id", "t", "declared", "suffix", "host", "grp").count() == 0


def test_dressed_duplicates(spark):
    rows = spark.createDataFrame(
        [
            (1, "de", "Requires: Ab 5; Version: 7.0; Note: x y"), (2, "de", "VERSION : 7.0 /  Note: x y / requires: AB 5!"), (3, "fr", "Requires: Ab 5; Version: 7.0; Note: x y"),
            (4, "de", "One two. Three four."), (5, "de", "Three four. One two."), (6, "de", "one  TWO three-four"), (7, None, "One two. Three four."), (8, "de", None), (9, "de", " ?! "), (10, "de", "One two. Three four."), (11, "de", "… !"),
        ],
        "id long, lang string, text string",
    ).withColumn("_t", F.lit("clash")).withColumn("class_id", F.lit(1))
    got = {r["id"]: (r["group_id"], r["copies"]) for r in dressed.duplicate_groups(rows, "id", ["lang"], "text").collect()}
    assert got == {1: (1, 2), 2: (1, 2), 4: (4, 3), 6: (4, 3), 10: (4, 3)}
    one = {r["id"]: r["copies"] for r in dressed.collapse(rows, "id", ["lang"], "text").where("lang is not null").collect()}
    assert one == {1: 2, 3: 1, 4: 3, 5: 1}
    assert dressed.duplicate_groups(rows.limit(0), "id", ["lang"], "text").count() == 0
