import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import golay, leakage, locale_match, near, overlap, packing, pii, survivor

LANGS = [("DE(독일)", "German Germany", "de_DE", "독어_독일", "de"), ("AT(오스트리아)", "German Austria", "de_AT", "독어_오스트리아", "de"), ("ES(스페인)", "Spanish Spain", "es_ES", "서반아어_스페인", "es"), ("JA(일본)", "Japanese", "ja_JP", "일어_일본", "ja")]


@pytest.fixture(scope="module")
def langs(spark):
    return spark.createDataFrame(LANGS, "sheet string, lang string, code string, display string, iso string")


def test_typed_names(spark, langs):
    typed = {
        "DE(독일)": "de_DE", " de ( 독일 )": "de_DE", "DE（독일）": "de_DE", "독일_독어": "de_DE", "Germna Germany": "de_DE", "Deutschland": "de_DE", "AT(스오트리아)": "de_AT", "España": "es_ES", "Spnish Spain": "es_ES",
        "Danish": "unmatched", "Japnese": "ja_JP", "ja-JP": "ja_JP", "日本語": "ja_JP", "Sheet1": "unmatched", "046": "unmatched", "RO(루마니아)": "unmatched", "": None, " ": None, None: None, "x" * 5000: "unmatched",
    }
    m = locale_match.Matcher(langs)
    df = spark.createDataFrame([(k,) for k in typed], "t string")
    assert {r["t"]: r["c"] for r in df.select("t", m.code(F.col("t")).alias("c")).collect()} == typed
    assert df.limit(0).select(m.code(F.col("t"))).count() == 0


def test_typed_values_leave_literal_names_out(spark, langs):
    pairs = spark.createDataFrame([(1, "DE(독일)", 9), (2, "Germany", 9), (3, None, 9), (4, "  ", 9)], "pair_id long, target_lang string, code int")
    locales = spark.createDataFrame([(1, "독어_독일"), (2, "copy"), (3, "일본_일어")], "id int, header_display string")
    got = {tuple(r) for r in locale_match.typed_values(pairs, locales, langs).collect()}
    assert got == {("rag_pairs", 2, "de_DE"), ("glossary_locales", 2, "unmatched"), ("glossary_locales", 3, "ja_JP")}


def test_weighted_distance():
    d = locale_match.distance
    assert d("ab", "ba") == pytest.approx(0.8) and d("book", "bok") == pytest.approx(0.8) and d("a", "e") == pytest.approx(0.9) and d("", "abc") == 3
    assert "gemany" in locale_match.deletions("germany", 1)


def test_golay_code():
    rng = random.Random(3)
    for _ in range(200):
        w = rng.getrandbits(23)
        own = int(golay.index(np.array([w], np.uint32))[0])
        k = {int(x) for x in golay.keys(np.array([w], np.uint32))[0] if x >= 0}
        assert own in k and len(k) in (1, 6)
        for bits in itertools.islice(itertools.combinations(range(23), 2), 0, 253, 17):
            v = w ^ sum(1 << b for b in bits)
            assert k & {int(x) for x in golay.keys(np.array([v], np.uint32))[0] if x >= 0}


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3))
    parts = ["In winter the {} prepares the room {} in the garage", "Before bedtime the {} controls the alarm of {} without noise", "{} works with {} from version 3", "After work the {} protects the family of {} by voice"]
    texts = []
    for _ in range(n):
        base = [rng.choice(parts).format(name(), name()) for _ in range(4)]
        texts.append(". ".join(base) + ".")
        if rng.random() < 0.5:
            edited = [s.replace("the", "a", 1) if rng.random() < 0.4 else s for s in base]
            rng.shuffle(edited)
            texts.append(". ".join(edited[: rng.choice([3, 4])]) + ".")
    return texts + texts[:5] + [None, "", "short", "short"]


def brute(texts, least, size):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    sets = {}
    for t in texts:
        if t and words(t):
            w = words(t)
            sets[" ".join(w)] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}
    return {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if len(x & y) >= least * len(x | y)}


@pytest.mark.parametrize("hot", [200, 4, 2])
def test_near_pairs_equal_brute_force(spark, hot):
    texts = corpus()
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, node int")
    nodes, pairs = near.near_pairs(df, "text", 0.5, 3, hot=hot)
    shown = {r["node"]: " ".join(re.findall(r"[^\W_]+", r["shown"])) for r in nodes.collect()}
    got = {tuple(sorted((shown[r["a"]], shown[r["b"]]))) for r in pairs.collect()}
    want = brute(texts, 0.5, 3)
    assert len(want) > 20 and got == want


def without_a_common_sentence(n=60, seed=8):
    """Texts and their twins with a word changed in each sentence."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3))
    texts = []
    for _ in range(n):
        base = [[name() for _ in range(rng.randint(7, 9))] for _ in range(3)]
        edited = [list(x) for x in base]
        for x in edited:
            x[rng.randrange(len(x))] = name()
        texts += [". ".join(map(" ".join, x)) for x in (base, edited)]
    return texts


def test_near_pairs_that_share_no_sentence_are_all_found(spark):
    texts = without_a_common_sentence()
    nodes, pairs = near.near_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 0.4, 3)
    shown = {r["node"]: " ".join(re.findall(r"[^\W_]+", r["shown"])) for r in nodes.collect()}
    want = brute(texts, 0.4, 3)
    assert len(want) > 40 and {tuple(sorted((shown[r["a"]], shown[r["b"]]))) for r in pairs.collect()} == want


@pytest.mark.parametrize("hot", [200, 2])
def test_near_pairs_edited_in_every_side_are_all_found(spark, hot):
    """Twins of one long sentence with edits all over it share neither a sentence nor a side of one; short texts share all their words or few."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary[:4], k=rng.randint(1, 5))) for _ in range(60)]
    for _ in range(60):
        base = rng.choices(vocabulary, k=40)
        edited = list(base)
        for i in (3, 12, 21, 30):
            edited[i + rng.randrange(4)] = rng.choice(vocabulary)
        texts += [" ".join(base), " ".join(edited)]
    nodes, pairs = near.near_pairs(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 0.45, 3, hot=hot)
    shown = {r["node"]: r["shown"] for r in nodes.collect()}
    want = brute(texts, 0.45, 3)
    assert len(want) > 60 and {tuple(sorted((shown[r["a"]], shown[r["b"]]))) for r in pairs.collect()} == want


@pytest.mark.parametrize(("least", "hot", "splits"), [(0.45, 2, 3), (0.45, 20, 1), (0.8, 2, 2), (1.0, 2, 1), (0.1, 3, 2)])
def test_candidates_lose_no_pair_of_sets(spark, least, hot, splits):
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(120):  # few elements held by many sets, and sets of one element to thirty
        own = {int(x) for x in rng.zipf(1.3, rng.integers(1, 30)) % 500}
        sets += [own, own ^ {int(x) for x in rng.integers(500, 520, rng.integers(0, 3))}]
    hashes = rng.integers(-(2**63), 2**63, 520)
    df = spark.createDataFrame([(i, [int(hashes[x]) for x in s]) for i, s in enumerate(sets)], "node long, s array<long>")
    want = {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2) if len(x & y) / len(x | y) >= least}
    got = [tuple(r) for r in overlap.candidates(df, least, hot, splits).collect()]
    assert len(want) > 5 and len(got) == len(set(got)) and want <= set(got)
    assert overlap.candidates(df.limit(0), least, hot, splits).count() == 0


def test_near_pairs_of_empty_tables(spark):
    df = spark.createDataFrame([], "text string, id long, by string")
    assert near.near_pairs(df, "text")[1].count() == 0
    assert near.near_rows(df, "id", "by", "text", 0.5, 3).count() == 0
    assert near.near_groups(df, "id", "by", "text", 0.5, 3).count() == 0


def test_near_rows_leave_copies_out(spark):
    t = "In winter the bodo prepares the room gafu in the garage. Fumo works with dabe from version 3."
    rows = [(1, "de", t), (2, "de", t.upper()), (3, "de", t.replace("garage", "garden")), (4, "fr", t.replace("garage", "garden")), (5, None, t), (6, "de", None)]
    got = {(r["a"], r["b"]) for r in near.near_rows(spark.createDataFrame(rows, "id long, by string, text string"), "id", "by", "text", 0.45, 3).collect()}
    assert got == {(1, 3), (2, 3)}
    groups = {(r["kind"], r["a"], r["b"]) for r in near.near_groups(spark.createDataFrame(rows, "id long, by string, text string"), "id", "by", "text", 0.45, 3).collect()}
    assert groups == {("link", 1, 3), ("member", 1, 1), ("member", 2, 1), ("member", 3, 3)}


def test_survivors(spark):
    rows = [
        (1, "a", "old", None, "2025-01-01 00:00:00", 1), (2, "a", "new", "t", "2025-01-02 00:00:00", 1), (3, "a", "X", "", "2025-01-03 00:00:00", 1), (4, "a", "tie", None, "2025-01-02 00:00:00", 1),
        (5, "b", None, None, None, 1), (6, "b", " none ", None, None, 1), (7, "c", "alone", None, None, 1), (8, None, "n", None, None, 1), (9, None, "n", None, None, 1),
    ]
    df = spark.createDataFrame(rows, "id long, g string, v string, w string, at string, copies int").withColumn("at", F.to_timestamp_ntz("at"))
    out = {r["g"]: r for r in survivor.survivors(df, {"g": F.col("g")}, ["v", "w"], "id", "at", half_life_s=survivor.STEEP).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"]["v"], out["a"]["v_from"], out["a"]["w"], out["a"]["w_from"], out["a"]["group_id"], out["a"]["copies"]) == ("tie", 4, "t", 2, 1, 4)
    assert out["b"]["v"] is None and out["b"]["v_from"] is None and out["b"]["copies"] == 2
    # with a slow decay two older votes beat one newer
    votes = spark.createDataFrame([(1, "a", "x y", "2025-01-01 00:00:00"), (2, "a", "X  Y", "2025-01-02 00:00:00"), (3, "a", "z", "2025-01-03 00:00:00")], "id long, g string, v string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    slow = survivor.survivors(votes, {"g": F.col("g")}, ["v"], "id", "at", half_life_s=1e9).first()
    assert (slow["v"], slow["v_from"]) == ("X  Y", 2)
    trusted = survivor.survivors(votes, {"g": F.col("g")}, ["v"], "id", "at", trust=F.when(F.col("id") == 3, 5.0).otherwise(1.0), half_life_s=1e9).first()
    assert trusted["v"] == "z"
    assert survivor.survivors(df.limit(0), {"g": F.col("g")}, ["v"], "id", "at").count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "w1 w2")]
    docs = []
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            src = rng.choice(items[:30])[1].split()
            k = rng.randint(0, max(0, len(src) - 9))
            cut = src[k : k + rng.randint(8, 14)]
            words[5:5] = [w.upper() + rng.choice([",", "", "!\n"]) for w in cut]
        docs.append((d, " ".join(words)))
    docs += [(200, None), (201, ""), (202, docs[0][1]), (203, docs[0][1])]
    want = set()
    for d, t in docs:
        w = leakage.words_of(t)
        runs = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        want |= {(d, i) for i, x in items for v in [leakage.words_of(x)] for k in range(len(v) - 9) if tuple(v[k : k + 10]) in runs}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string")
    for most in (400_000, 50):  # one block of items, and several
        got = {(r["doc"], r["item"]) for r in leakage.leaks(df, it, whole=False, max_windows=most).where("exact").collect()}
        assert got == want and len(want) > 10
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def test_leaks_of_edited_and_short_items(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(3, 70))]) for i in range(80)]
    docs = []
    for i, words in items:
        copy = list(words)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        docs.append((i, " ".join([rng.choice(vocabulary) for _ in range(20)] + copy + [rng.choice(vocabulary) for _ in range(20)])))
    # brute force: the best weighted similarity of the item with any run of the document of its length
    size = {i: min(5, len(w)) for i, w in items}
    shingle = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    count = {}
    for i, w in items:
        for x in shingle(w, size[i]):
            count[x] = count.get(x, 0) + 1
    weight = lambda x: np.log(1 + len(items) / count[x]) if x in count else np.log(2)
    want = set()
    for d, t in docs:
        w = t.split()
        for i, v in items:
            y = shingle(v, size[i])
            for k in range(len(w) - len(v) + 1):
                x = shingle(w[k : k + len(v)], size[i])
                if x & y and sum(map(weight, x & y)) >= 0.8 * sum(map(weight, x | y)):
                    want.add((d, i))
                    break
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc"], r["item"]) for r in leakage.leaks(df, it).collect()}
    assert len(want) > 40 and len(want & got) >= 0.98 * len(want)
    short = {i for i, w in items if len(w) < 10}
    assert {x for x in want if x[1] in short} == {x for x in got if x[1] in short} and len(short) > 3
    assert leakage.window_sizes(7) == [7] and leakage.window_sizes(10) == [10] and leakage.window_sizes(70) == [10, 40] and leakage.window_sizes(0) == []


def test_block_search_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    rows = [(0, " ".join(f"w{x}" for x in rng.integers(0, 500, 300)))]
    items = leakage.Items(rows, 10, 3, 5)
    prints = items.prints[rng.integers(0, len(items.prints), 400)].copy()
    for i in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    a, b = items.candidates(prints)
    near_ = np.bitwise_count(prints[:, None] ^ items.prints[None, :]) <= 3
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(near_)))))


def test_packing():
    rng = np.random.default_rng(4)
    for cap in (10, 64, 257):
        sizes = np.concatenate([rng.integers(1, cap + 1, 150), np.full(9, cap)])
        at = packing.pack(sizes, cap)
        load = np.bincount(at, sizes)
        assert load.max() <= cap and (load > 0).all() and len(load) >= packing.least_windows(sizes, cap)
    assert sorted(np.bincount(packing.difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    assert len(packing.pack(np.zeros(0, np.int64), 5)) == 0
    with pytest.raises(ValueError):
        packing.pack(np.array([6]), 5)


def test_containers(spark):
    docs = [(i, "word " * n, "n") for i, n in enumerate([0, 1, 5, 9, 40, 40, 500])] + [(90, None, "n")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n string")
    count = F.udf(lambda t: len(t.split()), "long")
    limits = [(1, 16), (2, 64)]
    out = packing.containers(df, limits, count, shard=3)
    rows = out.collect()
    for limit, cap in limits:
        own = [r for r in rows if r["limit_id"] == limit]
        load = {}
        for r in own:
            load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        assert max(load.values()) <= cap
        for doc, text, _ in docs:
            parts = sorted((r["start"], r["tokens"]) for r in own if r["id"] == doc)
            n = len(text.split()) if text else 0
            assert sum(t for _, t in parts) == n and (len(parts) <= 1 or n > cap)
            assert all(a + t == b for (a, t), (b, _) in zip(parts, parts[1:]))
    assert packing.use_of_space(out, limits).count() == 2
    assert packing.containers(df.limit(0), limits, count).count() == 0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    first, last = ["Dora", "Henrik", "Paula", "Iker", "Nora", "Zoë"], ["Velgruven", "Mormonte", "Ostwickel", "Drayholtra", "Tavarrond"]
    texts = []
    for i in range(400):
        f, l = rng.choice(first), rng.choice(last)
        mail = f"{pii._fold(f)}.{pii._fold(l)}@mail.example"
        texts.append(rng.choice([f"Contact: {f} {l} <{mail}>", f"Ms {f} {l.upper()} asked, see {mail}; fallback 020 7946 0{i:03d}.", f"Order no. 4550-1020-{i:04d}", f"{f} {l}, +44 7700 900{i:03d}", f"ID number 666-12-{i:04d}", f"The Thermostat Rutini is on. firmware 01.99.00.{i}", f"host 192.0.2.{i % 250}\nTel. 312-555-{i:04d}", f"{l}, {f}\n{i} Brellin Road, Apt {i}", "Am Abend regelt der Fernseher Tulomo das Licht."]))
    return pii.fit(texts)


def test_personal_information(spark, model):
    text = "Contact: Paula Mormonte <paula.mormonte@mail.example>\nTel. 312-555-0117\nOrder no. 4550-1020-3377\nID number 666-12-3456.\n12 Brellin Road, Apt 4\nPaula Mormonte signed. Der Thermostat Rutini läuft. write to iker_ostwickel [at] mail [dot] example"
    docs = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here", "x"), (5, text, "x"), (6, "word " * 30_000 + "Tel. 312-555-0117", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    got = {}
    for r in pii.found_rows(df, model).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["found"]))
    want = {("name", "Paula Mormonte"), ("email", "paula.mormonte@mail.example"), ("email", "iker_ostwickel [at] mail [dot] example"), ("phone", "312-555-0117"), ("id_number", "666-12-3456"), ("address", "12 Brellin Road, Apt 4")}
    assert got == {1: want, 5: want, 6: {("phone", "312-555-0117")}}
    masked = {r["doc_id"]: r for r in pii.redact(df, model).collect()}
    assert masked[2]["masked"] is None and masked[3]["masked"] == "" and masked[4]["masked"] == "nothing here"
    assert "Paula" not in masked[1]["masked"] and masked[1]["masked"].count("[NAME]") == 2 and "Order no. 4550-1020-3377" in masked[1]["masked"]
    assert pii.found_rows(df.limit(0), model).count() == 0


def exact_marginals(model, cands):
    n = len(cands)
    unary = model.unary(cands)
    src, dst, kind, scale = pii.edges([cands])
    tables = (model.chain, model.skip)
    allowed = [[0, *pii.GROUPS[c.group]] for c in cands]
    total = np.zeros((n, pii.K))
    for labels in itertools.product(*allowed):
        s = sum(unary[i][k] for i, k in enumerate(labels)) + sum(float(tables[e][labels[i], labels[j]]) * w for i, j, e, w in zip(src, dst, kind, scale))
        w = np.exp(s) if s > -60 else 0.0
        for i, k in enumerate(labels):
            total[i, k] += w
    return total / total.sum(axis=1, keepdims=True), kind


@pytest.mark.parametrize("text", [
    "Contact: Paula Mormonte <paula.mormonte@mail.example>, Tel. 312-555-0117",
    "Contact: Paula Mormonte <paula.mormonte@mail.example>. " + "word " * 30 + "Later Mormonte called, and Tel. 312-555-0117 was busy. " + "word " * 30 + "MORMONTE, Paula signed.",
])
def test_messages_agree_with_exact_marginals(model, text):
    cands = pii.candidates(text, model)
    p = pii.infer(model, [cands])[0]
    exact, kind = exact_marginals(model, cands)
    assert ("Later" in text) == bool((kind == 1).any())
    assert (exact.argmax(axis=1) == p.argmax(axis=1)).all() and np.abs(exact - p).max() < 0.1


def test_a_surname_alone_is_known_by_the_full_name(spark, model):
    far = "word " * 40
    full = f"Contact: Paula Mormonte <paula.mormonte@mail.example>. {far}and then Mormonte wrote. {far}Seen by Mormonte twice."
    alone = f"{far}and then Mormonte wrote. {far}"
    df = spark.createDataFrame([(1, full), (2, alone)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.redact(df, model).collect()}
    assert "Mormonte" not in out[1]["masked"] and out[1]["masked"].count("[NAME]") == 3
    assert [x["kind"] for x in out[1]["found"]].count("name_part") == 2
    # without a full name nothing bears it out
    assert out[2]["masked"] == alone
    assert {tuple(r) for r in pii.found_rows(df, model).collect()} == {(1, "name", "Paula Mormonte"), (1, "email", "paula.mormonte@mail.example")}
    # other letter case, accents and a genitive are the same token
    assert pii._stem(pii._fold("MORMONTÉ")) == pii._stem(pii._fold("Mormontes")) == "mormonte"


def test_words_around_a_place():
    assert pii._around("say Tel. 5", 9, 10)[:2] == ("tel.", " ")
    assert pii._around("x1abc 5", 6, 7)[:2] == ("x1abc", " ")
    assert pii._around("a ---- 5", 7, 8)[:2] == ("", "-- ")
    assert pii._around("5", 0, 1) == ("", "", "", "")
