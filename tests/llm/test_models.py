"""Classifiers and automata: held-out accuracy, and the parts against plain versions."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactlake.llm import langid, quality, toxicity

GOOD = "the river runs past old houses where people talk about weather bread and boats in quiet evening light".split()


def corpus(spark, n=240, seed=0):
    """Documents with labels: low quality shouts and repeats; toxic texts hold a term, clean ones quote none."""
    random.seed(seed)
    docs, labels = [], []
    for k in range(n):
        words = [random.choice(GOOD) + random.choice(["", "", "s", "ed"]) for _ in range(random.randint(20, 60))]
        low, toxic = k % 3 == 0, k % 4 == 1
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["gronkhead", "sludgebrain", "vexoid"]))
        text = " ".join(w.upper() + "!!" if low else w for w in words)
        docs.append((k, text, "en"))
        labels.append((k, int(not low), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


# --- quality ---------------------------------------------------------------


def test_quality_of_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["quality"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_indicators_are_the_ngrams_present():
    of = quality.Indicators()
    a, b, c = of(b"abcab"), of(b"abcababcab"), of(b"")
    assert len(c) == 0 and set(of(b"ab")) <= set(a)
    assert set(a) <= set(b) and len(of(b"x")) == 1
    once, twice = 1 << quality.BITS, (1 << quality.BITS) + 1
    assert once in of(b"go go") and twice not in of(b"go go") and {once, twice} <= set(of(b"go go go").tolist())
    assert (of(b"abcab") == a).all()


def test_log_count_ratio_and_dual_descent(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 300)
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    y = np.array([1, 1, 0, 0])
    ratio = quality.log_count_ratio(rows, y)
    total = 4 + quality.SIZE
    assert ratio[0] == pytest.approx(np.log((3 / total) / (1 / total))) and ratio[0] == -ratio[3] and ratio[1] == ratio[2] == 0
    w = quality.descend(rows, np.ones(4), y, np.ones(4))
    x = np.zeros((4, 5))
    for k, r in enumerate(rows):
        x[k, r] = 1
        x[k, 4] = 1
    loss = lambda v: 0.5 * v @ v + np.square(np.maximum(0, 1 - (2 * y - 1) * (x @ v))).sum()
    rng = np.random.default_rng(0)
    assert all(loss(w) <= loss(w + 0.02 * rng.standard_normal(5)) for _ in range(300))


def test_places_are_packed_without_loss():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500, 9000, 200_000):
        places = np.sort(rng.choice(quality.SIZE, n, replace=False))
        assert (quality.unpack(quality.pack(places)) == places).all() and len(quality.pack(places)) <= quality.SIZE // 8 + 2


def test_the_sample_is_the_first_rows_by_their_hash(spark):
    rows = [(quality.pack(np.array([k % 7, 9])), k % 2) for k in range(40)] + [(quality.pack(np.array([], np.int64)), 1)]
    sets = spark.createDataFrame(rows, "places binary, y int")
    plain = [(quality.unpack(bytes(r["places"])).tolist(), r["y"]) for r in sets.orderBy(F.xxhash64("places"), "places", "y").collect()]
    for most in (1, 2, 17, 41, 100):
        places, y = quality.sample(sets, most)
        assert [(places[k].tolist(), c) for k, c in enumerate(y.tolist())] == plain[:most] and len(places) == len(y)
    places, y = quality.sample(sets, 41)
    assert [x.tolist() for x in map(places.take(np.array([40, 3])).__getitem__, range(2))] == [plain[40][0], plain[3][0]]
    assert [len(x) for x in quality.sample(sets.limit(0), 5)] == [0, 0]


def test_the_driver_never_holds_the_whole_sample(spark, monkeypatch):
    texts = F.expr("concat_ws('', transform(sequence(0, 149), k -> sha2(concat_ws(' ', doc_id, k), 256)))")
    docs = spark.range(900).withColumnRenamed("id", "doc_id").withColumn("text", texts)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "fit", lambda rows, y, totals: rows)
    tracemalloc.start()
    try:
        rows = quality.train(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    whole = sum(len(quality.pack(rows[k])) for k in range(len(rows)))
    assert len(rows) > 500 and whole > 16e6 and most < whole / 2


def test_labels_of_one_class_or_none(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(k, 1, 1) for k in range(9)] + [(None, 0, 0), (5, None, None), (6, 7, 7)], "doc_id long, quality int, toxic int")
    assert quality.train(odd, empty) == 0.5 and quality.train(odd, one) == 1.0
    assert toxicity.train(odd, empty) == 0.5 and toxicity.train(odd, one) == 1.0
    assert [r["score"] for r in quality.score(odd, 0.5, ["doc_id"]).collect()] == [0.5] * odd.count()


def test_scores_of_odd_rows(spark, odd, none):
    docs, labels = corpus(spark)
    q, t = quality.train(docs, labels), toxicity.train(docs, labels)
    for module, model in ((quality, q), (toxicity, t)):
        rows = module.score(odd, model, ["doc_id", "score"]).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert rows[2]["score"] == rows[3]["score"] and rows[0]["score"] == rows[1]["score"]
        assert module.score(none, model, ["doc_id"]).count() == 0


# --- toxicity --------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automata_equal_the_edit_distance():
    random.seed(7)
    terms = [("abcab", False, 1), ("bacbacca", False, 2), ("cab", False, 0), ("abba", True, 0), ("ccabb", True, 1)]
    trie = toxicity.FuzzyTrie(terms)
    words = ["".join(p) for n in range(1, 6) for p in itertools.product("abc", repeat=n)]
    words += ["".join(random.choice("abcd") for _ in range(random.randint(5, 12))) for _ in range(3000)]
    for w in words:
        best = 9
        for term, stem, k in terms:
            d = min((distance(w[:n], term) for n in range(len(w) + 1)), default=9) if stem else distance(w, term)
            if d <= k:
                best = min(best, d)
        assert trie.match(w) == (best if best < 9 else -1), w


def test_the_automaton_starts_anew_beyond_its_bound(monkeypatch):
    trie = toxicity.FuzzyTrie([("worthless", False, 2)])
    monkeypatch.setattr(toxicity, "MAX_STATES", 3)
    assert [trie.match(w) for w in ("worthless", "wrthless", "wothles", "worth")] == [0, 1, 2, -1]


def test_toxic_held_out_rows_and_misspelled_terms(spark):
    docs, labels = corpus(spark, 400)
    model = toxicity.train(docs, labels)
    assert {t for t, _, _ in model.lexicon.terms} & {"gronkhead", "gron", "gronkh", "gronk"}
    rows = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == r["toxic"] for r in rows]) > 0.98
    lexicon = toxicity.Lexicon([("gronkhead", False, 2)])
    model = toxicity.Model(lexicon, toxicity.PRIOR)
    score = lambda s: model.score(toxicity.features(s.encode(), lexicon))
    assert score("you gronkhead are a gronkhed and a gr0nkhead") > 0.5 > score("you read and walked past the boats")
    assert score('they wrote "gronkhead" and "gronkhead" and “gronkhead” in the report') < 0.5


def test_long_words_are_no_terms_by_their_beginning():
    lexicon = toxicity.Lexicon([("pneumonoultramicroscopicsilicovolcanocon", False, 2)])
    assert lexicon.match("pneumonoultramicroscopicsilicovolcanocon") == 0 and lexicon.match("pneumonoultramicroscopicsilicovolcanoconiosislikethings") == -1


def test_a_term_that_clean_words_resemble_matches_exactly_only(spark):
    rows = [(1, f"gronkhead {k} trench {k}") for k in range(8)] + [(0, f"french bread {k} gronkhed" if k == 1 else f"french bread {k}") for k in range(20)]
    lexicon = toxicity.settle(spark.createDataFrame(rows, "y int, text string"), toxicity.Lexicon([("gronkhead", False, 2), ("trench", False, 1)]))
    assert lexicon.terms == [("gronkhead", False, 2), ("trench", False, 0)] and lexicon.harmless == {"french", "gronkhed"}
    assert lexicon.match("gronkhad") == 1 and lexicon.match("french") == -1 and lexicon.match("trench") == 0


def test_context_tells_quotation():
    lexicon = toxicity.Lexicon([("gronkhead", False, 2)])
    plain, quoted, cue = (toxicity.features(s.encode(), lexicon) for s in ("a gronkhead here", 'a "gronkhead" here', "the word gronkhead here"))
    assert plain[0] > 0 and plain[4] == 0 and quoted[0] == 0 and quoted[4] > 0 and cue[4] > 0


def test_copies_teach_no_terms(spark):
    rows = [(1, f"copied words flimflam gribble number {k} again gronkhead") for k in range(12)]
    random.seed(3)
    rows += [(1, " ".join(random.sample(GOOD, 8)) + " gronkhead") for _ in range(12)] + [(0, " ".join(random.sample(GOOD, 9))) for _ in range(40)]
    terms = {t for t, _, _ in toxicity.learn_lexicon(spark.createDataFrame(rows, "y int, text string")).terms}
    assert any("gronkhead".startswith(t) for t in terms) and not terms & {"flimflam", "gribble"}


# --- language --------------------------------------------------------------

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ung", "ei", "tz"], "cc": ["éa", "oui", "çon", "ê"]}


def languages(spark, n=180):
    random.seed(1)
    rows = []
    for k in range(n):
        lang = list(SYLLABLES)[k % 3]
        rows.append((k, " ".join("".join(random.choice(SYLLABLES[lang]) for _ in range(random.randint(1, 4))) for _ in range(random.randint(3, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_rows(spark):
    docs = languages(spark)
    model = langid.train(docs)
    rows = langid.identify(docs, model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("doc_id", [3, 4, 77_777, 12_345])
def test_copies_of_one_text_lose_no_language(spark, doc_id):
    rows = [(k, f"the river runs past {k} old houses", "en") for k in range(400)] + [(doc_id, "der fluss läuft an den häusern vorbei", "de")] * 900
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en"]


def test_every_language_is_learned_however_many(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_ROWS", 50)
    monkeypatch.setattr(langid, "LANDMARKS", 10)
    rows = [(4 * k + j, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 2} some words {j}", f"l{k}") for k in range(60) for j in range(4)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 60
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 10)
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_the_folded_scores_are_those_of_the_kernel():
    of = langid.Spectrum()
    rows = [of(t.encode()) for t in ("kalomi", "schung ei", "lokane mi", "tzei ung")]
    model = langid.fit(rows, ["aa", "bb", "aa", "bb"])
    k = langid.dense(rows) @ langid.dense(rows).T
    for i, j in itertools.combinations(range(4), 2):
        both = len(set(rows[i].tolist()) & set(rows[j].tolist()))
        assert k[i, j] == pytest.approx(both / np.sqrt(len(rows[i]) * len(rows[j])), rel=1e-5)
    assert model.scores(rows).argmax(axis=1).tolist() == [0, 1, 0, 1]


def test_the_model_is_exact_kernel_ridge_when_all_rows_are_landmarks():
    of = langid.Spectrum()
    rng = np.random.default_rng(3)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "efghi"}
    names = [n for n in alphabets for _ in range(15)]
    rows = [of("".join(rng.choice(list(alphabets[n] + " "), 60)).encode()) for n in names]
    model = langid.fit(rows, names)
    held = [set(r.tolist()) for r in rows]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in held] for a in held])
    y = np.where(np.array(names)[:, None] == np.array(model.languages), 1.0, -1.0)
    # ridge in the dual with a free constant; every row weighs 1 / (15 * 3)
    n, ridge = len(rows), langid.RIDGE / 3 * 45
    dual = np.linalg.solve(np.block([[k + ridge * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]]), np.vstack([y, np.zeros((1, 3))]))
    raw = langid.SHARPNESS * (k @ dual[:-1] + dual[-1])
    want = np.exp(raw - raw.max(1, keepdims=True))
    assert np.allclose(model.scores(rows), want / want.sum(1, keepdims=True), atol=2e-4)


@pytest.mark.parametrize("gathered", [1, 100, 5000])
def test_scores_by_blocks_are_the_same(monkeypatch, gathered):
    of = langid.Spectrum()
    rows = [of(x.encode()) for x in ("one two three", "eins zwei drei", "a", "four five six seven", "vier")]
    model = langid.fit(rows, ["en", "de", "en", "en", "de"])
    want = model.scores(rows)
    monkeypatch.setattr(langid, "GATHERED", gathered)
    monkeypatch.setattr(langid, "PLACES", 1 << 10)
    assert np.allclose(model.scores(rows), want, atol=1e-5)
    assert np.allclose(langid.fit(rows, ["en", "de", "en", "en", "de"]).weights, model.weights, atol=1e-5)


def test_texts_without_letters_and_odd_rows(spark, odd, none):
    model = langid.train(languages(spark))
    rows = langid.identify(odd, model, ["doc_id"]).collect()
    assert [r["lang_pred"] for r in rows][2:4] == ["und", "und"] and rows[6]["lang_pred"] == "und"
    assert langid.identify(spark.createDataFrame([(1, "123 -- !?")], "doc_id long, text string"), model, ["doc_id"]).first()["lang_pred"] == "und"
    assert langid.identify(none, model, ["doc_id"]).count() == 0
    assert langid.train(none) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None, ["doc_id"]).collect()} == {"und"}
