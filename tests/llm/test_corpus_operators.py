"""Ranked search, recurring passages and the divergence audit against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pactlake.llm import divergence, lexical, phrases

LOWER = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
SCHEMA = "doc_id long, text string, lang string, source string"


# --- ranked search ---------------------------------------------------------


def plain_rank(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", LOWER(t))
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            score = 0
            for w in terms(text):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 12 * (75 + (25 * n * n_docs) // total)))
            if score > 0:
                scores.append((-score, d is not None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rank_against_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SMALL_RANGE", 3)  # so that ranges split down to few documents
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 200)
    random.seed(5)
    words = [f"w{int(random.paretovariate(0.7))}" for _ in range(4000)] + ["É", "ß9"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    docs = [(k, text(random.randint(0, 40))) for k in range(300)] + [(1000 + k, "w1 w2 W2-é") for k in range(60)]  # ties beyond the 20
    items = [(k, text(random.randint(1, 12))) for k in range(25)] + [(90, "w2 w2 é"), (91, None), (92, ""), (93, "nowhere")]
    got = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert told(got) == sorted(plain_rank(docs, items), key=repr)


def test_treap_order():
    random.seed(6)
    impacts = [random.randint(0, 9) for _ in range(200)]
    t = lexical.Treap(list(range(0, 400, 2)), impacts)
    for k in range(200):
        for child in (t.left[k], t.right[k]):
            assert child < 0 or impacts[child] <= impacts[k]
        assert (t.left[k] < 0 or t.left[k] < k) and (t.right[k] < 0 or t.right[k] > k)
    for low, high in ((0, 400), (7, 31), (398, 400), (1, 2)):
        inside = [x for d, x in zip(t.docs, impacts, strict=True) if low <= d < high]
        top = t.top(t.root, low, high)
        assert (top < 0) == (not inside) and (top < 0 or impacts[top] == max(inside))


def test_rank_of_odd_and_empty_tables(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "quick fox"), (1, "quick fox"), (None, "one"), (2, None)], "item_id long, text string")
    got = lexical.rank(odd, items).collect()
    plain = plain_rank([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "quick fox"), (None, "one")])
    assert sorted(map(tuple, got), key=repr) == sorted(plain, key=repr)
    assert lexical.rank(none, items).count() == 0 and lexical.rank(odd, items.limit(0)).count() == 0
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 8)  # a block an item
    assert sorted(map(tuple, lexical.rank(odd, items).collect()), key=repr) == sorted(plain, key=repr)


def test_rank_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z"), ("d", "z")], "id string, body string")
    got = lexical.rank(docs, spark.createDataFrame([("q", "x")], "item_id string, text string"), doc_id="id", text="body").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [("q", 1, "a"), ("q", 2, "b")]


# --- recurring passages ----------------------------------------------------


def plain_kept(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    times = Counter(tuple(ws[k : k + window]) for ws in split for k in range(len(ws) - window + 1))
    out = []
    for ws in split:
        gone = {p for k in range(len(ws) - window + 1) if times[tuple(ws[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return out


def corpus(seed, docs=120):
    random.seed(seed)
    word = lambda: f"v{random.randint(0, 5000)}"
    shared = [[word() for _ in range(random.choice((12, 34, 35, 36, 60, 200)))] for _ in range(12)]
    texts = []
    for _ in range(docs):
        ws = []
        for _ in range(random.randint(0, 6)):
            ws += [word() for _ in range(random.randint(0, 30))]
            p = random.choice(shared)
            a = random.randint(0, len(p) // 3)
            ws += p[a : len(p) - random.randint(0, len(p) // 3)] if random.random() < 0.5 else p
        texts.append(random.choice((" ", "\n", " \t ")).join(ws))
    loop = [word() for _ in range(7)]
    return texts + [texts[0], texts[0], "a " * 80, "a " * 35, "a " * 34, " ".join(loop * 12), None, ""]


@pytest.mark.parametrize(("hot", "bits", "words"), [(256, 1 << 28, 1 << 18), (3, 1 << 28, 50), (3, 1 << 12, 400), (1, 1 << 12, 1)])
def test_passages_against_plain_windows(spark, monkeypatch, hot, bits, words):
    """Whatever is hot, however full the bitmaps, however small the automata."""
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "AUTOMATON_WORDS", words)
    texts = corpus(hot + words)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in phrases.without_repeats(docs, ["doc_id"]).collect()}
    want = plain_kept(texts, 35)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(n for _, n, _ in want) > 1000


@pytest.mark.parametrize("window", [1, 3, 10, 12])
def test_other_windows(spark, window):
    texts = ["a b c d e f g h i j k l m", "x c d e f g h i j k l y", "a a a", "b", "q r", "q r"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in phrases.without_repeats(docs, ["doc_id"], window=window).collect()}
    assert [got[k] for k in range(len(texts))] == plain_kept(texts, window)


def test_passages_of_odd_and_empty_tables(spark, odd, none):
    more = odd.withColumns({c: F.lit(7) for c in ("k1", "spans", "__k1", "__spans", "n_words", "kept", "__whole", "__text__")})
    got = phrases.without_repeats(more, more.columns)
    rows = got.collect()
    want = Counter(plain_kept([r["text"] for r in odd.collect()], 35))
    assert Counter((r["n_words"], r["n_removed"], r["kept"]) for r in rows) == want
    assert all(r["k1"] == 7 and r["__spans"] == 7 for r in rows)
    assert phrases.without_repeats(none, ["doc_id"]).count() == 0


def test_runs_of_codes():
    import numpy as np

    x = np.arange(100, dtype=np.uint64)
    for k in (1, 2, 3, 10, 35, 100):
        assert len(phrases.runs(x, k)) == 101 - k
        y = np.concatenate([x[50:], x, x])
        found = phrases.runs(y, k)
        assert (found[50 : 150 - k + 1] == phrases.runs(x, k)).all() and len(set(phrases.runs(x, k).tolist())) == 101 - k


def test_codes_of_words(monkeypatch):
    text = "é bb bb\tccc\n é x " + "y" * 100 + " bb"
    words = phrases.Words([text.encode(), b" ", None, b"bb q"])
    codes = words.codes()
    assert words.joined == (" ".join(text.split()) + " bb q").encode() and words.text_starts.tolist() == [0, 8, 8, 8, 10]
    assert [words.joined[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)] == [*text.split(), "bb", "q"]
    assert len(set(codes.tolist())) == 6 and codes[0] == codes[4] and codes[1] == codes[2] == codes[7] == codes[8]
    assert words.windows(2).tolist() == [0, 1, 2, 3, 4, 5, 6, 8] and words.windows(3).tolist() == [0, 1, 2, 3, 4, 5] and words.windows(9).tolist() == []
    monkeypatch.setattr(phrases, "BLOCK", 8)
    assert (phrases.Words([text.encode(), b" ", None, b"bb q"]).codes() == codes).all()
    assert phrases.Words([None, b" \n"]).n == len(phrases.Words([b""]).codes()) == 0


# --- divergence ------------------------------------------------------------


def plain_audit(rows, least=10, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", LOWER(t))
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        own = terms(text)
        count[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
        groups[lang or ""].add(source or "")
    out = []
    f = lambda p, q: ((p - q) * (p - q)) // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        if not kept:
            shares = {s: {} for s in sources}
            own = {}
        else:
            total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
            share = lambda n, of: 1 + (1000000000 * (n + 2)) // (of + 2 * len(kept))  # noqa: B023, E731
            shares = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
            own = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)]
            best = sorted((-f(shares[s][t], own[t]), t.encode(), t) for t in kept if count[lang, s][t] and shares[s][t] > own[t])
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(best[:top], 1)]
    return out


@pytest.mark.parametrize(("batch", "merge", "shard"), [(1 << 20, 1 << 19, 1 << 17), (50, 40, 10)])
def test_audit_against_plain_counts(spark, monkeypatch, batch, merge, shard):
    monkeypatch.setattr(divergence, "BATCH_BYTES", batch)
    monkeypatch.setattr(divergence, "MERGE_ROWS", merge)
    monkeypatch.setattr(divergence, "SHARD_ROWS", shard)
    random.seed(9)
    word = lambda: random.choice("ábcdefgh") + random.choice(("", "x", "É", "ß", "yy"))
    rows = [(" ".join(word() for _ in range(random.randint(0, 25))), random.choice(("de", "fr", None)), random.choice(("s1", "s2", "S3", "é", None))) for _ in range(250)]
    rows += [(None, "de", "none"), ("", "xx", "a"), ("rare", "xx", "b"), ("rare", "yy", None)] + [("The the 3the_x",  "zz", "only")] * 12
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    assert told(divergence.audit(docs)) == sorted(plain_audit(rows), key=repr)


def test_audit_of_odd_and_empty_tables(spark, odd, none):
    docs = odd.withColumn("term", F.lit(1)).withColumn("n", F.lit(2)).withColumn("size", F.lit(2))
    want = plain_audit([(r["text"], r["lang"], r["source"]) for r in odd.collect()], least=1)
    assert told(divergence.audit(docs, least_documents=1)) == sorted(want, key=repr)
    assert divergence.audit(none).count() == 0
