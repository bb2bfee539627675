"""Encoding, decontamination, fingerprints, personal data and shards against plain versions."""

import hashlib
import functools
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from pactlake.llm import bpe, decontaminate, graph, pii, sharding, simhash

LOWER = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


# --- encoding --------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library(tokenizer):
    own = bpe.ForcedBoundaryBPE(open(bpe.default_tokenizer(), encoding="utf-8").read())
    random.seed(1)
    letters = "abcdeféèßÄ '\"!.$%0123\n\t\x1c\x85Σ中́\U0001f600<|>"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|> a<|startoftext|>b <|x", "a" * 3000, "İstanbul ΑΣ", "don't I'D", "xyz" * 500 + "!" * 300]
    for t in texts:
        e = tokenizer.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids
        assert own.decode(e.ids) == tokenizer.decode(e.ids, skip_special_tokens=False)


def test_letters_of_newer_unicode_versions(tokenizer):
    own = bpe.ForcedBoundaryBPE(open(bpe.default_tokenizer(), encoding="utf-8").read())
    random.seed(2)
    letters = "aB .,\u1c89\ua7cb\ua7da\U00010d50\u03a3\u03c2\u0301\u0307\u0130\u1e9e\u212a\u2126\u2001\u2028\u1100\u1161\u13a0\x1f"
    for _ in range(3000):
        t = "".join(random.choice(letters) for _ in range(random.randint(0, 12)))
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False), ascii(t)


def test_cuts_only_where_no_token_has_the_pair():
    own = bpe.ForcedBoundaryBPE(open(bpe.default_tokenizer(), encoding="utf-8").read())
    for word in ("qzxjkvbw", "hello", "zqzqzq"):
        pieces = own.cut(word)
        assert "".join(pieces) == word
        cuts = list(itertools.accumulate(map(len, pieces)))[:-1]
        assert all((word[k - 1 : k + 1] not in own.inside) == (k in cuts) for k in range(1, len(word)))


def test_the_memory_of_words_is_bounded_and_harmless(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    own = bpe.ForcedBoundaryBPE(open(bpe.default_tokenizer(), encoding="utf-8").read())
    text = " ".join(f"word{k % 17}x" for k in range(300))
    assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert max(map(len, (own.memo, own.old_memo, own.fragments, own.old_fragments))) <= 5


def test_encoding_odd_rows(spark, odd, none, tokenizer):
    rows = bpe.digests(odd).collect()
    assert len(rows) == odd.count() and bpe.digests(none).count() == 0
    for r, d in zip(rows, odd.collect(), strict=True):
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"]) == (d["doc_id"], len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, keep=["doc_id"])).collect()
    assert back[0]["decoded"] == "the</w> quick</w> brown</w> fox</w>"


# --- decontamination -------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, size=10):
    patterns = {}
    for i, t in items:
        w = WORDS.findall(LOWER(t or ""))
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add("" if i is None else str(i))
    out = []
    for _, t in docs:
        w, hit, found = WORDS.findall(LOWER(t or "")), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in patterns:
                    hit |= set(range(k, k + m))
                    found |= patterns[tuple(w[k : k + m])]
        out.append((len(w), sorted(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    random.seed(2)
    vocabulary = ["a", "b", "c", "É", "Zz", "x1"]
    some = lambda n: random.choice([" ", "-", ", "]).join(random.choice(vocabulary) for _ in range(n))
    items = [(k, some(random.choice([1, 2, 3, 5, 9, 10, 12, 14]))) for k in range(12)] + [(3, some(11)), (None, some(4)), (50, None), (51, "..."), (52, "")]
    docs = [(k, some(random.randint(0, 60))) for k in range(40)] + [(90, None), (91, "")]
    docs += [(92 + k, f"start {t} end") for k, (_, t) in enumerate(items) if t]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["n_words"], r["hits"], r["items"]) for r in decontaminate.scan(d, b, ["doc_id"]).orderBy("doc_id").collect()]
    assert got == brute_hits(sorted(docs), items)


def test_decontamination_without_items(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["hits"] for r in decontaminate.scan(odd, empty, ["doc_id"]).collect())
    assert decontaminate.scan(none, empty, ["doc_id"]).count() == 0


def test_a_clean_text_is_mostly_skipped():
    machine = decontaminate.searchers([("1", " ".join(f"w{k}" for k in range(40)).encode())])[0]
    looked = 0

    class Counting(list):
        def __getitem__(self, k):
            nonlocal looked
            looked += isinstance(k, int)
            return super().__getitem__(k)

    machine.find(Counting([b"other"] * 900), lambda *_: None)
    assert looked <= 2 * 900 / 9 + 4


# --- fingerprints ----------------------------------------------------------


def plain_fingerprint(text, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", LOWER(text or ""))
    s = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(values, linked):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def test_fingerprints(odd):
    for r in odd.collect():
        assert simhash.fingerprint(r["text"].encode() if r["text"] is not None else None) == plain_fingerprint(r["text"])
    assert simhash.fingerprint("A b C d".encode()) == plain_fingerprint("a B c D")


def close_values(n, seed=3, centres=30, flips=5):
    rng = np.random.default_rng(seed)
    base, out = rng.integers(0, 2**63, centres).astype(np.uint64), set()
    while len(out) < n:
        v = int(base[rng.integers(centres)])
        for k in rng.integers(0, 64, rng.integers(0, flips)):
            v ^= 1 << int(k)
        out.add(v)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bk_trees_find_all_and_only_links(radius):
    values = close_values(600)
    tree = simhash.BKTree(values)
    found = {(n, k) for nodes, asked in tree.within(values, radius, 100) for n, k in zip(nodes.tolist(), asked.tolist(), strict=True)}
    want = {(a, int(b)) for a in range(len(values)) for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= radius)}
    assert found == want
    assert sorted(tree.child.tolist()) == list(range(1, len(values)))  # each but the root is a child once
    assert len(set(tree.edge.tolist())) == len(tree.edge)
    for edge, child in zip(tree.edge.tolist(), tree.child.tolist(), strict=True):
        assert (int(values[edge // 65]) ^ int(values[child])).bit_count() == edge % 65


@pytest.mark.parametrize("shards", [(1024, 8192), (64, 20), (4096, 100)])
def test_links_connect_what_is_within_the_radius(spark, monkeypatch, shards):
    for name, value in zip(("SHARD", "SHARD_MAX"), shards, strict=True):
        monkeypatch.setattr(simhash, name, value)
    values = close_values(1500)
    signed = values.view(np.int64).tolist()
    pairs = [(signed[a], signed[int(b)]) for a in range(len(values)) for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= 2) + a + 1]
    want = plain_components(signed, pairs)
    df = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    got = {r["node"]: r["component"] for r in graph.components(simhash.links(df, 2)).collect()}
    linked = {v for p in pairs for v in p}
    assert set(got) == linked
    groups = lambda of: {frozenset(v for v in linked if of[v] == c) for c in {of[v] for v in linked}}
    assert groups(got) == groups(want)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(none).count() == 0
    assert got[(2, 0)] == got[(3, 0)] == got[(4, 0)] == 2 and got[(None, 0)] == 2
    assert {c for (i, _), c in got.items() if i in (5, 6)} == {5}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 7, 8]


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3), (7, None)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    want = plain_components({v for e in real for v in e}, real)
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- personal data ---------------------------------------------------------


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    random.seed(5)
    for _ in range(20_000):
        t = "".join(random.choice("ab1234567890.. -@@+()é%") for _ in range(random.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("4785380592391139 x", "a@b.c, +1 (743) 555-3824", "256.1.1.1 1.2.3.4.5.6.7.8", "0000255.1.1.1", "x" * 50_000 + "@y.z", "1" * 50_000):
        assert pii.base_spans(t) == plain_spans(t) if len(t) < 1000 else pii.base_spans(t) is not None


def disclosing(spark):
    rows = [(i, f"alpha{'xyzw'[i % 4] * 3} Zorblatt writes w{'abcdefgh'[i % 8] * 5} zorb@x.com nice q{'klmnop'[i % 6] * 4} and Zorblatt") for i in range(8)]
    rows += [(100 + i, f"some other {'zoroaster ' * (i % 3 == 0)}text about nice things and writes " + "hello " * i) for i in range(60)]
    rows += [(200 + i, "copied words around other@y.org are always these same words") for i in range(9)]
    rows += [(250, "lonely Marvolo asks marv@z.org about things Marvolo"), (251, "Marvolo again, far from any entity"), (252, "1.2.3.4 nice +1 234 567 8901 hello")]
    rows += [(253, "seldom one@z.org seldom"), (254, "seldom one@z.org seldom")]
    rows += [(260 + i, f"Li 王小明 X9Q77 {w} li@h.cn") for i, w in enumerate(("red", "green", "blue"))]
    return spark.createDataFrame([*rows, (None, None), (300, "")], "doc_id long, text string")


def plain_terms(text):
    """(start, end, term): runs of letters and digits; Han by twos."""
    han = r"[\u4e00-\u9fff]"
    out = [m.span() for m in re.finditer(rf"(?:(?!{han})[^\W_])+|(?<!{han}){han}(?!{han})", text)]
    out += [(m.start(), m.start() + 2) for m in re.finditer(rf"(?={han}{han})", text)]
    return [(a, b, text[a:b].lower()) for a, b in sorted(out)]


def plain_near(texts):
    """Documents by (entity, term near it), and by entity."""
    near, holds = {}, {}
    for d, t in enumerate(texts):
        spans = plain_spans(t or "")
        words = [w for w in plain_terms(t or "") if all(w[1] <= a or w[0] >= b for _, a, b in spans)]
        for k, a, b in spans:
            e = pii.entity(k, t[a:b])
            holds.setdefault(e, set()).add(d)
            for w in [w for w in words if w[1] <= a][-pii.WINDOW :] + [w for w in words if w[0] >= b][: pii.WINDOW]:
                near.setdefault((e, w[2]), set()).add(d)
    return near, holds


def plain_shares(texts):
    """(entity, term) of SUPPORT mentions or more in different texts, documents with it, share, and the lengths of safe beginnings."""
    near, holds = plain_near(texts)
    n, everywhere = len(texts), {}
    for d, t in enumerate(texts):
        for *_, w in plain_terms(t or ""):
            everywhere.setdefault(w, set()).add(d)
    most = {}
    for w, ds in everywhere.items():
        for k in range(1, 17):
            most[w[:k]] = max(most.get(w[:k], 0), len(ds))
    by_entity = {}
    for (e, t), ds in near.items():
        by_entity.setdefault(e, []).append((t, ds))
    bits = lambda e, ds, n_t: np.log2(len(ds) * n / (len(holds[e]) * n_t)) / np.log2(n / len(holds[e])) if len(holds[e]) < n else 0.0
    free = lambda x: [w[2] for w in plain_terms(x) if all(w[1] <= a or w[0] >= b for _, a, b in plain_spans(x))]
    mentions, shares, safe = functools.cache(free), {}, {}
    for (e, t), ds in near.items():
        if sum(mentions(x).count(t) for x in {texts[d] for d in ds}) >= pii.SUPPORT:
            shares[e, t] = bits(e, ds, len(everywhere[t]))
            begins = [(k, set().union(*[x for w, x in by_entity[e] if w.startswith(t[:k])])) for k in range(1, min(len(t) - 1, 16) + 1)]
            safe[e, t] = {k for k, x in begins if bits(e, x, most[t[:k]]) < pii.DISCLOSES}
    return near, shares, safe


def plain_spans_and_terms(texts):
    """All spans of every text, with share and what a term is generalised to."""
    near, shares, safe = plain_shares(texts)
    strong = [k for k, v in shares.items() if v >= pii.DISCLOSES]
    out = []
    for d, text in enumerate(texts):
        text = text or ""
        base, own = plain_spans(text), {}
        spans = [(*s, None, None) for s in base]
        for e, t in strong:
            if d in near[e, t]:
                own.setdefault(t, []).append((shares[e, t], safe[e, t]))
        for a, b, w in plain_terms(text):
            if w in own and all(b <= x or a >= y for _, x, y in base):
                lengths = set.intersection(*[x for _, x in own[w]])
                spans.append(("term", a, b, max(x for x, _ in own[w]), f"{w[: max(lengths)]}*" if lengths else None))
        out.append(sorted(spans, key=lambda s: (s[1], pii.ALL_KINDS.index(s[0]), s[2])))
    return out


@pytest.mark.parametrize("limits", [(200_000, 32 << 20), (3, 0)])
def test_terms_equal_a_plain_count(spark, monkeypatch, limits):
    monkeypatch.setattr(pii, "COUNTED_TERMS", limits[0])
    monkeypatch.setattr(pii, "BROADCAST_BYTES", limits[1])
    df = disclosing(spark)
    rows = df.collect()
    texts = [r["text"] for r in rows]
    _, shares, safe = plain_shares(texts)
    want = {k: (v, sum(1 << n for n in safe[k])) for k, v in shares.items() if v >= pii.DISCLOSES}
    got = {(r["e"], r["t"]): (r["share"], r["safe"]) for r in pii.disclosing_terms(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)
    assert ("email:zorb@x.com", "zorblatt") in got and ("email:zorb@x.com", "nice") not in got
    # mentioned twice, and elsewhere too; mentioned twice in one text, and in a copy; mentioned once
    assert ("email:marv@z.org", "marvolo") not in got and ("email:one@z.org", "seldom") in got and ("email:marv@z.org", "lonely") not in got
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df, ["doc_id"]).collect()}
    for r, spans in zip(rows, plain_spans_and_terms(texts), strict=True):
        assert found[r["doc_id"]] == [(*s[:3], s[3] and pytest.approx(s[3]), s[4]) for s in spans]
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert "Zorblatt" not in clean[0] and "zor* writes" in clean[0] and "[EMAIL]" in clean[0] and clean[251] == "Marvolo again, far from any entity"
    assert "Li" not in clean[260].split() and "王小" not in clean[260] and "X9Q77" not in clean[260]
    assert clean[None] is None and clean[300] == "" and clean[159].startswith("some other")


def test_long_logs_take_linear_time():
    import time

    random.seed(1)
    text = " ".join(f"host {random.randrange(256)}.{random.randrange(256)}.1.7 fetched page number {k}" for k in range(20_000))
    began = time.perf_counter()
    spans = pii.base_spans(text)
    pii._evidence(text, spans)
    pii._term_spans(text, {"fetched": (1.0, 0)}, spans)
    assert len(spans) == 20_000 and time.perf_counter() - began < 6


def test_spans_of_odd_rows(spark, odd, none):
    found = pii.find(odd, ["doc_id"]).collect()
    assert len(found) == odd.count() and all(r["spans"] == [] for r in found if r["doc_id"] in (1, 2, 3, 4))
    assert pii.find(none, ["doc_id"]).count() == 0
    assert pii.redacted(odd).columns == odd.columns


def test_redaction_joins_overlaps():
    assert pii.redact("call +1 234 567 8901 23 now", [("phone", 5, 23, None, None), ("card", 6, 23, None, None)]) == "call [PHONE] now"


# --- shards ----------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 41, 1000])
def test_shards_are_a_permutation(spark, n):
    got = sharding.shard(spark.createDataFrame([(k, f"t{k % 7}") for k in range(n)], "doc_id long, text string"), shards=3).collect()
    assert sorted(3 * r["slot"] + r["shard"] for r in got) == list(range(n))
    assert sorted(r["row_number"] for r in got) == list(range(n))


def test_shards_are_reproducible_and_whole(spark, odd, none):
    import zlib

    key = lambda df: sorted((str(r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in sharding.shard(df, 4).collect())
    assert key(odd) == key(odd.repartition(7).orderBy("score")) and len(key(odd)) == odd.count()
    assert sharding.shard(none).count() == 0
    for r in sharding.shard(odd, 4).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None


def test_a_row_that_is_repeated_often_is_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 10)
    df = spark.createDataFrame([(1, "same")] * 2345 + [(None, None)] * 37 + [(k, "x") for k in range(30)], "doc_id long, text string")
    got = sharding.shard(df, shards=7).collect()
    assert sorted(7 * r["slot"] + r["shard"] for r in got) == list(range(2412)) and sum(r["doc_id"] == 1 for r in got) == 2346


def test_the_permutation_walks_back_into_range(spark):
    from pyspark.sql import functions as F

    for n in (5, 50, 99_999):
        base = sharding._base(n)
        walk = sharding.walk_length(spark, n, base, 1)
        places = spark.range(n).select(sharding.permute(F.col("id"), n, base, 1, walk).alias("p"))
        assert places.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first() == (n, 0, n - 1)
        assert base * base - n <= 2 * n**0.5 + 2
