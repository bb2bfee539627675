"""The pipeline's near-duplicates against brute force over exact sets of shingles."""

import random

import pytest

import corpus_pipeline
from pactlake.llm import simhash
from tests.llm.test_text_operators import plain_components


def edited(seed=7):
    """Texts, each with copies of which a few words are changed, some chains of copies, and copies as they are."""
    random.seed(seed)
    word = lambda: f"w{random.randrange(3000)}"
    texts = []
    for k in range(40):
        own = [word() for _ in range(random.choice([3, 5, 6, 40, 120, 300]))]
        texts.append(own)
        for _ in range(random.choice([0, 1, 4, 12])):
            copy = list(own)
            for _ in range(random.choice([0, 1, 2, 4, 6])):
                copy[random.randrange(len(copy))] = word()
            texts.append(copy)
            own = copy if k % 2 else own
    random.shuffle(texts)
    return [" ".join(t) for t in texts]


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain_kept(texts):
    sets = [plain_set(t) for t in texts]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return {k for k, c in plain_components(list(range(len(texts))), near).items() if k == c}


@pytest.mark.parametrize("tile", [2_000_000, 400])
def test_the_stage_keeps_one_of_each_group_of_similar_texts(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_SHINGLES", tile)
    texts = edited()
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(plain_kept(texts))


def test_odd_rows(spark, odd, none):
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 7, 8]
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0
