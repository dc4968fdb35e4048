from __future__ import annotations

import random

import numpy as np

from corpusmill.llm.abuse import BITS, hashed, labelled_texts, margins, plain, score_documents, sentence_frequencies, sentences, source_rates, train

RUDE = ["you {n} idiots can rot in hell", "shut up you filthy {n} scum", "what a stupid {n} moron, get lost"]
KIND = ["the {n} office opens at nine on monday", "please hand in the {n} form before friday", "the rule forbids calling {n} members idiots", "the library lends {n} books for two weeks", "interviews take place in the {n} hall"]


def corpus(n, seed, noise=0.0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.25
        lines = [rng.choice(KIND).format(n=rng.choice(["north", "south", "east", "west"])) + "." for _ in range(rng.randint(1, 6))]
        if bad:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(RUDE).format(n=rng.choice(["north", "south", "east", "west"])) + ".")
        out.append(("\n".join(lines), float(bad != (rng.random() < noise)), bad))
    return out


def test_held_out_accuracy_with_noisy_reviewers():
    model = train([(t, y) for t, y, _ in corpus(500, 1, noise=0.05)])
    held = corpus(400, 2)
    right = sum((model.score(t) > model.threshold) == bad for t, _, bad in held)
    assert right / len(held) > 0.95


def test_spelling_tricks_are_undone():
    assert plain("ＳＴＵＰＩＤ!!!!  1234") == "stupid!! 0"


def test_without_both_labels_nothing_is_abusive():
    model = train([("a b c", 0.0), (None, 1.0), ("  ", 1.0)])
    assert not model.score("anything") > model.threshold


def test_operator_and_rates(spark):
    rows = [(i, t, "s" if i % 2 else None) for i, (t, _, _) in enumerate(corpus(200, 3))] + [(900, None, "s"), (901, "", "s"), (902, "the library lends books. " * 5_000, "s"), (0, "dup", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(bad)) for i, (_, _, bad) in enumerate(corpus(200, 3))] + [(1, None), (None, 1), (5000, 1)], "doc_id long, abusive int")
    pairs = labelled_texts(df, labels)
    assert len(pairs) == 200
    model = train(pairs)
    scored = score_documents(df, model)
    flags = {r.doc_id: r.abusive for r in scored.collect()}
    assert flags[900] is False and flags[901] is False
    rates = {r.source: (r.n_documents, r.n_abusive) for r in source_rates(df, scored).collect()}
    assert set(rates) == {"s", None}
    assert score_documents(df.limit(0), model).count() == 0
    assert labelled_texts(df.limit(0), labels) == []


def test_sentence_frequencies(spark):
    df = spark.createDataFrame([("ab. ab. ab",), ("ab",), (None,), ("",)], "text string")
    counts, n = sentence_frequencies(df)
    assert n == 2
    # " ab " stands in "ab" and three times in "ab. ab. ab", one of them without the full stop.
    assert counts[hashed(["ab"])[0]].min() >= 2
    assert sentence_frequencies(df.limit(0))[1] == 0


def test_all_ngrams_of_every_sentence():
    many = ["abab", "x", "가나 다"]
    places, owners = hashed(many)
    for k, s in enumerate(many):
        grams = [f" {s} "[i : i + n] for n in range(1, 6) for i in range(len(s) + 2 - n + 1)]
        assert (owners == k).sum() == len(grams)
        # Equal n-grams have equal places, others mostly not; what stands beside a sentence does not matter.
        assert len(set(places[owners == k])) == len(set(grams))
        assert sorted(places[owners == k]) == sorted(hashed([s])[0])
    assert len(hashed([])[0]) == 0


def test_signs_between_letters():
    assert sentences("You id.iot. Bye") == ["you id.iot.", "you idiot.", "bye"]


def test_margins_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=1 << BITS)
    many = [s for t, _, _ in corpus(300, 9) for s in sentences(t)] * 20
    together = margins(many, weights, 0.5)
    assert len(many) > 8192 and np.allclose(together[:50], [margins([s], weights, 0.5)[0] for s in many[:50]]) and np.allclose(together[-50:], [margins([s], weights, 0.5)[0] for s in many[-50:]])


def test_rates_against_a_count(spark):
    documents = spark.createDataFrame([(i, f"s{i % 3}" if i % 7 else None) for i in range(50)], "doc_id long, source string")
    scored = spark.createDataFrame([(i, 0.0, i % 4 == 0) for i in range(50)], "doc_id long, score double, abusive boolean")
    for r in source_rates(documents, scored).collect():
        own = [i for i in range(50) if (f"s{i % 3}" if i % 7 else None) == r.source]
        hits = sum(i % 4 == 0 for i in own)
        assert (r.n_documents, r.n_abusive, r.rate) == (len(own), hits, round(hits / len(own), 6))


def test_hidden_words_are_spelt_out():
    assert plain("you i d i o t s there") == "you idiots there"
    assert plain("st@ck y0ur") == "stack your"
    assert plain("a b c") == "a b c"
