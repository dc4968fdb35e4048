from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.leakage import COVERAGE, Automaton, Leaks, find_leaks, held_out, normalised, without_spans

WORDS = [f"{a}{b}" for a in ("bran", "cor", "dor", "el", "fen", "gar", "hal", "lor") for b in ("ter", "lin", "mos", "vek", "pad", "zun", "rik", "hob")]


def item(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEMS = [(i, item(i)) for i in range(20)]


def leaked(text):
    return [i for i, _, _ in Leaks(ITEMS).of(text)]


def test_whole_parts_and_changes():
    words = ITEMS[3][1].split()
    assert leaked(f"Before. {ITEMS[3][1]} After.") == [3]
    assert leaked(" ".join(words[:36])) == [3]
    assert leaked(" ".join(words[:20])) == []
    changed = [w if i % 7 else "other" for i, w in enumerate(words)]
    assert leaked(" ".join(changed)) == [3]
    stretches = f"{' '.join(words[:22])} something quite different in between {' '.join(words[30:50])}"
    assert leaked(stretches) == [3]


def test_own_order_counts():
    words = ITEMS[4][1].split()
    quarters = [" ".join(words[i : i + 12]) for i in range(0, 60, 12)]
    assert leaked(" ".join(quarters[::-1])) == []


def test_stretches_far_apart():
    words = ITEMS[8][1].split()
    filler = "Nothing of this kind is in any of them. " * 400
    assert leaked(f"{' '.join(words[:18])} {filler} {' '.join(words[30:48])}") == [8]
    assert leaked(f"{' '.join(words[:10])} {filler} {' '.join(words[20:30])} {filler} {' '.join(words[40:52])}") == [8]
    assert leaked(f"{' '.join(words[30:48])} {filler} {' '.join(words[:18])}") == []
    # Scattered words alone are coincidence.
    assert leaked(filler.join(words)) == []


def test_items_inside_longer_matches_of_others():
    words = item(100, 90).split()
    inner, outer, shared = " ".join(words[30:60]), " ".join(words), " ".join([*words[:25], *item(101, 20).split()])
    leaks = Leaks([(1, inner), (2, outer), (3, shared)])
    assert [i for i, _, _ in leaks.of(f"x {outer} y")] == [1, 2, 3]


def test_changes_every_dozen_letters():
    plain = normalised(ITEMS[9][1])[0]
    copy = "".join(c if i % 12 else "ß" for i, c in enumerate(plain))
    assert leaked(copy) == [9]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=12, max_size=60), min_size=1, max_size=5), st.text(alphabet="abc", max_size=80))
def test_no_item_that_a_chain_accepts_is_left_out(texts, text):
    leaks = Leaks(list(enumerate(texts)))
    every = [i for i, t in enumerate(texts) if leaks.covered(t, text)[0] >= COVERAGE * len(t)]
    assert [i for i, _, _ in leaks.of(text)] == every


def test_form_does_not_matter():
    words = ITEMS[5][1].split()
    assert leaked("<p>" + "</p>\n<p>".join(" ".join(words[i : i + 9]).upper() for i in range(0, 60, 9)) + "</p>") == [5]
    assert leaked("\n> ".join(" ".join(words[i : i + 4]) for i in range(0, 60, 4))) == [5]
    assert leaked("&nbsp;".join(words)) == [5]
    korean = [(1, "사나운 요리사가 갑판에서 허겁지겁 수레를 팔았다. 떠도는 철학자가 갑판에서 두꺼운 물레를 들여다보았다.")]
    import unicodedata

    assert [i for i, _, _ in Leaks(korean).of(unicodedata.normalize("NFD", korean[0][1]))] == [1]


def test_spans_can_be_removed():
    text = f"Keep this. {ITEMS[6][1]} Keep that."
    ((_, coverage, spans),) = Leaks(ITEMS).of(text)
    assert coverage == 1.0
    assert without_spans(text, spans).split() == "Keep this. Keep that.".split()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=12), min_size=1, max_size=4), st.text(alphabet="abcd", max_size=30))
def test_automaton_against_substring_search(texts, text):
    automaton = Automaton()
    for t in texts:
        automaton.add(t)
    expected = set()
    for end in range(1, len(text) + 1):
        size = max((end - s for s in range(end) if any(text[s:end] in t for t in texts)), default=0)
        more = end < len(text) and size and any(text[end - size : end + 1] in t for t in texts)
        if size and not more:
            expected.add((end - size, end))
    assert set(automaton.matches(text, 1)) == expected


def test_short_items_stand_as_a_whole():
    for size in range(1, 21):
        word = "".join(chr(97 + (7 * k + size) % 26) for k in range(size))
        leaks = Leaks([(1, word), (2, "quite another thing altogether")])
        assert [(i, c) for i, c, _ in leaks.of(f"It says: {word}, you see.")] == [(1, 1.0)], size
        assert leaks.of("Nothing of it.") == []
        if size < 12:
            assert leaks.of(f"It says: x{word}, you see.") == []
        else:
            assert [i for i, _, _ in leaks.of(f"It says: {word[: (size + 1) // 2]} you see.")] == ([1] if size // 2 >= 6 else [])
    assert [s for _, _, s in Leaks([(1, "ab cd")]).of("x AB-cd y ab cd")] == [[(2, 7), (10, 15)]]


def test_many_items_take_little_memory():
    import tracemalloc

    rng = random.Random(3)
    many = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=6)) for _ in range(11))) for i in range(20_000)]
    tracemalloc.start()
    leaks = Leaks(many)
    found = [i for i, _, _ in leaks.of(f"x {many[77][1]} y {many[19_999][1]}")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 1.3 million characters of items; 100,000 items of this size take five times as much.
    assert found == [77, 19_999] and peak < 300e6


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBé\u0301\u1100\u1161\u11a8가①㈜ﬁİß_-. <b>&amp;1", max_size=40))
def test_places_go_with_the_plain_text(text):
    from corpusmill.llm.leakage import plain

    whole, places = normalised(text)
    assert whole == plain(text) and len(places) == len(whole)
    assert all(0 <= p < len(text) for p in places) and places == sorted(places)


def test_positions_of_normalised_text():
    text = "A, b가—<i>Cd</i>"
    whole, places = normalised(text)
    assert whole == "ab가cd"
    assert [text[p] for p in places] == list("Ab가Cd")


def test_operator(spark):
    documents = [(1, f"x {ITEMS[0][1]}"), (2, None), (3, ""), (4, "nothing of the sort"), (5, ("filler " * 50_000) + ITEMS[1][1] + ITEMS[2][1]), (1, f"x {ITEMS[0][1]}")]
    df = spark.createDataFrame([(*d, 0) for d in documents], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, ""), (97, " -- "), (None, "x")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(df, held_out(items)).collect()) == [(1, 0), (1, 0), (5, 1), (5, 2)]
    assert find_leaks(df, held_out(items.limit(0))).count() == 0
    assert find_leaks(df.limit(0), held_out(items)).count() == 0
