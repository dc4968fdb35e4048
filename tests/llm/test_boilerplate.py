from __future__ import annotations

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm.boilerplate import REGION_COST, Labels, _spark_hash, best_regions, learn, learn_labels, line_labels, shape, shaped, train

NOUNS = ["harbour", "orchard", "telescope", "violin", "granite", "meadow", "lantern", "compass", "saddle", "thimble", "walnut", "anchor"]
VERBS = ["opens", "closes", "moves", "begins", "ends", "changes"]
TOP = ["Main menu open", "Home > News", "Cookies help us count visitors. OK"]
INSIDE = "Share this page: mail, print"
BOTTOM = ["Visitors today: {n}", "Contact | Imprint | Sitemap", "(c) 2020 Town council"]


def sentence(k: int) -> str:
    a, b, v = NOUNS[k % 12], NOUNS[k // 12 % 12], VERBS[k // 5 % 6]
    return f"The {a} exhibition {v} on day {k} and everyone with a {b} is welcome to join us there."


def title(k: int) -> str:
    return f"Notice about the {NOUNS[k % 12]} and the {NOUNS[k // 12 % 12]} that {VERBS[k % 6]}"


def page(k: int) -> tuple[str, list[int]]:
    """A page and the numbers of the lines that the site puts around the text."""
    lines = [(line, True) for line in TOP[: 1 + k % 3]]
    lines += [(sentence(3 * k), False), ("Please read the attached file before you apply.", False), (f"Places: {k}", False)]
    if k % 2:
        lines.append((INSIDE, True))
    lines += [("", False), (sentence(3 * k + 1), False), (f"Next: {title(k + 1)}", True)]
    lines += [(line.format(n=k * 31), True) for line in BOTTOM]
    return "\n".join(line for line, _ in lines), [i for i, (_, around) in enumerate(lines, 1) if around]


@pytest.fixture(scope="module")
def site(spark):
    rows = [(100 * r + k, k, title(k), page(k)[0], "clash") for k in range(60) for r in (0, 1)]
    posts = spark.createDataFrame(rows, "capture_id long, post_no long, title string, content string, body string")
    texts = ["\n".join([sentence(1000 + 7 * k), "Please read the attached file before you apply.", f"Places: {k}"]) for k in range(80)]
    clean = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    return posts, clean


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=9))
def test_regions_against_every_choice(scores):
    def value(keep):
        regions = sum(1 for i, k in enumerate(keep) if k and (i == 0 or not keep[i - 1]))
        return sum(s for s, k in zip(scores, keep, strict=True) if k) - REGION_COST * max(0, regions - 1)

    best = max(value(keep) for keep in itertools.product((False, True), repeat=len(scores)))
    assert value(best_regions([float(s) for s in scores])) == pytest.approx(best)


def test_labels_come_from_the_data(site):
    posts, clean = site
    labels = learn_labels(posts, clean=clean)
    assert set(labels.around) == {*(shape(x) for x in TOP), INSIDE, *(shape(x.format(n=1)) for x in BOTTOM)}
    assert labels.around[shape(BOTTOM[1])] == 60  # posts, not sightings
    assert all(line.startswith("Next: ") for line in labels.links) and len(labels.links) > 5
    assert "Please read the attached file before you apply." in labels.text and "Places: 0" in labels.text
    assert not set(labels.text) & (set(labels.around) | set(labels.links))


def test_pages_against_what_was_put_around(site):
    posts, clean = site
    got = {r.capture_id: r.around for r in line_labels(posts, ["capture_id"], "content", learn(posts, clean=clean)).collect()}
    said = {(c, n) for c, ns in got.items() for n in ns}
    true = {(c, n) for c in got for n in page(c % 100)[1]}
    assert len(said & true) / len(true) > 0.97 and len(said & true) / len(said) > 0.97


def test_lines_that_were_not_labelled(site):
    """Half of the links and other sentences than the labelled ones are judged by their words."""
    posts, clean = site
    labels = learn_labels(posts, clean=clean)
    model = train(Labels(labels.around, labels.links[::2], labels.text, []))
    assert all(model.score(s) < 0 for s in labels.links[1::2])
    assert sum(model.score(shape(sentence(5000 + k))) > 0 for k in range(50)) >= 48


def test_without_clean_texts(site):
    posts, _ = site
    labels = learn_labels(posts)
    assert labels.text and all(s.startswith("The ") for s in labels.text)
    assert line_labels(posts, ["capture_id"], "content", train(labels)).count() == 120


def test_odd_rows(spark, site):
    posts, clean = site
    model = learn(posts, clean=clean)
    text = page(4)[0]
    rows = [(1, text, "t"), (2, None, None), (3, "", "t"), (4, "\n\n", None), (5, f"{sentence(9)}\n" * 20_000, None), (1, text, "t")]
    df = spark.createDataFrame([(*r, "clash", None) for r in rows], "capture_id long, content string, title string, body string, post_no long")
    found = [(r.capture_id, r.around) for r in line_labels(df, ["capture_id"], "content", model).collect()]
    by_id = dict(found)
    assert len(found) == 5 and by_id[1] == page(4)[1]
    assert by_id[3] == [] and by_id[4] == [] and by_id[5] == []
    assert line_labels(df.limit(0), ["capture_id"], "content", model).count() == 0
    # No labels: nothing is told from the text.
    assert line_labels(df, ["capture_id"], "content", learn(df.limit(0), clean=clean.limit(0))).where(F.size("around") > 0).count() == 0


def test_shapes_agree(spark):
    texts = ["  a\u00a0 b\t12,345 ", "\u3000x\u2003y 7", "\u0661\u0662 z", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(shaped(F.col("t"))).collect()] == [shape(t) for t in texts]
    assert [r[0] for r in df.select(F.xxhash64("t")).collect()] == [_spark_hash(t) for t in texts]
