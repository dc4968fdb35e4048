from __future__ import annotations

import math
from collections import Counter

import pytest

from pyspark.sql import functions as F

from corpusmill.llm.encoding import Garbled, _read, garbled_suspects, restore_encoding

TEXT = "학생회는 기숙사 리모델링과 관련하여 휴학생의 의견을 수렴합니다. 문의 사항은 도서관으로 연락하여 주시기 바랍니다. 신청 기간은 다음과 같이 안내합니다."


@pytest.fixture(scope="module")
def garbled():
    counts = Counter(c for c in TEXT * 50 if "가" <= c <= "힣")
    total = sum(counts.values())
    return Garbled({c: math.log(n / total) for c, n in counts.items()})


@pytest.mark.parametrize("pair", [("utf-8", "latin-1"), ("cp949", "latin-1"), ("cp949", "gb18030"), ("utf-8", "mac-roman"), ("utf-8", "cp437")])
def test_round_trip(garbled, pair):
    spoiled = TEXT.encode(pair[0]).decode(pair[1])
    fixed, spans = garbled.repair(spoiled)
    assert spans > 0
    assert fixed == TEXT


@pytest.mark.parametrize("target", ["cp949", "gb18030", "big5", "euc-jp"])
def test_rarer_syllables_through_double_bytes(target):
    # Mostly rarer than the commonest 150; every pair of them that this encoding can hold.
    syllables = [c for a in range(0xB0, 0xC9) for b in range(0xA1, 0xFF, 8) if len(c := bytes([a, b]).decode("euc-kr", "ignore")) == 1]
    garbled = Garbled({c: -6.0 - i / 200 for i, c in enumerate(syllables)})
    tried = 0
    for a in syllables:
        for b in syllables[::7]:
            try:
                spoiled = (a + b).encode().decode(target)
            except UnicodeError:
                continue
            if spoiled.encode(target) == (a + b).encode() and len(spoiled) == 3 and not set(spoiled) & set(syllables):
                tried += 1
                assert garbled.repair(f"글 {spoiled} 끝") == (f"글 {a}{b} 끝", 1)
    assert tried > 50


def test_rare_words_inside_other_garbled_text(spark):
    model = {c: -6.0 for c in "의견을수렴합니다중도캠프발표배정"} | {c: -4.0 - i / 100 for i, c in enumerate(map(chr, range(0xB000, 0xB000 + 200)))}
    garbled = Garbled(model)
    middle, camp, notice = (w.encode().decode("cp949") for w in ("중도", "캠프", "발표"))
    assert garbled.repair(f"\ufffd{camp} {notice}\ufffd, {middle}")[0] == "\ufffd캠프 발표\ufffd, 중도"
    rows = spark.createDataFrame([(1, middle), (2, f"글의 {camp}")], "id long, text string")
    assert {r.id: r.restored for r in restore_encoding(rows, "text", ["id"], model).collect()} == {1: "중도", 2: "글의 캠프"}


def test_every_pattern_that_is_turned_back_passes_the_scan(spark, garbled):
    texts = {"Mar\u00c3\u00ada", "citt\u00c3\u00a0", "cos\u00c3\u00ac", "\u00c5\u00a0koda", "a\u00c2\u00a0b", "caf챕 x", "caf챕", "caf챕,"}
    for pattern in sorted(garbled.automaton)[::3]:
        texts.update((f"ab {pattern} cd", f"ab{pattern} cd", f"ab {pattern}cd", f"ab {pattern}{pattern}"))
    # Usual signs alone are correct text, whatever they would turn into.
    usual = set("\u00ad\u00b7\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201a\u201b\u201c\u201d\u2026\u203b")
    turned = [t for t in sorted(texts) if garbled.repair(t)[0] != t and not {c for c in t if c > "\x7f"} <= usual]
    assert len(turned) > 1500
    assert {"Mar\u00c3\u00ada", "a\u00c2\u00a0b", "caf챕 x"} <= set(turned)
    rows = spark.createDataFrame([(t,) for t in turned], "text string")
    assert [r.text for r in rows.where(~garbled_suspects(rows.text)).collect()] == []


def test_russian_words_are_no_hangul():
    # 'до' is 핍항 by Big5; beside other words garbled by that pair it is turned back with them.
    garbled = Garbled({c: -6.0 for c in "핍항글의을신청기간"})
    assert garbled.repair("открывают набор до 18 December") == ("открывают набор до 18 December", 0)
    spoiled = "신청 핍항 기간".encode("cp949").decode("big5")
    assert garbled.repair(spoiled)[0] == "신청 핍항 기간"


def test_text_garbled_twice(garbled):
    spoiled = TEXT.encode().decode("latin-1").encode().decode("latin-1")
    assert garbled.repair(spoiled)[0] == TEXT


def test_only_the_garbled_part_changes(garbled):
    half = TEXT.split(". ")
    mixed = f"{half[0]}. {half[1].encode('cp949').decode('latin-1')}. 大學院 規程 및 施行細則"
    assert garbled.repair(mixed) == (f"{half[0]}. {half[1]}. 大學院 規程 및 施行細則", 1)


def test_quotation_marks(garbled):
    for spoiled in ("say â\u0080\u0098theâ\u0080\u0099 word", "say ¡®the¡¯ word", "say \u0091the\u0092 word"):
        assert garbled.repair(spoiled)[0] == "say ‘the’ word"


@pytest.mark.parametrize(
    "text",
    [
        TEXT, "Université de Calhurst와의 협약", "Škola Lorbury, Åse Tammont, São Garwick, Âncora", "學則 제74조(目的)에 따라", "大學院 規程 및 施行細則", "ÄÖÜ窓口まで。説明会は", "Университет и кафедра «Ullow»",
        "½ 학점, ‰ 표기, ² 주석", "Señor, résumé (fee €62, ±2 °C)", "Żółty, Đại học, Ürünlü: ¿dónde está la señal? ¡Aquí! §67 ¶12", "ÉCOLE D’ÎLE (ÀÉÎ), ÂME & ÇÀ ET LÀ", "“quoted” ‘words’ – dash", "", " ",
    ],
)
def test_correct_text_is_left_alone(garbled, text):
    assert garbled.repair(text) == (text, 0)


def test_lost_text_is_a_case(garbled):
    assert garbled.repair("abc �� def")[1] == 1


def test_operator(spark):
    rows = [(1, 1, TEXT.encode("cp949").decode("latin-1")), (1, 2, TEXT), (2, 1, None), (3, 1, ""), (4, 1, "x" * 200_000 + "â\u0080\u0098the" + TEXT)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "prep_id long, block_no long, text string, restored string")
    found = {(r.prep_id, r.block_no): r.restored for r in restore_encoding(df, "text", ["prep_id", "block_no"]).collect()}
    assert set(found) == {(1, 1), (4, 1)}
    assert found[1, 1] == TEXT
    assert restore_encoding(df.limit(0), "text", ["prep_id"]).count() == 0


@pytest.mark.parametrize(
    ("text", "pair"),
    [
        ("Die Prüfung für Schüler", ("utf-8", "iso8859-15")), ("Żółty dom stoi za miastem", ("utf-8", "iso8859-2")), ("Žluťoučký kůň", ("utf-8", "cp1250")),
        ("Die Prüfung für Schüler", ("utf-8", "koi8-r")), ("Die Prüfung für Schüler", ("utf-8", "cp866")), ("Die Prüfung für Schüler", ("utf-8", "cp1251")),
        ("Кафедра открывает набор студентов", ("koi8-r", "cp1251")), ("Кафедра открывает набор студентов", ("cp1251", "koi8-r")), ("Кафедра открывает набор студентов", ("cp866", "cp1251")),
        ("Кафедра открывает набор студентов", ("koi8-r", "latin-1")), ("学校的学生明天开始学习", ("gb18030", "latin-1")),
        ("The café is open.", ("utf-8", "cp949")), ("The café is open.", ("utf-8", "gb18030")), ("The café is open.", ("utf-8", "cp437")), ("The café is open.", ("utf-8", "big5")),
    ],
)
def test_further_pairs(spark, garbled, text, pair):
    spoiled = _read(text.encode(pair[0]), pair[1])
    assert garbled.repair(f"x {spoiled} y")[0] == f"x {text} y"
    assert garbled.repair(text) == (text, 0)
    assert spark.createDataFrame([(spoiled,)], "t string").where(garbled_suspects(F.col("t"))).count() == 1


def test_signs_of_the_korean_standard(garbled):
    signs = "Aqui §46 ¶50".encode("cp949").decode("gb18030")
    assert garbled.repair(signs) == ("Aqui §46 ¶50", 2)
    # One such sign alone, or others of the kind, are correct text.
    assert garbled.repair("【2】")[1] == 0 and garbled.repair("a ∽ 3")[1] == 0 and garbled.repair("x ∑ y")[1] == 0
    assert garbled.repair("señal? " + "¡".encode("cp949").decode("latin-1") + "Aqu")[0] == "señal? ¡Aqu"
    assert garbled.repair("Gr" + "ß".encode("cp949").decode("gb18030") + "e")[0] == "Grße"
    assert garbled.repair("ÉCOLE D’ÎLE (ÀÉÎ), ÂME & ÇÀ ET LÀ")[1] == 0
