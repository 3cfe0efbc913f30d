import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import garbled, language, lookalike, split

DOC = "k long, t string, lang string, `_text` string, text string, start_pos string"


def frame(spark, texts):
    """Texts with further columns whose names clash with those of results."""
    rows = [(i, t, "x", "y", "z", "w") for i, t in enumerate(texts)] + [(None, texts[0], "x", "y", "z", "w")]
    return spark.createDataFrame(rows, DOC)


# splitting


def check_pieces(text, got, limit=1200, overlap=120):
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, *_ in got:
        assert 0 < b - a <= limit
    for (_, end, *_), (start, *_) in zip(got, got[1:], strict=False):
        assert 0 < end - start <= overlap


@pytest.mark.parametrize("text", ["word " * 1000, "x" * 5000, "Satz. " * 500 + "y" * 3000 + "\n\n" + "z" * 1300, "字" * 2500, "一句话。" * 900, "a" * 1201, "🟢 " * 1500, "." * 4000])
def test_pieces_cover_the_text(text):
    check_pieces(text, split.pieces(text, 1200, 120))


def test_split_positions_tokens_and_hard_cuts(spark):
    body = "Intro here. " + "x" * 1300 + " tail " + "y" * 1500
    long = "word " * 200_000
    df = frame(spark, [body, "short", "", None, long, body, "e" * 1200])
    rows = split.split_texts(df, "k", "t").collect()
    assert {r.k for r in rows} == {0, 4, 5}
    for r in rows:
        source = long if r.k == 4 else body
        assert source[r.start_pos : r.end_pos] == r.text and r.start_token < r.end_token
    found = split.oversized(split.split_texts(df, "k", "t"), "k").collect()
    want = {(k, p) for k in (0, 5) for p in (-1, 12, 1318)} | {(4, -1)}
    assert {tuple(r) for r in found} == want
    none = split.split_texts(df.limit(0), "k", "t", tokenizer=None)
    assert none.count() == 0 and split.oversized(none, "k").count() == 0
    with pytest.raises(ValueError):
        split.split_texts(df, "k", "t", 100, 100)


# garbled text

WRITTEN = {
    "de": "Die Schlüsselliste über größere Änderungen ist für alle verfügbar.",
    "fr": "La mémoire locale complète le dernier état connu après la relecture.",
    "ru": "После проверки словарь терминов перезаписывает список открытых вопросов.",
    "ko": "검토 결과 담당 동료가 주말 전에 자세한 회의록을 잠갔습니다.",
    "ja": "確認の結果、担当の同僚がすべての計画で議事録を消しました。",
    "zh": "从昨天起，负责的同事正在等待过期的密钥。",
}
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp949", "latin-1"), ("gbk", "latin-1"), ("cp1251", "latin-1"), ("cp1251", "cp866"), ("cp1252", "cp437"), ("cp932", "cp1252")]


def test_repairs_what_can_be_restored():
    done = tried = 0
    for text in WRITTEN.values():
        for written, read in WRONG:
            try:
                bad = text.encode(written).decode(read)
            except UnicodeError:
                continue
            if bad != text and len(bad) - len(text) < 3 * len(text) and sum(c > "\x7f" for c in bad) > 5:
                tried += 1
                done += garbled.repair(f"Heading\n{bad}\nplain line")[0] == f"Heading\n{text}\nplain line"
    assert tried > 20 and done / tried >= 0.85


def test_clean_texts_and_quotes_stay():
    for text in [*WRITTEN.values(), "ATENÇÃO: não há relação", "KMF는 OK", "«Voilà» — d’accord… ¿Qué?", "Ångström, naïve café", "The pair Ã© in old exports stands for one letter.", "Search for Ã¼ or � when it looks odd", "How to read â€™: see the help page", "the dеѕіgn note", "a &amp; b &lt; c", "", "ascii"]:
        assert garbled.repair(text)[:2] == (text, False)
    assert garbled.repair("in the cafÃ© demo")[0] == "in the café demo"
    assert garbled.repair("which â€œshould be fineâ€\x9d!")[0] == "which “should be fine”!"
    assert garbled.repair("one ranking rule â€” see 812")[0] == "one ranking rule — see 812"
    assert garbled.repair("Das M&auml;dchen l&auml;uft.") == ("Das Mädchen läuft.", True, "full", "unescape")
    assert garbled.repair("caf\\u00e9 na\\u00efve &amp; co")[0] == "café naïve &amp; co"
    # the first step leads to a dearer text: only escapes before, garbled characters then
    assert garbled.repair("caf&Atilde;&copy; and cr&Atilde;&uml;me")[0] == "café and crème"
    assert garbled.repair("verz�gert")[1:3] == (True, "none")
    twice = "Comme prévu".encode().decode("cp1252").encode().decode("cp1252")
    assert garbled.repair(twice)[0] == "Comme prévu"


def test_texts_are_suspected_each_for_itself():
    texts = ["plain", "Ünïcödé", "cafÃ©", "", "Пока", "été\nœuf " * 40, "a &eacute; b", "îê", "çà", "ñ" * 5, "ß ì"]
    alone = [garbled.suspicious(t) for t in texts]
    assert garbled.suspects(texts).tolist() == alone and alone[2] and alone[6] and not alone[0]


def test_repair_rows(spark):
    df = frame(spark, ["cafÃ©", "", None, "fine", "cafÃ©", "La mémoire complète. " * 10_000])
    got = {r.k: r.repaired for r in garbled.repair_texts(df, "k", "t").collect()}
    assert got == {0: "café", 4: "café"}
    assert garbled.repair_texts(df.limit(0), "k", "t").count() == 0


# look-alikes


@pytest.mark.parametrize(
    ("text", "form", "changes"),
    [
        ("plain", "plain", []),
        ("re​lease﻿", "release", ["invisible"]),
        ("a b c", "a b c", ["space"]),
        ("Ｓｉｇｎｅｄ ６８", "Signed 68", ["width"]),
        ("café", "café", ["composition"]),
        ("аliaѕ-tаble", "alias-table", ["mixed_script"]),
        ("it іѕ signed off", "it is signed off", ["whole_script"]),
        ("𝐁𝐨𝐥𝐝 𝓢cript", "Bold Script", ["compatibility"]),
        ("eﬃcient oﬀer №", "efficient offer №", ["compatibility"]),
        ("step ① of ③ x²", "step 1 of 3 x2", ["compatibility"]),
        ("ｶﾀｶﾅ", "カタカナ", ["compatibility"]),
        ("Словарь терминов", "Словарь терминов", []),
        ("он сор и рот", "он сор и рот", []),
        ("👨‍💻 ok", "👨‍💻 ok", []),
        ("版本，全角。", "版本，全角。", []),
        ("", "", []),
    ],
)
def test_one_form(text, form, changes):
    assert lookalike.one_form(text) == (form, changes)
    assert lookalike.one_form(form)[1] == []


def test_texts_of_repeated_keys_are_kept_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "k long, t string")
    assert sorted(map(str, lookalike.delivered_once(df, "k", "t").collect())) == sorted(map(str, df.filter("k IS NOT NULL").distinct().collect()))
    assert lookalike.skeleton("Ꮪᴏft ᴡare") == lookalike.skeleton("Soft ware".replace("S", "Ꮪ").replace("o", "о").replace("w", "ᴡ"))


def test_same_looking_rows(spark):
    names = ["alias", "аlias", "alias", "al​ias", None, "", "other"]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(names)] + [(None, "alias", 1), (0, "alias", 2)], "k long, n string, skeleton int")
    assert {tuple(r) for r in lookalike.same_looking(df, "k", "n").collect()} == {(0, 1), (0, 3), (1, 2), (1, 3), (2, 3)}
    assert lookalike.same_looking(df.limit(0), "k", "n").count() == 0
    assert lookalike.forms(df, "k", "n").filter("form = ''").count() == 1 and lookalike.forms(df, "k", "n").filter("k IS NULL").count() == 0


# languages

SAID = {
    "en": ["The local service keeps a copy of the list", "After the review the index was moved behind the queue", "Nobody objected before lunch and the disk is full"],
    "de": ["Der lokale Dienst vergleicht die Beziehungen zwischen den Knoten", "Nach der Prüfung übernimmt der Baustein alle Abschnitte", "Seit gestern gilt die neue Übersicht für alle Projekte"],
    "ko": ["검토 결과 담당 동료가 주말 전에 회의록을 잠갔습니다", "어제부터 공유 폴더가 초안을 대체했습니다", "전체 백업이 중복된 행을 비교했습니다"],
}


@pytest.fixture(scope="module")
def network(spark):
    rng = random.Random(1)
    rows = [(". ".join(rng.choices(s, k=4)) + ".", k) for k, s in SAID.items() for _ in range(40)]
    rows += [("The local service keeps a copy of the list.", "de")] * 3  # wrong labels
    return language.fit(spark.createDataFrame([*rows, (None, "en"), ("x", None)], "t string, code string"), "t", "code")


def test_languages_of_stretches(spark, network):
    mixed = SAID["en"][1] + ". " + SAID["de"][1] + "."
    wrong = (SAID["de"][1] + ".").encode().decode("cp1252")
    df = frame(spark, [SAID["en"][0] + ".", mixed, "", None, wrong, "123 !!", (SAID["ko"][0] + ". ") * 3000, mixed])
    found = language.segments(df, "k", "t", network)
    got = {(r.k, r.segment): r.lang for r in found.collect()}
    assert got == {(0, 0): "en", (1, 0): "en", (1, 1): "de", (4, 0): "de", (6, 0): "ko", (7, 0): "en", (7, 1): "de"}
    labels = df.select("k", F.lit("EN").alias("lang"))
    alias = spark.createDataFrame([("EN", "en"), (None, "de")], "alias string, lang string")
    rows = {r.k: (r.lang, r.langs, r.changed) for r in language.relabel(labels, "k", "lang", alias, found).collect()}
    assert rows[0] == ("en", ["en"], False) and rows[1][0] == "en" and set(rows[1][1]) == {"en", "de"} and rows[1][2]
    assert rows[4] == ("de", ["de"], True) and rows[3] == ("en", [], True)
    assert language.segments(df.limit(0), "k", "t", network).count() == 0
    assert language.fit(df.limit(0), "t", "lang") is None


def test_held_out_accuracy(spark, network):
    held = {"en": "The shared folder waits for the nested queue", "de": "Das gemeinsame Verzeichnis verzögert mehrere doppelte Zeilen", "ko": "오래된 검색 표가 빠진 항목을 실수로 지웠습니다"}
    for p in language._sentence_scores(network, [s.encode() for s in held.values()]):
        assert [network.labels[i] for i in p.argmax(axis=1)] == list(held)
        assert np.allclose(np.exp(p).sum(axis=1), 1)


def test_tables_give_the_scores_of_the_convolution(network):
    x, _ = language.windows([s.encode() for said in SAID.values() for s in said] + [b"", b"x", bytes(range(256))])
    feature, _, _ = network.pool(x)
    z = feature @ network.dense + network.dense_bias
    assert np.abs(network.scores(x) - language._normal(z)).max() < 1e-4


def test_confidence_is_calibrated():
    rng = np.random.default_rng(1)
    net = language.Network.random(["a", "b", "c"], 1)
    net.scores = lambda x: -4.0 * (x[:, :1] != np.array([[1, 2, 3]]))  # far too sure of every window
    y = rng.integers(0, 3, 4000)
    said = np.where(rng.random(4000) < 0.7, y, rng.integers(0, 3, 4000))
    pieces = [bytes([k + 1]) * int(n) for k, n in zip(said, rng.integers(1, 500, 4000), strict=True)]
    language.calibrate(net, pieces[:2000], y[:2000])
    p = np.exp(language._sentence_scores(net, pieces[2000:])[1])
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == y[2000:]).mean()) < 0.06


def test_nothing_is_told_apart_without_labels(spark):
    df = frame(spark, ["The local service keeps a copy.", ""])
    found = language.segments(df, "k", "t", None)
    assert found.count() == 0
    alias = spark.createDataFrame([("EN", "en")], "alias string, lang string")
    rows = language.relabel(df.select("k", F.lit("EN").alias("lang")), "k", "lang", alias, found).collect()
    assert {(r.k, r.lang, tuple(r.langs)) for r in rows} == {(0, "en", ()), (1, "en", ())}
