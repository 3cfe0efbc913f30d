import os

import pytest

from quillon.functions.tokenizer import TOKENIZER, bpe_ends
from quillon.schema import memory
from quillon.session import discard, filesystem, materialise, spread
import math
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking, crosslingual, embedding, fulltext, hybrid, linking, vector

CASES = [
    "The quick brown fox jumps over the lazy dog. " * 120,
    "대한민국은 동아시아의 국가입니다. 수도는 서울입니다. " * 80,
    "🟢 Status check ✅ 모든 시스템 정상 🎉 Build OK 💯 " * 80,
    "𠮷田さん says 안녕! 你好世界 🌍🟢✅ こんにちは " * 80,
    "🟢✅🎉💯🌍🚀⭐📊" * 60,
    "Hello 안녕 🟢",
]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_windows_keep_their_positions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(98, ""), (99, None)], "k long, t string")
    rows = chunking.chunk_texts(df, "k", "t", 100, 20).collect()
    for r in rows:
        assert CASES[r.k][r.start_pos : r.end_pos] == r.text
    for i, t in enumerate(CASES):
        own = sorted((r for r in rows if r.k == i), key=lambda r: r.chunk_index)
        n = own[-1].end_token
        assert len(own) == -(-n // 80) and n == len(chunking.word_ends(t))
        assert [r.start_pos for r in own] == sorted(r.start_pos for r in own)
    assert {r.k for r in rows} == set(range(6))
    with pytest.raises(ValueError):
        chunking.chunk_texts(df, "k", "t", 10, 10)


def test_slugs_and_dates(spark):
    lit = F.lit
    assert value(spark, T.slug(lit("C++ 한글-Ünï"))) == "entity_c___한글_ünï"
    assert value(spark, T.strip_date(lit("[2025-01-31]  x"))) == "x"
    assert value(spark, T.stamp(lit("x"), "2026-01-01")) == "[2026-01-01] x"
    assert value(spark, T.terms(lit("Big Data at NASA 한글 in Paris. Big Data"))) == ["Big Data", "Paris", "NASA", "한글"]
    assert value(spark, T.sentences(lit("- First sentence here. No! Second sentence here?"))) == ["First sentence here", "Second sentence here"]
    assert value(spark, T.normalise_query(lit("  a  b "))) == "a b"


def test_links(spark):
    chunks = spark.createDataFrame([("1", "KMF는 좋다"), ("2", "kmfx"), ("3", "we use c++ here"), ("4", "see Gemini_Converter.py now"), ("5", None), ("6", "한글 결제모듈")], "chunk_id string, text string")
    ent = spark.createDataFrame([("e1", "KMF", []), ("e2", "c++", []), ("e3", "converter", ["in gemini_converter.py"]), ("e4", "결제", []), ("e5", "abcd", [])], "id string, name string, observations array<string>")
    named = {tuple(r) for r in linking.name_links(chunks, ent).collect()}
    assert named == {("1", "e1"), ("6", "e4")}  # c++ ends in no word character, so no boundary follows
    assert {tuple(r) for r in linking.alias_links(chunks, ent).collect()} == {("4", "e3")}
    assert {tuple(r) for r in linking.auto_links(chunks, ent).collect()} == {("4", "e3"), ("6", "e4")}


def test_bm25_shuffles_no_postings(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"alpha beta w{i % 3} gamma") for i in range(30)], "chunk_id string, text string").repartition(4, "chunk_id")
    asks = spark.createDataFrame([(1, "w1 alpha"), (2, "beta-gamma w2"), (3, "none")], "q long, t string")
    sent, joined = (fulltext.bm25(chunks, asks, "q", "t", 5, small=n) for n in (1000, 0))
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, joined.collect()))
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((term|words#\d+, size#\d+, chunk_id)", plan)


def test_links_meet_by_the_rarest_part_of_a_name(spark):
    codes = [f"q{i:03d}z" for i in range(200)]
    chunks = spark.createDataFrame([(str(i), f"어제 요약 계획 {c}에서 a_orphaned_{i}.mdx") for i, c in enumerate(codes)], "chunk_id string, text string")
    ent = spark.createDataFrame([(f"e{i}", f"요약 계획 {c}", [f"see orphaned_{i}.md"]) for i, c in enumerate(codes)], "id string, name string, observations array<string>")
    words = linking._named(ent, 1, 1).unionByName(linking._aliased(ent))
    assert linking.meetings(chunks.select("chunk_id", "text"), words).count() < 4 * len(codes)  # the first two characters are those of all names
    links = {tuple(r) for r in linking.auto_links(chunks, ent).collect()}
    assert links == {(str(i), f"e{i}") for i in range(200)}


def test_names_in_odd_places_are_linked(spark):
    names = ["결제", "제", "결제 ab", "ab 결제", "x결", "abcdefghij결", "결abcdefghij", "가 나", "c++", "a_b", "結果-v2-最終"]
    texts = ["zab 결제", "결제 abc", "우리결제", "제", "xx결x", "0abcdefghij결1", "결abcdefghijk", "가 나", "c++x", "A_B!", "a_b_c", "前結果-v2-最終後", "결 제", "", "다가 나"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    ent = spark.createDataFrame([(n, n) for n in names], "id string, name string")
    edge = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    cjk = re.compile(T.CJK)
    want = {(str(i), n) for i, t in enumerate(texts) for n in names if (n in t.lower() if cjk.search(n) else re.search(edge + re.escape(n) + edge, t.lower()))}
    assert {tuple(r) for r in linking.name_links(chunks, ent).collect()} == want


FTS = [("d_chunk_0", "foo bar baz"), ("d_chunk_1", "foo foo qux"), ("e_chunk_0", "Ünïcode wörd, v1.2"), ("e_chunk_1", "KMF는 한글"), ("x1", "bar foo")]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("qux", {"d_chunk_1": -1.0508465369868878}),
        ("foo", {"d_chunk_1": -1.3333333e-06, "x1": -1.2222222e-06, "d_chunk_0": -9.5652174e-07}),
        ("bar qux", {"d_chunk_1": -1.0508465369868878, "x1": -0.4112438447592603, "d_chunk_0": -0.3218430089420298}),
        ("qux qux", {"d_chunk_1": -2.1016930739737756}),
        ("unicode", {"e_chunk_0": -0.9798433925958817}),
        ("bar.baz", {"d_chunk_0": -1.0508465369868878}),
        ("KMF", {}),
    ],
)
def test_bm25_numbers(spark, query, want):
    chunks = spark.createDataFrame(FTS, "chunk_id string, text string")
    got = fulltext.bm25(chunks, spark.createDataFrame([(1, query)], "q long, t string"), "q", "t").collect()
    assert {r.chunk_id: pytest.approx(r.score, rel=1e-6) for r in got} == want


def test_boosts(spark):
    assert value(spark, hybrid.decayed(F.array(*map(F.lit, [0.3, 0.0, 0.15, 0.3])))) == pytest.approx(0.4)
    assert value(spark, hybrid.decayed(F.array(*map(F.lit, [0.15, 0.2])))) == pytest.approx(0.275)
    assert value(spark, hybrid.decayed(F.array().cast("array<double>"))) == 0
    assert value(spark, vector.similarity(F.lit(2.5))) == 0
    s = value(spark, hybrid.summary(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, [0.1, 0.9, 0.8, 0.2]))))
    assert (s.text, s.score) == ("b [...] d", 0.9)


def test_knn_is_exact_and_breaks_ties_by_id(spark):
    rows = [(i, [float(i % 3), 1.0, 0.0, 0.0]) for i in range(9)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.query, r["rank"]): r.id for r in vector.knn(df, df.filter("id = 4"), 3, 4, block=4).collect()}
    assert got == {(4, 1): 1, (4, 2): 7, (4, 3): 0}


def test_translation():
    d = {"native-en": {"검색": "search", "검색 서비스": "search service"}, "en-native": {"search service": "검색 서비스"}}
    assert crosslingual.variants("검색 서비스  찾기", d) == ["검색 서비스 찾기", "search service"]
    assert crosslingual.variants("the search service", d)[1] == "the 검색 서비스"
    assert crosslingual.variants("other", d) == ["other"]
    assert crosslingual.load_dictionary("/nowhere") == {"native-en": {}, "en-native": {}}
    assert math.isclose(1 / 61, 1 / (hybrid.RRF + 1))


def test_embeddings(spark):
    chunks = spark.createDataFrame([("1", "one two two"), ("2", None), ("3", "...")], "chunk_id string, text string")
    got = {r.chunk_id: r.embedding for r in embedding.embed_chunks(chunks).collect()}
    assert set(got) == {"1", "3"} and sum(x * x for x in got["1"]) == pytest.approx(1) and not any(got["3"])
    said = spark.createDataFrame([(1, "c", 0, "the list of keys"), (1, "c", 1, "..."), (1, "d", 0, "the list of keys")], "query long, chunk_id string, n int, sentence string")
    asked = spark.createDataFrame([(1, "list of keys")], "query long, text string")
    scores = {(r.chunk_id, r.n): r.score for r in embedding.sentence_scores(said, asked).collect()}
    assert scores["c", 0] == scores["d", 0] > 0.3 and scores["c", 1] == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
@pytest.mark.parametrize("text", ["The quick brown fox jumps over the lazy dog. " * 120, "대한민국은 동아시아의 국가입니다. 수도는 서울입니다. " * 80, "🟢 Status check ✅ 모든 시스템 정상 🎉 Build OK 💯 " * 80, "𠮷田さん says 안녕! 你好世界 🌍🟢✅ こんにちは " * 80, "🟢✅🎉💯🌍🚀⭐📊" * 60, "Hello 안녕 🟢"])
def test_bpe_windows_are_slices_of_whole_characters(spark, text):
    rows = chunking.chunk_texts(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", 100, 20, bpe_ends()).orderBy("chunk_index").collect()
    assert all(text[r.start_pos : r.end_pos] == r.text and "\ufffd" not in r.text for r in rows)
    assert rows[0].start_pos == 0 and rows[-1].end_pos == len(text) and all(b.start_token - a.start_token == 80 and b.start_pos <= a.end_pos for a, b in zip(rows, rows[1:], strict=False))


def test_positions_in_utf16_units_become_codepoints(spark):
    body = "a🟢b✅c💯d"
    m = spark.createDataFrame([("x", "d", 0, 4), ("y", "d", 4, 9), ("z", "gone", 1, 2), ("n", "d", None, None)], "chunk_id string, document_id string, start_pos int, end_pos int")
    got = {r.chunk_id: (r.start_pos, r.end_pos) for r in chunking.codepoint_positions(m, spark.createDataFrame([("d", body)], "id string, content string")).collect()}
    assert got == {"x": (0, 3), "y": (3, 7), "z": (1, 2), "n": (None, None)}


def test_spread_starts_no_job(spark):
    m = memory(spark, "/root/testdata/sf0.001")
    spark.sparkContext.setJobGroup("spread", "spread")
    spread(m.documents), spread(m.chunks.select("text"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    spark.sparkContext.setJobGroup("other", "other")


def test_deliveries_read_only_the_columns_used(spark):
    plan = memory(spark, "/root/testdata/sf0.001").entities.groupBy("entity_type").count()._jdf.queryExecution().executedPlan().toString()
    assert "observations" not in plan and "metadata" not in plan


def test_what_was_written_is_deleted(spark):
    df = materialise(spark.range(5), "numbers")
    fs, place = filesystem(spark, df.written_to)
    assert df.count() == 5 and fs.exists(place)
    discard(df)
    assert not fs.exists(place)
    by = materialise(spark.range(50), "numbers", by="id")
    assert "Exchange" not in by.groupBy("id").count()._jdf.queryExecution().sparkPlan().toString() and by.count() == 50
    discard(by)


def test_searches_shuffle_neither_texts_nor_pairs(spark):
    chunks = spark.createDataFrame([(f"c{i}", " ".join(f"{'abcdef'[i * j % 6]}{j % 3} x.y" for j in range(1 + i % 9))) for i in range(300)] + [("c", None)], "chunk_id string, text string")
    asks = spark.createDataFrame([(q, f"a{q % 3} x.y b{q % 3} a{q % 3} nowhere") for q in range(40)] + [(99, "...")], "q long, t string")
    sent, joined = (fulltext.bm25(chunks, asks, "q", "t", 5, small=n) for n in (1000, 0))
    rows = lambda df: sorted((r.q, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert rows(sent) == rows(joined) and len(rows(sent)) == 200
    vectors = spark.createDataFrame([(f"v{i:03}", [float(i % 7), float(i % 5), 1.0, float(i % 2)]) for i in range(200)], "id string, v array<double>")
    near = vector.knn(vectors, vectors.filter("id < 'v050'"), 3, 4, block=16)
    points = {r.id: r.v for r in vectors.collect()}
    far = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(points[a], points[b], strict=True)) ** 0.5, 9)
    want = {(q, n + 1, i) for q in points if q < "v050" for n, i in enumerate(sorted((i for i in points if i != q), key=lambda i: (far(q, i), i))[:3])}
    assert {(r.query, r["rank"], r.id) for r in near.collect()} == want
    for df, key in ((sent, "q"), (near, "query")):  # only what tasks pass on of each query
        shuffles = re.findall(r"Exchange (\w+)\((\w+)", df._jdf.queryExecution().executedPlan().toString())
        assert set(shuffles) == {("hashpartitioning", key)}
