import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atticwork import registry
from atticwork.functions import fuzzy, text, vectors
from atticwork.operators import dedup, nearest, search, sections

SCHEMA = (
    "id long, source string, section string, chunk_type string, table_headers string, content string, "
    "line_start int, line_end int, chunk_index int, embedding array<float>"
)


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "a.md", "Список условных обозначений", "", "", "СЕТЬ и порт 8080", 1, 2, 1, [1.0, 0.0]),
        (2, "a.md", "Список условных обозначений", "", "", "сеть передачи данных", 5, 6, 2, [0.0, 1.0]),
        (3, "a.md", "Список условных обозначений", "", "", "сеть передачи данных", 5, 6, 3, [0.0, 1.0]),
        (4, "a.md", "Серверы", "table_row", '["Имя","IP","Имя"]', '["x","10.0.0.1","y"]', 9, 12, 0, [1.0, 1.0]),
        (5, "a.md", "Серверы", "table_row", '["Имя","IP"]', '["z"]', 9, 12, 1, [0.0, 0.0]),
        (6, "a.md", "Серверы", "table_full", '["Имя","IP"]', "| raw |", 9, 12, 1, None),
        (7, "b.md", "", "", "", "Daily  Usage\nOutline и сеть", 3, 4, 1, [-1.0, 0.0]),
        (8, "b.md", "Abbr", "", "", "the daily usage outline unit", 30, 31, 2, [0.5, 0.5]),
        (9, "b.md", "Abbr", "paragraph_full", "", "daily usage outline", 1, 2, 1, [0.5, 0.5]),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_exact_search_folds_cyrillic_and_means_prose_by_default(chunks):
    assert ids(search.exact_search(chunks, "Сеть")) == [1, 2, 3, 7]
    assert ids(search.exact_search(chunks, "DAILY usage", chunk_type=None)) == [8, 9]
    assert ids(search.exact_search(chunks, "сеть", source="a.md", section="ОБОЗНАЧ", limit=2)) == [1, 2]


def test_equal_content_is_stored_once(chunks):
    assert ids(search.stored_chunks(chunks)) == [1, 2, 4, 5, 6, 7, 8, 9]
    assert search.count_chunks(chunks).first().chunks == 8


def test_multi_term_counts_distinct_terms(chunks):
    out = {r.id: r.match_count for r in search.multi_term_search(chunks, ["сеть", "порт", "сеть"]).collect()}
    assert out == {1: 2, 2: 1, 3: 1, 7: 1}


def test_regex_is_case_insensitive_for_cyrillic_and_returns_whole_matches(chunks):
    found = [r.matched_text for r in search.regex_search(chunks, "(с)еть").collect()]
    assert found == ["СЕТЬ", "сеть", "сеть", "сеть"]
    assert search.regex_search(chunks, "сеть", 2).count() == 2


@pytest.mark.parametrize(
    "abbreviation, pattern",
    [
        ("ЛИСА", r"Л[а-яё]*\s+И[а-яё]*\s+С[а-яё]*\s+А[а-яё]*"),
        ("DUO", r"D[a-z]*\s+U[a-z]*\s+O[a-z]*"),
        ("ZQ58", r"Z[a-z]*\s+Q[a-z]*\s+58"),
        ("W9", r"W[a-z]*\s+9"),
        ("A-B", None),
        ("", None),
    ],
)
def test_abbreviation_pattern(abbreviation, pattern):
    assert text.abbreviation_pattern(abbreviation) == pattern


def test_expansions_take_the_nearest_prose_chunk(chunks):
    out = search.find_expansions(chunks, "DUO").collect()
    # The spelling with a line break is found too, but only chunk 8 holds the words with single blanks.
    assert {(r.expansion, r.line_start) for r in out} == {("daily usage outline", 30), ("Daily Usage Outline", 30)}
    assert search.find_expansions(chunks, "R/M").count() == 0


def test_table_rows_become_maps(chunks):
    rows = {r.chunk_index: r["columns"] for r in search.read_table(chunks, "a.md", "сервер").collect()}
    assert rows == {0: {"IP": "10.0.0.1", "Имя": "y"}, 1: {"Имя": "z", "IP": None}}


def test_section_text_leaves_table_rows_out(chunks):
    row = search.section_content(chunks, "a.md", "Серверы").first()
    assert (row.content, row.line_start, row.line_end) == ("| raw |", 9, 12)
    assert search.section_content(chunks, "a.md", "нет").count() == 0
    assert [r.section for r in search.similar_sections(chunks, "a.md", "обозн").collect()] == ["Список условных обозначений"]


def test_neighbors(chunks):
    out = {(r.id, r.side) for r in search.neighbor_chunks(chunks, "a.md", 5, 1, 1).collect()}
    assert {s for _, s in out} == {"before", "after", "anchor"} and (1, "before") in out
    many = search.neighbors_of(chunks, chunks.filter("id = 2"), 5, 1).collect()
    assert {(r.side, r.line_start) for r in many} == {("before", 1), ("after", 9)}


def test_display(chunks):
    shown = {r.id: r.display for r in search.format_hits(chunks, "id", max_chars=10).collect()}
    assert shown[4] == "[4] [a.md] — Серверы (line 9)\nИмя: x; IP\n...[cut]"
    assert shown[7].startswith("[7] [b.md] (line 3)\nDaily  Usa")


def test_empty_name_matches_every_section(chunks):
    assert sections.sections_by_name(chunks, "").count() == 4
    assert sections.sections_by_name(chunks, "обозначений СПИСОК").first().chunk_count == 3


def test_threshold_comes_after_the_limit(spark):
    index = spark.createDataFrame([("a", "one", [1.0, 0.0]), ("a", "two", [0.0, 1.0])], "source string, section string, embedding array<float>")
    assert sections.semantic_sections(index, [1.0, 0.0], 2).count() == 2
    assert sections.semantic_sections(index, [1.0, 0.0], 2, 0.58).count() == 1


def test_typo_distance(spark):
    df = spark.createDataFrame([("Список условных обозначений",), ("ab",), ("AB",)], "s string")
    d = [r.d for r in df.select(fuzzy.qgram_distance("s", "обонзачения").alias("d")).collect()]
    grams = lambda w: [w[i : i + 3] for i in range(len(w) - 2)]
    a, b = grams("список условных обозначений"), grams("обонзачения")
    shared = sum(min(a.count(g), b.count(g)) for g in set(a))
    assert round(d[0], 9) == round((len(a) + len(b) - 2 * shared) / (len(a) + len(b)), 9)
    assert [r.d for r in df.select(fuzzy.qgram_distance("s", "aB").alias("d")).collect()][1:] == [0.0, 0.0]


def test_section_index_and_union_priority(spark, chunks):
    index = sections.build_section_index(chunks, nearest.letter_vector)
    assert index.count() == 3
    found = sections.search_sections(chunks, index, "abbr", [float("abbr".count(c)) for c in "abcdefghijklmnopqrstuvwxyz"], ["сеть"])
    got = {(r.source, r.section): r.match_type for r in found.collect()}
    assert got[("b.md", "Abbr")] == "NAME"
    assert got[("b.md", "")] == "CONTENT" and got[("a.md", "Список условных обозначений")] == "CONTENT"


def test_term_sections_keep_the_first_terms_count(chunks):
    got = {(r.source, r.section): r.match_count for r in sections.term_sections(chunks, ["порт", "сеть"]).collect()}
    assert got[("a.md", "Список условных обозначений")] == 1


def test_sections_listing(chunks):
    assert [(r.section, r.chunks_count) for r in sections.list_sections(chunks, "a.md").collect()] == [
        ("Серверы", 3), ("Список условных обозначений", 3),
    ]
    nested = chunks.withColumn("section", F.concat(F.lit("Top > "), "section"))
    assert ("a.md", "Серверы") in {(r.source, r.section) for r in sections.list_leaf_sections(nested).collect()}


def test_vectors(chunks):
    hits = nearest.semantic_search(chunks, [1.0, 0.0], 10, chunk_type=None).collect()
    assert hits[0].id == 1 and hits[0].distance == 0.0
    # A vector without length, or no vector, comes last without a distance.
    assert {h.id for h in hits[-2:]} == {5, 6} and hits[-1].distance is None
    assert nearest.semantic_search(chunks, [0.0, 0.0], 1).first().distance is None


def test_nearest_to_each_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    corpus = rng.normal(size=(300, 8)).astype("float32")
    corpus[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<float>").repartition(7)
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(5, 8)))]
    got = {(r["query"], r["rank"]): r.id for r in nearest.nearest_to_each(df, queries, 4).collect()}
    for name, q in queries:
        dist = [
            (math.inf if not v.any() else 1 - float(np.dot(v.astype("float64"), q)) / (np.linalg.norm(v.astype("float64")) * np.linalg.norm(q)), i)
            for i, v in enumerate(corpus)
        ]
        assert [got[(name, k + 1)] for k in range(4)] == [i for _, i in sorted(dist)[:4]]


def clustered(seed, n, dims=8):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, dims))
    return np.repeat(middles, n // 12, axis=0) + rng.normal(size=(n // 12 * 12, dims)) * 0.05


def brute_nearest(corpus, queries, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = np.maximum(1 - unit(queries) @ unit(corpus).T, 0)
    return {(int(q), r + 1): round(float(d), 9) for q, row in enumerate(distance) for r, d in enumerate(np.sort(row)[:k])}


@pytest.mark.parametrize("most", [20_000, 100])
def test_a_table_of_queries(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(nearest, "TABLE_QUERIES", most)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 90)
    monkeypatch.setattr(nearest, "CORPUS_PARTS", 3)
    monkeypatch.setattr(nearest, "_ROWS", 50)
    monkeypatch.setattr(nearest, "_QUERIES", 70)
    corpus, queries = clustered(3, 900), clustered(4, 300)
    path = str(tmp_path / "corpus")
    rows = [(f"r{i:04d}", v.tolist()) for i, v in enumerate(corpus)]
    bad = [("null", None), ("short", [1.0]), ("nan", [float("nan")] * 8), ("hole", [None] + [1.0] * 7)]
    spark.createDataFrame(rows + bad, "id string, embedding array<double>").repartition(5).write.parquet(path)
    asked = [(i, v.tolist()) for i, v in enumerate(queries)] + [(9001, None), (9002, [1.0]), (9003, [float("nan")] * 8)]
    table = spark.createDataFrame(asked, "query long, vector array<double>")
    found = nearest.nearest_to_each(spark.read.parquet(path), table, 6)
    got = {(r["query"], r["rank"]): round(r.distance, 9) for r in found.collect()}
    assert got == brute_nearest(corpus, queries, 6)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") == 1


def test_five_thousand_queries_in_one_scan(spark, tmp_path):
    corpus = clustered(5, 120)
    path = str(tmp_path / "corpus")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id long, embedding array<double>").write.parquet(path)
    table = spark.range(5000).select(F.col("id").alias("query"), F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(8)]).alias("vector"))
    found = nearest.nearest_to_each(spark.read.parquet(path), table.filter("query > 0"), 2)
    assert found.count() == 2 * 4999
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Scan parquet") == 1


def test_far_rows_are_left_out(monkeypatch):
    corpus = clustered(6, 2400)
    queries = corpus[::200] * 2
    compared = []
    merge = nearest._Nearest._merge
    monkeypatch.setattr(nearest, "_ROWS", 100)
    monkeypatch.setattr(nearest._Nearest, "_merge", lambda self, i, ids, distance: (compared.append(len(ids)), merge(self, i, ids, distance))[1])
    best = nearest._Nearest(list(range(len(queries))), queries, 3)
    best.add(np.arange(len(corpus)), corpus)
    assert sum(compared) < 0.6 * len(corpus) * len(queries)
    assert {(q, r + 1): round(float(d), 9) for q, (_, ds) in enumerate(best._found) for r, d in enumerate(ds)} == brute_nearest(corpus, queries, 3)


def test_first_of_equal_rows_without_sorting_texts(spark, tmp_path):
    rows = [(i, "a" if i % 2 else None, f"text {i % 7}" if i % 5 else None, i * 37 % 101) for i in range(300)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "id long, kind string, content string, place long").repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    got = dedup.first_of_equal(df, ["kind", "content"], ["place", "id"])
    want = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        want.setdefault((r[1], r[2]), r)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.values(), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    heavy = [line for line in plan.splitlines() if ("Sort " in line or "Aggregate" in line) and "content" in line]
    assert not heavy and "SortMergeJoin" not in plan
    # A length before each value keeps ("ab", "c") and ("a", "bc") apart.
    pairs = spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc"), (3, "-", None), (4, None, "-")], "id long, x string, y string")
    assert dedup.first_of_equal(pairs, ["x", "y"], ["id"]).count() == 4


def test_split_matches_promotes_the_best(spark):
    df = spark.createDataFrame([(1, 0.7), (2, 0.6), (3, 0.9)], "person_id int, distance double")
    assert [r.person_id for r in nearest.split_matches(df).filter("strong").collect()] == [2]
    near = spark.createDataFrame([(1, 0.5), (2, 0.51), (3, 0.1)], "person_id int, distance double")
    assert sorted(r.person_id for r in nearest.split_matches(near).filter("strong").collect()) == [1, 3]


def test_embedding_retries_and_drops(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("nan",)], "s string").coalesce(1)

    def fn(texts):
        if len(texts) > 1 or texts == ["bad"]:
            raise RuntimeError("no")
        return [[float("nan")] if texts == ["nan"] else [1.0]]

    assert [r.s for r in nearest.embed(df, "s", fn).collect()] == ["good"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ('["a, b", "", "10.0.0.1/24"]', "a b 10.0.0.1/24"),
        ("| a | b |\n|---|---|\n| 1.5 | x |", "a b 1 5 x"),
        ("IP 192.168.0.1: ok!\tnext_word", "IP 192.168.0.1 ok next_word"),
        ("[not json", "not json"),
        ("=====\nтекст — да", "текст да"),
        ("1.2.3.4.5/24 and 1.2.3.4/245", "1 2.3.4.5/24 and 1.2.3.4 245"),
        ("1234.1.1.1 10.0.0.1.2 1.2.3.4567", "1234 1 1 1 10.0.0.1 2 1 2 3 4567"),
        ("a\xa0b \xa0 c\n\xa0|\n", "a\xa0b \xa0 c"),
        ("x\xa0" * 20_000 + "y" * 100_000 + "." * 100_000, "x\xa0" * 20_000 + "y" * 100_000),
        ("", ""),
        (None, None),
    ],
)
def test_embedding_text(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.embedding_text("s").alias("t")).first().t == clean


@pytest.mark.parametrize(
    "raw, keep",
    [
        ("too short", False),
        ("plain words that are long enough", True),
        ("!!!!!!!!!!!!!!!!!!!!!!!! 12 ----", False),
        ("12345678901234567890 12345", False),
        ("------------ 10.20.30.40 ----------", True),
        ("------------ влан 200 ----------", True),
        ("1111111111111111111 0xDEADBEEF 11111", True),
    ],
)
def test_embeddable(spark, raw, keep):
    assert spark.createDataFrame([(raw,)], "s string").select(text.is_embeddable("s").alias("k")).first().k is keep


def test_registry_checks_arguments(chunks):
    assert len(registry.summaries()) == 13
    assert registry.call("exact_search", chunks, query="порт", limit=5).count() == 1
    for name, args in [
        ("nothing", {}),
        ("exact_search", {"query": "x", "limit": 0}),
        ("exact_search", {"substring": "x"}),
        ("semantic_search", {"vec": [1.0], "top_k": 0}),
        ("get_chunks_by_index", {"source": "a", "section": "b", "indices": []}),
        ("get_neighbor_chunks", {"source": "a", "line": 0}),
    ]:
        with pytest.raises(ValueError):
            registry.check(name, args)


def test_nan_check(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([1.0],)], "v array<double>")
    assert [r.n for r in df.select(vectors.has_nan("v").alias("n")).collect()] == [True, False]


def test_results_come_in_rank_order(chunks):
    rows = search.multi_term_search(chunks, ["сеть", "порт"], 3).collect()
    assert [(r["rank"], r.id, r.match_count) for r in rows] == [(1, 1, 2), (2, 2, 1), (3, 3, 1)]
    assert [r.id for r in search.exact_search(chunks, "сеть").collect()] == [1, 2, 3, 7]
    assert [(r.match_count, r.chunks, r.total_chunks, r.max_coverage) for r in search.coverage_groups(
        search.multi_term_search(chunks, ["сеть", "порт"])).orderBy("match_count").collect()] == [(1, 3, 4, 2), (2, 1, 4, 2)]


def test_nothing_is_cut_by_default(spark):
    rows = [(i, "s.md", f"Part {i}", "table_row", '["A"]', f'["{i}"]', i, i, i, None) for i in range(1, 1301)]
    many = spark.createDataFrame(rows, SCHEMA)
    assert search.table_chunks(many, "part").count() == 1300
    assert search.read_table(many, "s.md", "part").count() == 1300
    assert sections.list_sections(many).count() == 1300
    assert sections.sections_with_term(many, '"').count() == 1300
    assert search.regex_search(many, r"\d+").count() == 1300


def test_vectors_without_a_distance_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [0.0, 1.0]), (6, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    found = nearest.nearest_to_each(df, [("q", [1.0, 0.1])], 2).orderBy("rank").collect()
    assert [r.id for r in found] == [1, 6]
