"""Lexical and vector retrieval against brute force, fusion properties, plan shapes."""

import random
import re

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lexweave.functions import stemming
from lexweave.operators import fusion, lexical, query, ranking, vector
from lexweave.plans import search

random.seed(5)
WORDS = ["lov", "lovdag", "lover", "arv", "arving", "skatt", "om", "av", "ekteskap", "de", "den"]
TEXTS = [" ".join(random.choices(WORDS, k=random.randint(0, 14))) for _ in range(120)]
ASKED = ["lov", "skatt arv", "ekteskap om skatt", "den lov", "om", "", "arving lover", "skatt skatt", "lovdag arving ekteskap", "ukjent"]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(at, body, "Lov" if at % 3 else None, at % 4 + 2000) for at, body in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, content string, law_type string, year int")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id long, text string")


def terms_of(asked):
    return list(dict.fromkeys(re.findall(r"\w{3,}", asked)))


def fits(term, word):
    return word.startswith(term) if len(term) == 3 else word == term


def expected_all():
    return {
        (q, at)
        for q, asked in enumerate(ASKED)
        for at, body in enumerate(TEXTS)
        if terms_of(asked) and all(any(fits(t, w) for w in body.split()) for t in terms_of(asked))
    }


def expected_phrases():
    found = set()
    for q, asked in enumerate(ASKED):
        terms = terms_of(asked)
        for at, body in enumerate(TEXTS):
            words = body.split()
            starts = range(len(words) - len(terms) + 1)
            if len(terms) > 1 and any(all(fits(t, words[s + i]) for i, t in enumerate(terms)) for s in starts):
                found.add((q, at))
    return found


def pairs(df):
    return {(row["query_id"], row["id"]) for row in df.collect()}


def test_match_all_and_phrase(chunks, queries):
    postings = lexical.build_postings(chunks)
    plan = query.build_match_plan(queries)
    terms = lexical.resolve_terms(plan, postings)
    matches = lexical.match_terms(postings, plan, terms)
    assert pairs(matches) == expected_all()
    phrases = lexical.match_phrase(postings, plan, terms, matches)
    assert pairs(phrases) == expected_phrases()
    flagged = lexical.with_phrase_flag(matches, phrases)
    assert pairs(flagged.where("phrase_hit")) == expected_phrases() & expected_all()


def test_postings(chunks):
    for row in lexical.build_postings(chunks).collect():
        words = TEXTS[row["id"]].split()
        assert row["positions"] == [at for at, word in enumerate(words) if word == row["token"]]
        assert (row["tf"], row["n_tokens"]) == (len(row["positions"]), len(words))


def test_stop_words_keep_positions(chunks):
    kept = lexical.build_postings(chunks, stop_words=["om"]).where("token = 'skatt'").collect()
    assert kept and all(TEXTS[row["id"]].split()[at] == "skatt" for row in kept for at in row["positions"])


def test_language_stop_words(chunks):
    words = lexical.language_stop_words()
    assert {"og", "om", "av", "de"} <= set(words)
    left = {row["token"] for row in lexical.build_postings(chunks, stop_words=words).select("token").distinct().collect()}
    assert left == set(WORDS) - set(words)


def test_short_prefixes(chunks, spark):
    queries = spark.createDataFrame([(1, "d sk"), (2, "de")], "query_id long, text string")
    postings = lexical.build_postings(chunks, positions=False)
    plan = query.build_match_plan(queries, "prefix_all")
    terms = lexical.resolve_terms(plan, postings)
    expected = {
        (q, at)
        for q, prefixes in ((1, ["d", "sk"]), (2, ["de"]))
        for at, body in enumerate(TEXTS)
        if all(any(word.startswith(p) for word in body.split()) for p in prefixes)
    }
    assert pairs(lexical.match_terms(postings, plan, terms)) == expected


def test_short_exact_terms(spark):
    chunks = spark.createDataFrame([(1, "se nr.4 om lov"), (2, "se nr.5 om lov")], "id long, content string")
    queries = spark.createDataFrame([(1, "nr.4 lov")], "query_id long, text string")
    postings = lexical.build_postings(chunks)
    for mode in ("split", "robust"):
        plan = query.build_match_plan(queries, mode)
        assert pairs(lexical.match_terms(postings, plan, lexical.resolve_terms(plan, postings))) == {(1, 1)}


def test_long_queries(spark):
    words = [f"word{at:03d}" for at in range(200)]
    chunks = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1]))], "id long, content string")
    queries = spark.createDataFrame([(7, " ".join(words))], "query_id long, text string")
    postings = lexical.build_postings(chunks)
    plan = query.build_match_plan(queries)
    terms = lexical.resolve_terms(plan, postings)
    matches = lexical.match_terms(postings, plan, terms)
    assert pairs(matches) == {(7, 1)}
    assert pairs(lexical.match_phrase(postings, plan, terms, matches)) == {(7, 1)}


def test_filters(chunks, queries):
    corpus = search.index_corpus(chunks)
    asked = queries.withColumns(
        {"filter_law_type": F.when(F.col("query_id") < 3, "Lov"), "filter_year": F.when(F.col("query_id") > 1, 2001)}
    )
    expected = {
        (q, at)
        for q, at in expected_all()
        if (q >= 3 or at % 3) and (q <= 1 or at % 4 == 1)
    }
    assert pairs(search.lexical_matches(corpus, asked)) == expected


def test_bucketed_index_needs_no_shuffle_for_the_terms_of_a_chunk(chunks, queries, spark):
    lexical.write_postings(lexical.build_postings(chunks), "bucketed_postings", 4)
    stored = spark.table("bucketed_postings")
    plan = query.build_match_plan(queries)
    terms = lexical.resolve_terms(plan, stored)
    assert pairs(lexical.match_terms(stored, plan, terms)) == expected_all()
    assert "Exchange hashpartitioning" not in plan_of(lexical.doc_terms(stored, terms))
    spark.sql("DROP TABLE bucketed_postings")


def test_plan_shapes(chunks, queries):
    corpus = search.index_corpus(chunks)
    matches = search.lexical_matches(corpus, queries)
    plan = plan_of(lexical.lexical_top(matches, 5))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan and "Python" not in plan


def joins_of_terms(df):
    """What stands below each join by chunk and term, down to the first file that is read."""
    lines = plan_of(df).split("\n")
    found = []
    for at, line in enumerate(lines):
        if re.search(r"(SortMergeJoin|ShuffledHashJoin) \[id#\d+L?, term_id#", line):
            scan = next(i for i in range(at, len(lines)) if "FileScan" in lines[i])
            found.append(lines[at : scan + 1])
    return found


def test_postings_meet_candidates_inside_their_bucket(chunks, queries, spark):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # as get_session sets it
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lexical.write_postings(lexical.build_postings(chunks), "candidate_postings", 4)
        stored = spark.table("candidate_postings")
        plan = query.build_match_plan(queries)
        terms = lexical.resolve_terms(plan, stored)
        matches = lexical.match_terms(stored, plan, terms)
        below = joins_of_terms(matches)
        assert below and all("Exchange hashpartitioning" not in line for lines in below for line in lines)
        assert all("candidate_postings" in lines[-1] for lines in below)
        assert pairs(matches) == expected_all()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS candidate_postings")


def test_prefixes_of_every_length_meet_by_equality(spark):
    words = ["a", "ab", "abc", "abcdefghijklmn", "abcdefghijklmno", "xabc", "b"]
    chunks = spark.createDataFrame(list(enumerate(words)), "id long, content string")
    asked = ["abcdefghijklmno"[:size] for size in range(1, 13)] + ["zz", "xa"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    postings = lexical.build_postings(chunks, positions=False)
    plan = query.build_match_plan(queries, "prefix_all")
    terms = lexical.resolve_terms(plan, postings)
    want = {(q, at) for q, prefix in enumerate(asked) for at, word in enumerate(words) if word.startswith(prefix)}
    assert pairs(lexical.match_terms(postings, plan, terms)) == want


# --- stems --------------------------------------------------------------------

STEMS = {
    "ekteskapet": "ekteskap", "ekteskap": "ekteskap", "havnedistriktene": "havnedistrikt", "havnemyndighetene": "havnemynd",
    "havnefunksjoner": "havnefunksjon", "havnekassa": "havnekass", "havnekassens": "havnekass", "havnefylkes": "havnefylk",
    "opninga": "opning", "opparbeidet": "opparbeid", "lov": "lov", "loven": "lov", "lovene": "lov", "av": "av", "": "",
    "krevd": "krevd", "opplevert": "opplever", "krdt": "krdt", "godkjendt": "godkjend", "bøkers": "bøk", "taks": "taks", "kirks": "kirk", "gass": "gass", "xyz": "xyz",
}


def test_stems(column):
    words = list(STEMS)
    assert column(words, "word string", stemming.norwegian_stem("word")) == list(STEMS.values())
    assert column([None], "word string", stemming.norwegian_stem("word")) == [None]


def test_stemmed_search_finds_inflected_words(spark):
    texts = ["lov om ekteskap", "ekteskapets oppløsning", "ekteskapene og lovene", "arv", "ekteskapelig"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    queries = spark.createDataFrame([(1, "ekteskapet"), (2, "loven om ekteskapet"), (3, "om og av")], "query_id long, text string")
    corpus = search.index_corpus(chunks)
    found = pairs(search.lexical_matches(corpus, queries, "stemmed", stop_words=lexical.language_stop_words()))
    # the rules cut -elig too
    assert found == {(1, 0), (1, 1), (1, 2), (1, 4), (2, 0), (2, 2)}


def test_empty_plan_policy(chunks, queries):
    plan = query.build_match_plan(queries)
    asked_nothing = {q for q, asked in enumerate(ASKED) if not terms_of(asked)}
    everything = lexical.empty_plan_matches(queries, plan, chunks, 4, "all")
    assert pairs(everything) == {(q, at) for q in asked_nothing for at in range(4)}
    assert lexical.empty_plan_matches(queries, plan, chunks, 4).count() == 0


# --- vectors ----------------------------------------------------------------


def vectors(spark, n=300, m=7, dim=16, hot=False):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((n, dim))
    if hot:  # a third of all rows point the same way
        data[: n // 3] = data[0] + rng.standard_normal((n // 3, dim)) * 1e-3
    asked = rng.standard_normal((m, dim))
    rows = [(at, v.tolist() if at % 10 else None, "a" if at % 2 else "b") for at, v in enumerate(data)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>, law_type string")
    asking = [(at, v.tolist() if at else None, "a" if at == 1 else None) for at, v in enumerate(asked)]
    queries = spark.createDataFrame(asking, "query_id long, vector array<double>, filter_law_type string")
    return data, asked, chunks, queries


def expected_top(data, asked, k):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    found = {}
    for q in range(1, len(asked)):
        scores = unit @ (asked[q] / np.linalg.norm(asked[q]))
        rows = [at for at in range(len(data)) if at % 10 and (q != 1 or at % 2)]
        found[q] = sorted(rows, key=lambda at: (-round(scores[at], 8), at))[:k]
    return found


def by_query(df):
    found = {}
    for row in sorted(df.collect(), key=lambda row: row["rank"]):
        found.setdefault(row["query_id"], []).append(row["id"])
    return found


@pytest.mark.parametrize("hot", [False, True])
def test_exact_top(spark, hot):
    data, asked, chunks, queries = vectors(spark, hot=hot)
    expected = expected_top(data, asked, 9)
    assert by_query(vector.vector_top(chunks, queries, 9)) == expected
    assert by_query(vector.vector_top(chunks, queries, 9, query_block=2)) == expected


def test_a_task_gives_k_rows_of_a_query(spark):
    data, asked, chunks, queries = vectors(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        top = vector.vector_top(chunks.coalesce(1), queries, 9)
        assert by_query(top) == expected_top(data, asked, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_top_does_not_join(spark):
    _, _, chunks, queries = vectors(spark)
    plan = plan_of(vector.vector_top(chunks, queries, 9))
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_approximate_recall(spark):
    data, asked, chunks, queries = vectors(spark, n=600, hot=True)
    exact, found = expected_top(data, asked, 10), by_query(vector.vector_top_approx(chunks, queries, 10, 16, bits=3, tables=12))
    hits = sum(len(set(exact[q]) & set(found.get(q, []))) for q in exact)
    assert hits / sum(map(len, exact.values())) > 0.7


def test_registered_approximate_recall(spark):
    from lexweave import catalog
    from lexweave.catalog.base import Tables

    small = "/root/testdata/sf0.01"
    tables = Tables(spark, small)
    exact = by_query(vector.vector_top(tables.embedded_documents(), tables.vector_queries(), 20))
    found = by_query(catalog.QUERIES["g3_vector_top_approx"](spark, small))
    hits = sum(len(set(exact[q]) & set(found.get(q, []))) for q in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    found = [row[0] for row in rows.select(vector.cosine_similarity("a", "b")).collect()]
    assert found == [pytest.approx(2**-0.5), None]


# --- fusion -----------------------------------------------------------------


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, score double, rank int")


def test_rrf(spark):
    left = ranked(spark, [(1, 10, 5.0, 1), (1, 11, 4.0, 2)])
    right = ranked(spark, [(1, 11, 0.9, 1), (1, 12, 0.8, 2), (2, 10, 0.1, 1)])
    fused = fusion.rrf_fuse({"a": (left, "score"), "b": (right, "score")}, 60)
    found = {(row["query_id"], row["id"]): row for row in fused.collect()}
    assert found[1, 11]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)
    assert found[1, 10]["rrf_score"] == pytest.approx(1 / 61) and found[1, 10]["b"] is None
    swapped = fusion.rrf_fuse({"b": (right, "score"), "a": (left, "score")}, 60)
    assert {(r["query_id"], r["id"]): r["rrf_score"] for r in swapped.collect()} == {k: r["rrf_score"] for k, r in found.items()}
    assert "Join" not in plan_of(fused)
    page = fusion.fused_page(fused, ["a", "b"], size=1, offset=1).collect()
    assert [(row["query_id"], row["id"], row["rank"]) for row in page] == [(1, 10, 2)]


def test_rank_positions(spark):
    rows = spark.createDataFrame([(1, 5, None), (1, 4, 0.5), (1, 3, 0.5), (1, 2, 0.9)], "query_id long, id long, score double")
    found = {row["id"]: row["rank"] for row in fusion.rank_positions(rows, "score").collect()}
    assert found == {2: 1, 3: 2, 4: 3, 5: 4}


# --- policy for searches without a type --------------------------------------

CASES = [
    ("forskrift x", {"Lov": 10, "Forskrift": 5}, "Forskrift"),
    ("forskrift x", {"Lov": 10, "Forskrift": 2, "Vedtak": 5}, "Vedtak"),
    ("forskrift x", {"Lov": 10, "Forskrift": 2, "Vedtak": 4}, "Forskrift"),
    ("forskrift x", {"Lov": 2}, "Lov"),
    ("en lov x", {"Lov": 1, "Forskrift": 9, "Instruks": 6}, "Instruks"),
    ("en lov x", {"Forskrift": 2, "Instruks": 6}, "Forskrift"),
    ("x", {"Lov": 1, "Forskrift": 9, "Vedtak": 9}, "Lov"),
    ("x", {"Forskrift": 1, "Vedtak": 9}, "Forskrift"),
    ("x", {"Vedtak": 1, "Instruks": 2, "Reglement": 3, "Vedlegg": 4}, "Reglement"),
    ("x", {"Instruks": 1}, "Instruks"),
    ("x", {"Vedtak": 4, "Vedlegg": 5}, "Vedlegg"),
    ("x", {}, None),
    ("forskriften x", {"Lov": 4, "Forskrift": 9}, "Lov"),
]


def test_priority_policy(spark):
    queries = spark.createDataFrame([(at, case[0]) for at, case in enumerate(CASES)], "query_id long, text string")
    rows = [(at, kind, n) for at, case in enumerate(CASES) for kind, count in case[1].items() for n in range(count)]
    hits = spark.createDataFrame(rows, "query_id long, law_type string, id long")
    picked = {row["query_id"]: row["picked"] for row in ranking.prioritized_search(queries, hits, 10).collect()}
    assert [picked[at] for at in range(len(CASES))] == [case[2] for case in CASES]


# --- rerank -------------------------------------------------------------------


def hit_rows(spark, n=120):
    rows = [(1, at + 1, "alpha beta", f"t{at}", "alpha" if at == 70 else "gamma" if at != 3 else None) for at in range(n)]
    rows[3] = (1, 4, "alpha beta", None, "  ")
    return spark.createDataFrame(rows, "query_id long, rank int, query string, title string, snippet string")


def test_rerank_default(spark):
    found = ranking.rerank(hit_rows(spark), size=3, extra=5).orderBy("rank").collect()
    assert [row["index"] for row in found] == [70, 0, 1, 2, 4, 5, 6, 7]


def test_rerank_with_a_scorer(spark):
    scorer = lambda queries, texts: [float(text[1:].split()[0]) for text in texts]
    found = ranking.rerank(hit_rows(spark), scorer, size=1, extra=5, candidates=100).orderBy("rank").collect()
    assert [row["index"] for row in found] == [99, 98, 97, 96, 95, 94]  # only the first hundred are scored


def test_failing_scorer_keeps_the_order(spark):
    def broken(queries, texts):
        raise RuntimeError("down")

    found = ranking.rerank(hit_rows(spark), broken, size=1, extra=5).orderBy("rank").collect()
    assert [row["index"] for row in found] == [0, 1, 2, 4, 5, 6]


def test_search_page(spark):
    """Pages follow each other without gaps, reach beyond the usual candidates, and blank rows are no hits."""
    titles = ["Lov om endring", "Lov 4. juli 1991 nr. 47 om ekteskap", None, "Vedtak"]
    rows = spark.createDataFrame(
        [(at, f"ekteskap {'ekteskap ' * (at % 5)}rad {at}" if at != 7 else " ", f"a{at}", f"m{at}.xml", titles[at % 4]) for at in range(90)],
        "id long, content string, archive_filename string, member string, document_title string",
    )
    asked = spark.createDataFrame([(1, "ekteskap")], "query_id long, text string")
    corpus = search.index_corpus(rows)
    tier = lambda row: {0: 2, 1: 0}.get(row["id"] % 4, 1)

    def pages(**options):
        return [search.search_page(corpus, asked, 30, page, "https://v", **options).orderBy("rank").collect() for page in (1, 2, 3)]

    plain = pages(reranked=False)
    everything = [row for page in plain for row in page]
    assert [row["rank"] for row in everything] == list(range(1, 90)) and {row["id"] for row in everything} == {*range(90)} - {7}
    first = pages()[0]
    assert [row["rank"] for row in first] == list(range(1, 31)) and list(map(tier, first)) == sorted(map(tier, first))
    assert first[0]["title"] == titles[1] and first[0]["url"] == f"https://v/api/documents/xml?filename=a{first[0]['id']}&member=m{first[0]['id']}.html"
    # A scorer that fails leaves the boosted order.
    failing = pages(scorer=lambda asked, texts: [])[0]
    assert list(map(tier, failing)) == sorted(map(tier, failing))


def test_scores_of_a_group_are_bounded():
    import tracemalloc

    import pandas as pd

    drawn = np.random.default_rng(1)
    data, asked = drawn.standard_normal((20_000, 8)), drawn.standard_normal((400, 8))
    rows = pd.DataFrame({"id": drawn.permutation(20_000), "embedding": list(data), "year": np.arange(20_000) % 3})
    queries = pd.DataFrame({"query_id": np.arange(400), "filter_year": [None if at % 2 else at % 3 for at in range(400)]})
    asked = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    tracemalloc.start()
    cut = vector._best(rows, queries, asked, 7, ["year"], cells=400 * 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # all scores at once have 64 MB, and their order as much again
    whole = vector._best(rows, queries, asked, 7, ["year"], cells=400 * 20_000)
    order = ["query_id", "similarity", "id"]
    listed = lambda best: best.sort_values(order).reset_index(drop=True).to_dict("list")
    assert listed(cut) == listed(whole) and len(cut) == 400 * 7


def test_words_alone_are_sorted_without_positions(spark, chunks):
    built = lexical.build_postings(chunks, positions=False)
    assert "sort_array(words" in plan_of(built)
    expected = {(at, word, body.split().count(word), len(body.split())) for at, body in enumerate(TEXTS) for word in body.split()}
    found = built.select("id", "token", "tf", "n_tokens").collect()
    assert len(found) == len(expected) and set(map(tuple, found)) == expected


def test_texts_of_chunks_do_not_move_to_their_vectors(spark, tmp_path):
    from conftest import plan_of

    from lexweave.catalog import searching
    from lexweave.catalog.base import Tables
    from lexweave.operators import chunking

    docs = [(1, "lov om " * 400), (2, "kort tekst"), (2, "en annen tekst"), (3, "uten vektor"), (None, "uten id"), (4, None)]
    docs = [(at, content, "no", "src1", len(content or "")) for at, content in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, None), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = Tables(spark, str(tmp_path))
    keyed = t.read("embeddings").selectExpr("vec_id AS document_id", "0 AS chunk_index", "embedding")
    joined = chunking.chunk_documents(t.documents(), 1000).join(keyed, ["document_id", "chunk_index"], "left").collect()
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, embedded = searching.embedded_chunks(t)
        assert "hashpartitioning" not in plan_of(rows)  # what tasks are dealt by key
        names = ["id", "document_id", "chunk_index", "content", "law_type", "start_char"]
        listed = lambda found: sorted(repr([row[name] for name in names]) for row in found)
        assert listed(rows.collect()) == listed(joined)
        pairs = lambda found: sorted(repr((row["id"], row["embedding"], row["law_type"])) for row in found if row["embedding"] is not None)
        assert pairs(embedded.collect()) == pairs(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)


def test_words_outside_the_candidates_stay_where_they_are(spark):
    from lexweave.operators import lexical

    rows = spark.range(40_000).selectExpr("id", "id % 7 AS term_id", "cast(id as string) AS token")
    others = spark.range(0, 40_000, 40).selectExpr("id", "id % 7 AS term_id").unionByName(spark.sql("SELECT cast(null as bigint) id, 1L term_id"))
    exact = {row["id"] for row in rows.join(others, ["id", "term_id"]).collect()}
    for most in (lexical.MAX_BITS, 1 << 10):
        found = lexical.possibly_among(rows, others, ["id", "term_id"], most)
        kept = found.collect()
        assert found.columns == rows.columns and exact <= {row["id"] for row in kept}
        assert len(exact) == 1_000 and len(kept) == len({row["id"] for row in kept}) <= 2_500
    assert lexical.possibly_among(rows, others.where("id < 0"), ["id"]).count() == 0
    named = rows.selectExpr("token AS id", "term_id")
    assert lexical.possibly_among(named, named.where("term_id = 3"), ["id"]).where("term_id = 3").count() == rows.where("term_id = 3").count()
