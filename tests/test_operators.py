"""Boolean, phrase, ranked and index operators on small corpora."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from loomtext import queries
from loomtext.config import AnalyzerConfig, SkipConfig
from loomtext.operators import analysis, boolean, index, phrase, ranking, reports, skips, workload
from loomtext.plans import boolean_ast as A
from loomtext.sources import binary

WORDS = "abcdef"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice(WORDS[: 2 + i % 5]) for _ in range(rng.randint(1, 12))]) for i in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, tokens array<string>").cache()


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


QUERIES = ["a AND b", "a OR (b AND NOT c)", "NOT a", "NOT (a OR b)", "(a AND b) OR (c AND d)", "((a AND b) OR c) AND NOT d", "a AND zz", "a OR zz", "NOT NOT e", "a AND NOT a", "A and" if False else "A AND  B"]


@pytest.mark.parametrize("text", QUERIES)
def test_boolean_plans_agree_with_brute_force(corpus, text):
    rows, df = corpus
    posting = index.postings(df)
    expected = sorted(i for i, t in rows if A.holds(A.parse(text), set(t)))
    for plan, optimize in itertools.product(("set", "flag"), (False, True)):
        assert ids(boolean.search(text, posting, plan=plan, optimize=optimize)) == expected


def test_flat_reading(corpus):
    rows, df = corpus
    posting = index.postings(df)
    assert ids(boolean.flat_search("a AND b OR c", posting)) == [i for i, t in rows if {"a", "b", "c"} <= set(t)]
    assert ids(boolean.flat_search("a OR zz", posting)) == [i for i, t in rows if "a" in t]
    assert boolean.decode_count("a AND zz AND b", {"a", "b"}) == 1


@pytest.mark.parametrize("text", ["a b", "(a", "AND a", "a NOT b", "a)"])
def test_parse_errors(text):
    with pytest.raises(A.QueryError):
        A.parse(text)


def test_phrases_and_proximity(corpus):
    rows, df = corpus
    occ = index.occurrences(df).cache()
    joined = {i: " " + " ".join(t) + " " for i, t in rows}
    for text in ("a b", "b b", "a b a", "c d e", "a zz"):
        expected = [i for i, t in joined.items() if f" {text} " in t]
        assert ids(phrase.phrase(text.upper(), occ)) == expected
        assert ids(phrase.phrase_by_join(text, occ)) == expected
    for k in (1, 2, 5):
        expected = [i for i, t in rows if any(abs(p - q) <= k for p, x in enumerate(t) for q, y in enumerate(t) if (x, y) == ("a", "d"))]
        assert ids(phrase.proximity("a", "d", k, occ)) == expected


@pytest.mark.parametrize("method", list(ranking.METHODS))
def test_ranking(spark, corpus, method):
    import math

    rows, df = corpus
    queries = spark.createDataFrame([(1, ["a", "e", "a"]), (2, ["zz"]), (3, []), (4, ["f"])], "qid long, tokens array<string>")
    got = ranking.search(queries, index.term_frequencies(df), 7, 0.0, method).collect()
    n, freq = len(rows), {w: sum(w in t for _, t in rows) for w in WORDS}

    def vector(tokens):
        tf = {w: tokens.count(w) for w in tokens if freq.get(w)}
        part = {"standard": lambda x: x, "log": lambda x: 1 + math.log(x), "augmented": lambda x: 0.5 + 0.5 * x / max(tokens.count(w) for w in tokens), "binary": lambda x: 1}[method]
        return {w: part(x) * math.log(n / freq[w]) for w, x in tf.items()}

    for qid, tokens in ((1, ["a", "e", "a"]), (2, ["zz"]), (4, ["f"])):
        q = vector(tokens)
        scored = []
        for i, t in rows:
            d = vector(t)
            norm = math.sqrt(sum(x * x for x in q.values()) * sum(x * x for x in d.values()))
            s = sum(x * d.get(w, 0) for w, x in q.items()) / norm if norm else 0.0
            scored.append((-math.floor(s * 1e6 + 0.5) / 1e6, i))
        expected = [(r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:7], 1)]
        assert sorted((r["rank"], r["doc_id"], r["similarity"]) for r in got if r["qid"] == qid) == expected
    assert not [r for r in got if r["qid"] == 3]


def test_dictionary_numbers_across_partitions(spark, corpus):
    rows, df = corpus
    got = {r["term"]: r for r in index.dictionary(index.postings(df)).collect()}
    text = binary = 0
    for ordinal, w in enumerate(sorted({w for _, t in rows for w in t}), 1):
        docs = [i for i, t in rows if w in t]
        assert (got[w]["ordinal"], got[w]["text_pointer"], got[w]["binary_pointer"], got[w]["doc_freq"]) == (ordinal, text, binary, len(docs))
        text += sum(len(str(i)) + 1 for i in docs)
        binary += 4 * len(docs)


@pytest.mark.parametrize("partitions", [8, 64, 200])
def test_ordinals_and_pointers_of_many_ranges(spark, partitions):
    """200,000 terms in several ranges: every ordinal once, pointers as running sums, with all columns read and with one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        terms = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("term"), (F.col("id") % 97 + 1).alias("size"))
        out = index._numbered(terms, ["size"])
        rows = sorted(map(tuple, out.select("term", "size", "n_terms", "ordinal", "size_before").collect()))
        place = 0
        for n, (_, size, total, ordinal, pointer) in enumerate(rows, 1):
            assert (ordinal, pointer, total) == (n, place, len(rows))
            place += size
        assert out.select("ordinal").distinct().count() == len(rows) == 200_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_skip_pointers(corpus):
    rows, df = corpus
    lists = index.index_lists(index.postings(df))
    found = skips.skip_pointers(lists, SkipConfig()).collect()
    for row in lists.collect():
        docs, step = row["doc_ids"], max(1, int(row["df"] ** 0.5))
        expected = [(i, min(i + step, len(docs) - 1)) for i in range(step - 1, len(docs) - 1, step)] if len(docs) >= 3 else []
        own = sorted((r["pos"], r["target_pos"]) for r in found if r["term"] == row["term"])
        assert own == expected
        assert all(r["target_doc_id"] == docs[r["target_pos"]] for r in found if r["term"] == row["term"])


@pytest.mark.parametrize("block", [1 << 20, 7, 1])
def test_gaps_carry_from_block_to_block(corpus, block):
    rows, df = corpus
    posting = index.postings(df)
    lists = {w: sorted(i for i, t in rows if w in t) for w in WORDS}
    expected = sorted((w, i // block, i, i - before) for w, ids_ in lists.items() for before, i in zip([0, *ids_], ids_, strict=False))
    assert sorted(tuple(r) for r in index.gap_rows(posting, block).collect()) == expected
    code = {}
    for r in sorted(index.encoded_blocks(posting, block).collect(), key=lambda r: r["block"]):
        code[r["term"]] = code.get(r["term"], b"") + bytes(r["vb"])
    assert code == {r["term"]: bytes(r["vb"]) for r in index.encoded_lists(index.index_lists(posting)).collect()}


@pytest.mark.parametrize("text", ["a AND b AND c", "((a AND b) OR c) AND NOT d", "NOT a AND NOT b", "a AND zz", "NOT zz"])
@pytest.mark.parametrize("block", [1 << 20, 16])
def test_search_over_skip_pointers(corpus, text, block):
    """Matches and counters, against a merge by hand over the lists of each block."""
    rows, df = corpus
    got = skips.search_with_skips(text, index.postings(df), SkipConfig(), block).collect()
    assert sorted(i for r in got for i in r["doc_ids"]) == sorted(i for i, t in rows if A.holds(A.parse(text), set(t)))
    if text == "a AND b AND c":
        compared = jumps = 0
        for number in {i // block for i, _ in rows}:
            lists = sorted(([i for i, t in rows if w in t and i // block == number] for w in "abc"), key=len)
            done = lists[0]
            for other in lists[1:]:
                step, i, j, found = int(len(other) ** 0.5) if len(other) >= 3 else 0, 0, 0, []
                while i < len(done) and j < len(other):
                    compared += 1
                    if done[i] == other[j]:
                        found, i, j = [*found, done[i]], i + 1, j + 1
                    elif done[i] < other[j]:
                        i += 1
                    else:
                        start = j
                        while step > 1 and j % step == step - 1 and j + 1 < len(other):
                            compared += 1
                            if other[min(j + step, len(other) - 1)] > done[i]:
                                break
                            j, jumps = min(j + step, len(other) - 1), jumps + 1
                        j += j == start
                done = found
        assert (sum(r["comparisons"] for r in got), sum(r["jumps"] for r in got)) == (compared, jumps)


def test_compressed_search(corpus):
    rows, df = corpus
    encoded = index.encoded_lists(index.index_lists(index.postings(df)))
    size = {r["term"]: len(r["vb"]) for r in encoded.collect()}
    assert ids(boolean.compressed_search("a AND b AND c", encoded)) == sorted(i for i, t in rows if {"a", "b", "c"} <= set(t))
    assert ids(boolean.compressed_search("e OR zz", encoded)) == sorted(i for i, t in rows if "e" in t)
    assert tuple(boolean.decoded_lists("a AND zz AND b", encoded).first()) == (3, 2, 1, size["a"])
    assert tuple(boolean.decoded_lists("a OR zz OR b", encoded).first()) == (3, 2, 2, size["a"] + size["b"])
    assert tuple(boolean.decoded_lists("zz", encoded).first()) == (1, 0, 0, 0)


def test_stored_search_is_the_search(spark, corpus, tmp_path):
    _, df = corpus
    index.write_index(df, str(tmp_path))
    tables = index.read_index(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, ["a", "e", "a"]), (2, ["zz"]), (3, []), (4, ["f"])], "qid long, tokens array<string>")
    picked = ranking.pick_terms(queries, tables)
    plan = picked["tf"]._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan
    for method in ranking.METHODS:
        for least in (0.0, 0.1):
            expected = sorted(map(tuple, ranking.search(queries, index.term_frequencies(df), 7, least, method).collect()))
            assert sorted(map(tuple, ranking.search_stored(queries, picked, 7, least, method).collect())) == expected
            assert sorted(map(tuple, ranking.search_stored(queries, tables, 7, least, method).collect())) == expected


def test_analysis(spark):
    docs = spark.createDataFrame([(1, "The running dogs, don't run HTTP"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in analysis.analyze(docs).collect()} == {1: ["running", "dogs", "don", "run"], 2: None, 3: []}
    stems = analysis.analyze(docs, AnalyzerConfig(lemmatize=False, stem=True)).collect()
    assert {r["doc_id"]: r["tokens"] for r in stems}[1] == ["run", "dog", "don", "run"]
    occ = index.occurrences(analysis.analyze(docs))
    lexicon = spark.createDataFrame([("dogs", "n", "dog"), ("running", "v", "run")], "surface string, tag string, lemma string")
    assert {r["pos"]: r["term"] for r in analysis.lemmatized(occ, lexicon).collect()} == {1: "running", 2: "dog", 3: "don", 4: "run"}


def test_workloads_and_reports(spark, corpus, tmp_path):
    _, df = corpus
    posting = index.postings(df).cache()
    made = workload.dictionary_queries(posting)
    assert made and all(A.parse(q) for q in made)
    assert set(workload.comprehensive_queries(posting, "not")) <= set(made)
    same = reports.compare(made[:3], lambda q: boolean.search(q, posting), lambda q: boolean.search(q, posting, plan="set"))
    assert all(r["equal"] for r in same)
    assert workload.differences(posting, posting).count() == 0
    some = posting.where("term <> 'a'")
    lost = posting.count() - some.count()
    assert tuple(workload.consistency(posting, some).first()) == (posting.count(), some.count(), lost) and lost > 0
    assert tuple(workload.consistency(some.limit(0), some.limit(0)).first()) == (0, 0, 0)
    queries = spark.createDataFrame([(1, "a e", ["a", "e"])], "qid long, text string, tokens array<string>")
    results = ranking.search(queries, index.term_frequencies(df), 3)
    assert len(reports.save_results(results, queries, str(tmp_path))) == 1
    (text,) = reports.save_results(results, queries, str(tmp_path), "txt")
    assert open(text, encoding="utf-8").read().startswith("Query: a e\nResults: 3\n1. document ")
    said = reports.save_comparison(same, str(tmp_path / "report.json"))
    assert json.load(open(tmp_path / "report.json"))["summary"]["agreeing"] == 3 and "agreeing: 3" in said
    assert reports.summary([])["average_seconds"] is None
    assert "Query 1: a e (3 results)" in reports.retrieval_report(results, queries, {})
    assert ranking.with_matches(results, queries, df).select(F.max("match_count")).first()[0] >= 1


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("make", [index.term_frequencies, index.postings, index.positional_postings])
def test_texts_are_tokenised_once(spark, make):
    docs = analysis.analyze(spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string"))
    assert plan_of(make(docs)).count("regexp_extract_all") == 1


def test_positions_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, []), (1, ["b", "b", "a"]), (None, ["a"]), (3, None), (None, ["a"])], "doc_id long, tokens array<string>")
    got = sorted((r["term"], str(r["doc_id"]), r["tf"], r["positions"]) for r in index.positional_postings(docs).collect())
    assert got == [("a", "1", 2, [1, 3]), ("a", "None", 2, [1, 1]), ("b", "1", 3, [1, 2, 2])]


def test_gaps_read_their_rows_once(corpus):
    _, df = corpus
    assert "Union" not in plan_of(index.gap_rows(index.postings(df), 16))


def test_encoded_positions_of_a_long_list(spark):
    docs = [(3 * i + 1, [1 + i % 3, 200]) for i in range(5000)]
    rows = spark.createDataFrame([("a", d, len(p), p) for d, p in docs], "term string, doc_id long, tf long, positions array<long>")
    out = index.encoded_positions(rows)
    assert "rows.doc_id" not in out._jdf.queryExecution().analyzed().toString()
    assert bytes(out.first()["vb"]) == binary.encode_positions_vb(docs)


def test_norms_join_documents_once(spark, corpus):
    _, df = corpus
    tf = index.term_frequencies(df)
    assert plan_of(ranking.document_weights(tf, "augmented")).count("Join") == 2
    by_hand = {r["doc_id"]: r["norm"] for r in ranking.document_weights(tf, "augmented").groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).collect()}
    norms = {r["doc_id"]: r["norm"] for r in ranking.document_norms(tf, "augmented").collect()}
    assert norms.keys() == by_hand.keys() and all(abs(norms[d] - by_hand[d]) < 1e-9 for d in norms)


def test_search_without_stored_tables_reads_parquet(spark, corpus):
    _, df = corpus
    tables = ranking.statistics(index.term_frequencies(df))
    assert "parquet" in plan_of(tables["tf"]) and "parquet" in plan_of(tables["doc_stats"])


def test_tags_of_whole_documents(spark):
    tokens = spark.createDataFrame([(1, 1, "runs"), (1, 2, "dogs"), (2, 1, "runs")], "doc_id long, pos long, term string")
    lexicon = spark.createDataFrame([("runs", "v", "run"), ("dogs", "n", "dog")], "surface string, tag string, lemma string")
    tags = spark.createDataFrame([(1, "VBZ")], "doc_id long, tag string")
    assert sorted(map(tuple, analysis.lemmatized(tokens, lexicon, tags).collect())) == [(1, 1, "run"), (1, 2, "dogs"), (2, 1, "runs")]


def test_consistency_tokenises_once_a_plan(spark):
    assert plan_of(queries.QUERIES["compare_consistency"](spark, "/root/testdata/sf0.001")).count("regexp_extract_all") <= 1


@pytest.mark.parametrize("most", [0, 2, 1 << 17])
def test_norms_with_frequent_and_rare_terms(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(ranking, "FREQUENT_TERMS", most)
    _, df = corpus
    tf = index.term_frequencies(df)
    for method in ranking.METHODS:
        by_hand = {r["doc_id"]: r["norm"] for r in ranking.document_weights(tf, method).groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).collect()}
        norms = {r["doc_id"]: r["norm"] for r in ranking.document_norms(tf, method).collect()}
        assert norms.keys() == by_hand.keys() and all(abs(norms[d] - by_hand[d]) < 1e-9 for d in norms)


def test_norms_look_up_frequent_terms_without_a_shuffle(spark, corpus):
    _, df = corpus
    plan = ranking.document_norms(index.term_frequencies(df))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(term" not in plan and "SortMergeJoin" not in plan


def test_searches_meet_few_query_terms_without_a_shuffle(spark, corpus):
    _, df = corpus
    tables = ranking.statistics(index.term_frequencies(df))
    queries = spark.createDataFrame([(1, ["a", "e", "a"])], "qid long, tokens array<string>")
    assert "hashpartitioning(term" not in ranking.scores(queries, tables)._jdf.queryExecution().executedPlan().toString()


def test_index_positions_move_as_short_numbers(spark, corpus, tmp_path, monkeypatch):
    kinds, (_, df) = [], corpus
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *a, f=type(df).repartitionByRange: kinds.append(dict(self.dtypes)) or f(self, *a))
    index.write_index(df, str(tmp_path))
    assert kinds[0] == {"term": "string", "doc_id": "bigint", "positions": "array<int>"}
    key = lambda r: (r["term"], r["doc_id"], r["tf"], r["positions"])
    stored = spark.read.parquet(str(tmp_path / "positions"))
    expected = index.positional_postings(df)
    assert dict(stored.dtypes) == dict(expected.dtypes) and sorted(map(key, stored.collect())) == sorted(map(key, expected.collect()))
