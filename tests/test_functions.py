"""Unit tests of column functions and codecs."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.config import AnalyzerConfig, Config, SkipConfig, update
from loomtext.functions import codec as C
from loomtext.functions import text as X
from loomtext.operators.skips import merge_with_skips
from loomtext.sources import binary as B


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_removal_reasons(spark):
    cases = {
        "___": "underscores_only", ",": "underscores_only", "日本": "underscores_only", "http": "special", "a@b": "special", "x.com": "special", "été": None,
        "don't": "punctuation", "well-known": "punctuation", "abc1": "number", "the": "stopword", "x": "short", "new_york": None, "music": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.removal_reason(F.col("t"), AnalyzerConfig()).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == cases


def test_clean_markup(spark):
    texts = [("a<br/>b<p>c</p>d<b>e</b>",), ("<P>x</P>\n \n\n\ny  ",), (None,)]
    assert values(spark, texts, "t string", X.clean_markup(F.col("t"))) == ["a\nb\nc\nde", "x\n\ny", None]


def test_merge_phrases_keeps_lexicon_order(spark):
    rows = [("A b c d",), ("a  b c",), ("b c a b",)]
    assert values(spark, rows, "t string", X.merge_phrases(F.col("t"), ["a b", "b c"])) == ["a_b c d", "a  b_c", "b_c a_b"]
    many = [f"w{i} x{i}" for i in range(80)] + ["a b", "b c"]
    assert values(spark, rows, "t string", X.merge_phrases(F.col("t"), many)) == ["a_b c d", "a  b_c", "b_c a_b"]


@pytest.mark.parametrize("size", [0, 100])
def test_merge_phrases_has_one_rule(spark, size):
    """Word boundaries, signs and order are the same for lexicons of any size."""
    phrases = ["don't know", "a $1 b", "c++ code", "é è", "new_york times", "new york"] + [f"filler{i} word" for i in range(size)]
    rows = [("I DON'T KNOW it",), ("a $1 b and xa $1 b",), ("c++ code",), ("É è",), ("the new york times",), ("filler7 word",), (None,), ("",)]
    got = values(spark, rows, "t string", X.merge_phrases(F.col("t"), phrases))
    assert got == ["i don't_know it", "a_$1_b and xa $1 b", "c++_code", "é_è", "the new_york_times", "filler7_word" if size else "filler7 word", None, ""]


#: Examples that the published description of the algorithm gives, or that follow from its rules by hand.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll oscillators oscil generalizations gener""".split()


@pytest.mark.parametrize(("word", "stem"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_porter(word, stem):
    assert X.porter(word) == stem


def test_treebank(spark):
    rows = [("Don't they're, well-known (U.S.) e.g. $5.50 -- ok...",), ("",), (None,)]
    assert values(spark, rows, "t string", X.tokens(F.col("t"), "treebank")) == [
        ["do", "n't", "they", "'re", ",", "well-known", "(", "u.s", ".", ")", "e.g", ".", "$", "5.50", "--", "ok", "..."], [], None,
    ]


def test_sizes_round_halves_to_even(spark):
    rows = [(1023,), (1024,), (1152,), (1408,), (1 << 20,), ((1 << 20) * 9 // 8,)]
    assert values(spark, rows, "n long", X.shown_size(F.col("n"))) == ["1023 B", "1.00 KB", "1.12 KB", "1.38 KB", "1.00 MB", "1.12 MB"]


def test_cube_root_steps(spark):
    config = SkipConfig(strategy="cbrt")
    lengths = sorted({n for c in range(2, 120) for n in (c**3 - 1, c**3, c**3 + 1) if n >= 3})
    # A correctly rounded power is what the platform gives for all of these.
    expected = [max(1, int(n ** (1 / 3))) for n in lengths]
    assert [C.skip_step_of(n, config) for n in lengths] == expected
    df = spark.createDataFrame([(n,) for n in lengths], "n long")
    assert [r[0] for r in df.select(C.skip_step(F.col("n"), config)).collect()] == expected


def test_log_steps_at_powers_of_two(spark):
    config, lengths = SkipConfig(strategy="log"), [n for k in range(2, 45) for n in (2**k - 1, 2**k, 2**k + 1)]
    df = spark.createDataFrame([(n,) for n in lengths], "n long")
    assert [r[0] for r in df.select(C.skip_step(F.col("n"), config)).collect()] == [n.bit_length() - 1 for n in lengths] == [C.skip_step_of(n, config) for n in lengths]


def test_running_sums_of_long_lists(spark):
    rows = [([1] * 50_000,), ([],), (None,), ([5, 0, 7],)]
    got = values(spark, rows, "g array<bigint>", C.ungaps(F.col("g")))
    assert got == [list(range(1, 50_001)), [], None, [5, 5, 12]]


def test_display(spark):
    df = spark.createDataFrame([("Hello, wörld of - text_here", 2048)], "t string, n long")
    row = df.select(X.file_slug(F.col("t")), X.shown_size(F.col("n")), X.shown_term(F.lit("x" * 30)), X.doc_number(F.lit("event_12"))).first()
    assert tuple(row) == ("Hello_wörld_of_-_te", "2.00 KB", "x" * 25 + "...", 12)


@pytest.mark.parametrize(("n", "code"), [(5, "85"), (130, "0182"), (0, "80"), (125, "FD"), (16384, "010080"), (10000527, "0462318F"), (268435455, "7F7F7FFF")])
def test_vb_vectors(spark, n, code):
    assert spark.range(1).select(C.vb_hex(F.lit(n).cast("long"))).first()[0] == code
    assert C.encode_vb([n]).hex().upper() == code


@given(st.lists(st.integers(0, 2**34)))
def test_vb_round_trip(numbers):
    assert C.decode_vb(C.encode_vb(numbers))[0] == numbers


def test_gaps(spark):
    df = spark.createDataFrame([([5, 10, 15, 23],), ([],)], "a array<long>")
    assert [r[0] for r in df.select(C.gaps(F.col("a"))).collect()] == [[5, 5, 5, 8], []]
    assert [r[0] for r in df.select(C.ungaps(C.gaps(F.col("a")))).collect()] == [[5, 10, 15, 23], []]


@pytest.mark.parametrize(("strategy", "steps"), [("sqrt", (10, 31, 100)), ("log", (6, 9, 13)), ("linear", (10, 100, 1000)), ("cbrt", (4, 9, 21)), ("fixed", (10, 10, 10))])
def test_skip_steps(spark, strategy, steps):
    config = SkipConfig(strategy=strategy, step=10 if strategy == "fixed" else None)
    df = spark.createDataFrame([(100,), (1000,), (10000,)], "n long")
    assert tuple(r[0] for r in df.select(C.skip_step(F.col("n"), config)).collect()) == steps
    assert tuple(C.skip_step_of(n, config) for n in (100, 1000, 10000)) == steps


sorted_ids = st.lists(st.integers(0, 300), unique=True).map(sorted)


@given(sorted_ids, sorted_ids, st.integers(1, 9))
def test_merge_with_skips_is_intersection(a, b, step):
    assert merge_with_skips(a, b, step)[0] == sorted(set(a) & set(b))


@given(sorted_ids)
def test_skip_form_round_trip(ids):
    config = SkipConfig()
    data = B.encode_skips(ids, config)
    back, pointers = B.decode_skips(data, len(ids), config)
    assert back == ids
    for place, target, offset in pointers:
        assert ids[place] < target
        assert int.from_bytes(data[offset : offset + 4], "little") == target


@given(st.lists(st.tuples(st.integers(0, 2**31), st.lists(st.integers(1, 65535), unique=True).map(sorted)), unique_by=lambda x: x[0]))
def test_positional_form_round_trip(docs):
    assert B.decode_positions(B.encode_positions(docs)) == dict(docs)


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0", exclude_categories=("Cs",)), min_size=1, max_size=40), unique=True).map(sorted), st.integers(1, 6))
def test_compressed_dictionary_round_trip(tmp_path_factory, terms, k):
    path = str(tmp_path_factory.mktemp("d") / "c.bin")
    B.write_compressed_dictionary([(t, i, 7 * i) for i, t in enumerate(terms)], path, k)
    assert B.read_compressed_dictionary(path) == {t: (i, 7 * i) for i, t in enumerate(terms)}


def test_config_merge():
    config = update(Config(), {"retrieval": {"top_k": 3}, "index": {"skip": {"strategy": "log"}}})
    assert (config.retrieval.top_k, config.retrieval.tfidf_method, config.index.skip.strategy) == (3, "standard", "log")
    with pytest.raises(KeyError):
        update(config, {"nothing": 1})


def test_merge_phrases_shared_sign(spark):
    rows = [("of the of the a",), ("x of the,of the",), ("of thee",)]
    assert values(spark, rows, "t string", X.merge_phrases(F.col("t"), ["of the"])) == ["of_the of_the a", "x of_the,of_the", "of thee"]
    assert values(spark, rows, "t string", X.merge_phrases(F.col("t"), ["of the"], shared=False)) == ["of_the of the a", "x of_the,of the", "of thee"]
