"""Goldens and properties of the scalar and pairwise functions."""

from __future__ import annotations

import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_normalise():
    assert T.normalize("  ＡＢＣ, Straße—No. 5 ") == "abc strasse no 5"
    assert T.normalize(None) == "" and T.normalize("a&b") == "a b"
    assert T.audit_normalize("A & B_c!") == "a and b c"
    assert T.fold_latin("Élan ñ") == "Elan n"
    assert T.fold_latin("हिन्दी") == "हिन्दी"


def test_normalise_column(spark):
    assert one(spark, "Ünï—x", T.normalize_text) == "ünï x"
    assert one(spark, None, T.normalize_text) == ""


def test_suffixes(spark):
    cases = {"acme pvt ltd": "acme", "limited": "limited", "private limited": "private", "acme corp ltd inc": "acme corp ltd inc", "a ltd pvt corp": "a ltd"}
    for value, want in cases.items():
        assert one(spark, value, T.strip_legal_suffix) == want


def test_tokens(spark):
    assert one(spark, "a bb cc bb", T.name_tokens) == ["bb", "cc"]
    assert one(spark, "12 rue 007 x 12 0 99 5", T.record_digits) == ["12", "7", "0", "99"]
    assert one(spark, "5 main st 12 main road", T.record_address_tokens) == ["main", "st", "road"]
    assert one(spark, "the acme co of paris", T.token_codes) == ["acme", "paris"]
    assert one(spark, "12 x 12 1234567890123", T.number_codes) == [12, zlib.crc32(b"1234567890123")]
    assert one(spark, None, T.name_tokens) == []


def test_street(spark):
    assert one(spark, "12 bis av. de la Liberté", T.street_text) == "avenue de la liberte"
    assert one(spark, "no 5 main rd", T.street_text) == "main road"
    assert one(spark, "x 0012 y 5", T.first_number) == 12
    assert one(spark, "1234567890123", T.first_number) == -1 and one(spark, "", T.first_number) == -1


def test_scripts_and_ids(spark):
    got = [one(spark, v, T.script_code) for v in ("12 abc", "हि", "12", "été", "ж", "ب", None)]
    assert got == [0, 1, 0, 0, 11, 10, 0]
    assert [one(spark, v, T.first_foreign_script) for v in ("abc é", "abc", "abc हि", "a ж")] == ["LATIN", "LATIN", "DEVANAGARI", "OTHER"]
    assert one(spark, "S3-17", T.encode_id) == 35
    assert spark.range(1).select(T.decode_id(F.lit(35)).alias("x")).first()["x"] == "S3-17"
    assert one(spark, "S1-12", lambda c: T.numeric_id(c, "S1")) == 12 and one(spark, "S1-x", lambda c: T.numeric_id(c, "S1")) is None
    assert one(spark, "abc", T.token_hash) == zlib.crc32(b"abc")


def test_similarity_goldens():
    assert S.ratio("abc", "abc") == 100 and S.ratio("", "") == 100 and S.ratio("abc", "") == 0
    assert round(S.ratio("kitten", "sitting"), 4) == round(200 * 4 / 13, 4)
    assert S.token_sort_ratio("b a", "a b") == 100
    assert S.token_set_ratio("acme ltd", "acme") == 100
    assert S.partial_ratio("bcd", "abcde") == 100
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611


def _lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=20), st.text("abcd ", max_size=20))
def test_lcs(a, b):
    assert S.lcs_length(a, b) == _lcs(a, b)
    assert S.ratio(a, b) == S.ratio(b, a)


def _best_window(short, long):
    n = len(short)
    return max(200 * _lcs(short, long[max(0, k) : k + n]) / (n + len(long[max(0, k) : k + n])) for k in range(1 - n, len(long)))


def _partial(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    return max(_best_window(short, long), _best_window(long, short) if len(a) == len(b) else 0.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc é", max_size=14), st.text("abc é", max_size=18)), min_size=1, max_size=12))
def test_scorers_equal_brute_force(pairs):
    """Blocks of pairs score as single pairs do, and the best window is the best of all windows."""
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    single = {"ratio": S.ratio, "token_sort": S.token_sort_ratio, "token_set": S.token_set_ratio, "partial": S.partial_ratio, "jaro_winkler": lambda x, y: 100 * S.jaro_winkler(x, y)}
    for name, function in single.items():
        assert all(abs(p - function(x, y)) < 1e-9 for p, x, y in zip(S.SCORERS[name](a, b), a, b))
    assert all(abs(S.partial_ratio(x, y) - _partial(x, y)) < 1e-9 for x, y in pairs)
    assert S.lcs_lengths(a, b).tolist() == [_lcs(x, y) for x, y in pairs]


def test_long_texts_equal_brute_force():
    rng = random.Random(4)
    pairs = [("".join(rng.choices("abcd ", k=n)), "".join(rng.choices("abcd ", k=m))) for n, m in ((64, 64), (65, 64), (63, 90), (70, 70), (80, 140), (64, 600))]
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    assert S.lcs_lengths(a, b).tolist() == [_lcs(x, y) for x, y in pairs]
    assert all(abs(p - _partial(x, y)) < 1e-9 for p, x, y in list(zip(S.partial_ratios(a, b), a, b))[:5])


def test_similarities_column(spark):
    df = spark.createDataFrame([("a b", "b a"), ("", "x"), (None, "x"), ("abc", "abd")], "a string, b string")
    sims = df.withColumn("s", S.similarities(["ratio", "token_sort"], F.col("a"), F.col("b")))
    got = [tuple(r) for r in sims.select(*[c.alias(n) for n, c in S.scored("", "s", ["ratio", "token_sort"]).items()]).collect()]
    assert got[0][1] == 100 and got[1] == got[2] == (None, None) and abs(got[3][0] - 200 * 2 / 6) < 1e-9
    assert [r.x for r in df.select(S.similarity("ratio", F.col("a"), F.col("b"), empty_is_null=False).alias("x")).collect()][1] == 0


def test_digits_of_all_scripts(spark):
    assert one(spark, "٣٤ रु १२", T.number_codes) == [34, 12]
    assert one(spark, "x ٠٠٧", T.first_number) == 7


def test_digit_typo(spark):
    df = spark.createDataFrame([(["12", "5"], ["13"]), (["12"], ["12"]), (["12"], ["123"]), ([], ["1"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(S.one_digit_typo(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, False]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(S.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1] is None
