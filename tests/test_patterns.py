"""Which patterns are accepted, and that no match is lost to the pieces they are filed under."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vacantia.functions import patterns as P
from vacantia.operators import stats as A


@pytest.mark.parametrize("pattern", ["([", "(?P<n>x)", r"\p{L}+", "(?i)visa", r"(a)\1", "a++", "(?<=x)y", "a**", "[a&&b]", "[[:alpha:]]", "x{2,1}", "x{9999}",
                                     "a)", "*a", r"\Aab", "[b-a]", "[]a]", None, "(?>a)", r"\k<n>", "^*"])
def test_refused(pattern):
    assert P.needs(pattern) is None


@pytest.mark.parametrize("pattern,needed", [
    ("sponsor", [["nso", "ons", "pon", "sor", "spo"]]), ("^notice.{0,20}period$", [["eri", "ice", "iod", "not", "oti", "per", "rio", "tic"]]),
    ("foo|ba", [["foo"], ["ba"]]), ("(a|bc)d", [["ad"], ["bcd"]]), (".*", [[""]]), ("", [[""]]), ("ab?c", [["a", "c"]]), ("ab+c", [["ab"]]), (r"c\+\+", [["c++"]]),
    (r"\bxyz\b", [["xyz"]]), ("[a-c]d", [["d"]]), ("(?:ab){2}", [["ab"]]), ("a{0}bcd", [["bcd"]]),
])
def test_needed(pattern, needed):
    assert P.needs(pattern) == needed


def test_every_match_holds_what_is_needed():
    r = random.Random(3)
    bits = ["a", "b", "ab", ".", "[ab]", "(a|b)", "(?:ab|c)", "a*", "b+", "c?", "(ab){1,2}", "|", "^", "$", r"\b", r"\w", " "]
    for _ in range(4000):
        pattern = "".join(r.choice(bits) for _ in range(r.randint(1, 6)))
        needed = P.needs(pattern)
        if needed is None:
            continue
        for _ in range(5):
            text = "".join(r.choice("abc ") for _ in range(r.randint(0, 8)))
            if re.search(pattern, text):
                assert any(all(x in text for x in way) for way in needed), (pattern, text)


def test_hits_equal_all_pairs(spark):
    keys = ["do you need sponsorship", "notice period in weeks", "years of python", "visa", "a", "c++ years", "", "are you authorized to work"]
    patterns = ["sponsor", "visa|sponsor", "^notice", "year(s)? of", r"c\+\+", ".", "", "([", r"\p{L}+", "^a$", "[0-9]{2}", "work$|^do", None]
    k = spark.createDataFrame([(x,) for x in keys], "label_key string")
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    want = {(x, y) for x in keys for y in patterns if P.needs(y) is not None and re.search(y, x)}
    assert {tuple(r) for r in A.pattern_hits(k, p).collect()} == want
    assert A.pattern_candidates(k, p.where(F.col("p") == "sponsor")).count() == 1


def test_refused_patterns_leave_the_rest(spark):
    bank = spark.createDataFrame([(1, 0, [], ["(?P<n>x)", "sponsor", None], "yes", None, False), (1, 1, [], [r"\p{L}+"], "no", None, False)],
                                 "candidate_id int, ord int, label_keys array<string>, label_patterns array<string>, text string, option_preference array<string>, sensitive boolean")
    keys = spark.createDataFrame([(1, "do you need sponsorship"), (1, "x")], "candidate_id int, label_key string")
    assert [(r.label_key, r.text) for r in A.bank_matches(keys, bank).collect()] == [("do you need sponsorship", "yes")]
    assert [r.label_patterns for r in A.screen_patterns(bank).orderBy("ord").collect()] == [["sponsor"], []]


@pytest.mark.parametrize("pattern,needed", [("notice.*42$", [["42", "notice"]]), (r"steel\s(?:7|0)", [["steel ", "teel 7"], ["steel ", "teel 0"]])])
def test_every_run_is_needed_in_its_own_length(pattern, needed):
    assert P.needs(pattern, 6) == needed


def test_rare_numbers_decide_what_is_tried(spark):
    keys = spark.range(2000).select(F.concat(F.lit("red steel bolt "), F.col("id").cast("string")).alias("label_key"))
    patterns = spark.range(2000).select(F.concat(F.lit(r"steel bolt\s(?:"), F.col("id").cast("string"), F.lit("|x)$")).alias("p"))
    assert A.pattern_hits(keys, patterns).count() == 2000
    assert A.pattern_candidates(keys, patterns).count() < 10 * 2000


def test_white_space_of_a_key_meets_the_class(spark):
    k = spark.createDataFrame([(x,) for x in ("steel\t7", "steel 7", "steel\x0b7", "steel7")], "label_key string")
    p = spark.createDataFrame([(r"steel\s7",)], "p string")
    assert {r.label_key for r in A.pattern_hits(k, p).collect()} == {"steel\t7", "steel 7", "steel\x0b7"}
