"""User regexes: what ECMAScript finds, and what it refuses."""

import pytest
from pyspark.sql import functions as F

from pagesieve.functions.patterns import user_pattern
from pagesieve.schemas import PAGES
from pagesieve.sources import pages as P

# (pattern, text, whether it is found), by the language definition.
CASES = [
    ("", "", True), ("a{", "a{", True), ("a{1", "a{1", True), ("a{2}", "caat", True), ("a{2}", "a{2}", False), ("x{,2}", "x{,2}", True),
    ("a]b", "a]b", True), ("a}b", "a}b", True), ("a[^]b", "a\nb", True), ("a[]b", "ab", False), ("[^]", "", False),
    (r"\/api\/", "https://a/api/x", True), (r"(?<v_1>\d)\k<v_1>", "x77", True), (r"(?<v_1>\d)\k<v_1>", "x78", False),
    (r"(?<$a>x)(?<b>y)\k<b>\k<$a>", "xyyx", True), (r"\k<a>", "k<a>", True), (r"(a)\1", "aa", True), (r"(a)\12", "aa2", False),
    (r"\1", "\x01", True), (r"\08", "\x008", True), (r"\0", "\x00", True), (r"\101", "A", True), (r"\8", "8", True), (r"\cJ", "\n", True),
    (r"\c1", "\\c1", True), (r"\x4", "x4", True), (r"\x41", "A", True), (r"A", "A", True), (r"\u41", "u41", True), (r"\v", "\x0b", True),
    (r"\v", "\n", False), (r"\h\Q\E\A\Z\z\G\R\X\N\e\a", "hQEAZzGRXNea", True), (r"\p{L}", "p{L}", True), (r"\p{L}", "a", False),
    (r"[\b]", "\b", True), (r"\Bb", "ab", True), (r"\Bb", "b", False), (r"[a&&b]", "&", True), (r"[[a]", "[", True), (r"[\]]", "]", True),
    (r"[\d-x]", "-", True), ("a$", "a\n", False), ("a.b", "a b", False), ("(?=a)", "ba", True), ("(?!a)", "a", True), ("(?=a)*b", "b", True),
    ("a+?b", "aab", True), ("(?:a|b)+c", "abac", True), ("(?<=a)b", "ab", True), ("(?<!a)b", "ab", False), (r"\-\_\é", "-_é", True),
    (r"a{2}?b", "aab", True), ("#", "#", True), (" a", "a", False),
]
REFUSED = ["(", ")", "[", "[a", "\\", "*", "+a", "?", "{2}", "a**", "a++", "a{2}+", "a??+", "(?>a)", "(?i)a", "(?P<n>a)", "(?<1>a)", "(?#a)",
           r"(?<a>x)\k<b>", "(?<a>x)(?<a>y)", "(?<=a)*", "^*", r"\b+", "a|*", "(*a)", "a{2,1}", "[b-a]"]


def test_patterns_mean_what_they_mean_in_a_browser(spark):
    tests = [F.lit(text).rlike(user_pattern(pattern)).alias(f"c{i}") for i, (pattern, text, _) in enumerate(CASES)]
    row = spark.range(1).select(*tests).first()
    assert [case for case, got in zip(CASES, row) if got != case[2]] == []


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(spark, pattern):
    with pytest.raises(ValueError):
        user_pattern(pattern)


def test_lines_of_an_exclusion_list(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(["https://a/{x}/11", "https://a/b", None])], PAGES)

    def kept(*lines):
        return {r.page_id for r in P.exclude_urls(pages, lines).collect()}

    assert kept(r"/(?<d_>\d)\k<d_>$/") == {1, 2}
    assert kept("/{x/") == {1, 2}
    assert kept("/a++/", "/(?i)B/", "/(?>b)/") == {0, 1, 2}
    assert kept("/[^]b/") == {0, 2}
