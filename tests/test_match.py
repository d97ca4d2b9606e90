import random
import re

import pytest
from pyspark.sql import functions as F

from pagesieve import rules as R
from pagesieve.operators import match as M

WORDS = R.Rule("words", "Text", r"([a-z])([a-z]*)\n?", "g", 2, method_group=1)


def brute(text, pattern, group):
    for k, m in enumerate(re.finditer(pattern, text)):
        head = text[:m.start()]
        yield (k, m.start(), head.count("\n") + 1, len(head) - (head.rfind("\n") + 1) + 1, m.group(), m.group(group) or "")


def located(df):
    return {i: sorted(tuple(r)[1:] for r in rows) for i, rows in _by_id(df).items()}


def _by_id(df):
    out = {}
    for r in df.select("page_id", "match_ord", "index", "line", "column", "match", "finding").collect():
        out.setdefault(r[0], []).append(r)
    return out


def test_positions_by_brute_force(texts):
    rng = random.Random(7)
    cases = ["".join(rng.choice("ab1 \n") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    cases += ["a", "\na", "\n\n a\nb", "1", "é\na €b"]
    found = located(M.match_rule(texts(cases), WORDS))
    for i, text in enumerate(cases):
        assert found.get(i, []) == sorted(brute(text, WORDS.pattern, 2)), text


@pytest.mark.parametrize("n", [M._CHUNK - 1, M._CHUNK, M._CHUNK + 1, 3 * M._CHUNK + 5])
def test_long_match_lists_are_whole(texts, n):
    text = "ab\n1" * (n // 2) + " x" * (n - n // 2)
    found = located(M.match_rule(texts([text]), WORDS))[0]
    assert len(found) == n
    assert found == sorted(brute(text, WORDS.pattern, 2))


def test_text_that_holds_the_marks(texts):
    text = f"ab{M._EDGE} cd\n{M._INNER}ef gh"
    df = M.match_rule(texts([text, "ab"]), WORDS)
    assert located(df)[0] == sorted(brute(text, WORDS.pattern, 2))
    assert {r.http_method for r in df.collect()} == {"A", "C", "E", "G"}


def test_absent_group_is_empty_and_trimmed_away(texts):
    rule = R.Rule("g", "Text", r"a(\s+b)?|c( d\s*)", "g", 2)
    found = M.clean_group(M.match_rule(texts(["a b c d  ", "a"]), rule)).collect()
    assert [r.finding for r in found] == ["d"]


def test_scripted_boundaries_follow_ecmascript(texts):
    # A letter outside ASCII is no word character, and $ is the end of the text only.
    rule = R.Rule("b", "Text", r"\bab(?:\s|$)", "g", 0)
    found = {r.page_id for r in M.match_rule(texts(["éab", "xab", "ab ", "ab c", "abé"]), rule).collect()}
    assert found == {0, 2, 3}


def test_limit_counts_candidates(texts):
    rows = M.match_rule(texts(["a b c d e"]), WORDS, limit=3).collect()
    assert [r.match_ord for r in rows] == [0, 1, 2]
    capped = M.cap_matches(M.match_rule(texts(["a b c d e"]), WORDS), 2)
    assert capped.count() == 2


def test_entropy_filter_keeps_rules_without_floor(texts):
    rules = [R.Rule("low", "Text", r"k=(\w+)", "g", 1, entropy=2.0), R.Rule("any", "Text", r"k=(\w+)", "g", 1)]
    kept = M.entropy_filter(M.scan(texts(["k=aaaa", "k=abcd"]), rules)).collect()
    assert sorted((r.page_id, r.rule_id) for r in kept) == [(0, "any"), (1, "any"), (1, "low")]


def test_too_large_and_empty_sources_are_left_out(texts):
    sources = texts(["a", "", None, "b"]).withColumn("is_too_large", F.col("page_id") == 3)
    assert {r.page_id for r in M.match_rule(sources, WORDS).collect()} == {0}


def test_scan_neither_crosses_nor_repeats_the_regex(texts):
    plan = M.scan(texts(["a"]), R.strict_rules())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan
    assert plan.count("regexp_replace") == 1


def test_a_host_name_of_absurd_length_does_not_overflow(texts):
    found = M.match_rule(texts(["a." * 20000 + "com"]), R.category_rules(R.SUBDOMAINS)[0])
    assert found.count() > 0
