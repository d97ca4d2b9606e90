"""Long exclusion lists against brute force."""

import random

import pytest

from pagesieve.schemas import PAGES
from pagesieve.sources import exclusions as X
from pagesieve.sources import pages as P


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)


def lines_of(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "line string")


def kept(df):
    return sorted(r.page_id for r in df.collect())


def test_lines_mean_what_they_mean_in_a_predicate(spark):
    urls = ["https://a.com/Admin", "https://b.com/x1", "https://c.com/", "https://d.com/Ä\U0001f600z", None, "", "https://a.com/Admin"]
    pages = pages_of(spark, urls)
    for lines in (["ADMIN"], ["", "  ", None], ["/x\\d$/"], ["/admin/"], ["/(/"], [" a.com"], ["/"], ["1"], ["B."], ["ä\U0001f600"],
                  ["\U0001f600z"], ["://"], ["nowhere", "c.com/", "X1", "/^$/"], []):
        wanted = P.exclude_urls(pages, [line for line in lines if line is not None])
        assert kept(X.exclude_by_lines(pages, lines_of(spark, lines))) == kept(wanted), lines


def test_a_hundred_thousand_lines(spark, monkeypatch):
    rng = random.Random(5)
    letters = "abcdeABCDE01./-"
    urls = ["https://hot.example.com/" + "".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(300)]
    urls += ["https://" + "".join(rng.choices(letters, k=12)) for _ in range(150)] + [urls[0]] * 100
    lines = ["".join(rng.choices(letters, k=rng.randrange(5, 12))) for _ in range(100_000)]
    # lines of one hot host share all but their last pieces
    lines += [f"hot.example.com/{i:x}zz" for i in range(2000)]
    lines = [line for line in lines if not (line.startswith("/") and line.endswith("/"))]
    low = [line.lower() for line in lines]
    wanted = [i for i, url in enumerate(urls) if not any(line in url.lower() for line in low)]
    assert 20 < len(wanted) < len(urls) - 20
    pages, table = pages_of(spark, urls), lines_of(spark, lines)
    for limit in (X.BROADCAST_BYTES, 0):
        monkeypatch.setattr(X, "BROADCAST_BYTES", limit)
        hits = X.excluded_urls(pages, table)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert {r.url for r in hits.collect()} == set(urls) - {urls[i] for i in wanted}


def test_lines_of_one_trigram_are_cut_into_rows(spark):
    urls = pages_of(spark, ["qqq" * 400]).selectExpr("url", "lower(url) AS low")
    plain = lines_of(spark, ["q" * n for n in range(3, 1000)])
    sizes = [len(r.lines) for r in X.line_index(plain, urls, [3]).collect()]
    assert sum(sizes) == 997 and len(sizes) > 2 and max(sizes) < 2 * X.LINES_PER_ROW


def test_too_many_regexes_are_refused(spark):
    with pytest.raises(ValueError):
        X.exclude_by_lines(pages_of(spark, ["a"]), lines_of(spark, [f"/{i}/" for i in range(X.MAX_REGEX_LINES + 1)]))
