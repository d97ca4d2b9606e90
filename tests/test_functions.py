import math
from collections import Counter
from urllib.parse import urljoin, urldefrag

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import text as X
from pagesieve.functions import urls as U
from pagesieve.operators.extract import sanitize_findings


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


DECODED = [
    ("Hello%20World", "Hello World"),
    ("This is a test\\u003cscript\\u003e", "This is a test<script>"),
    ("&lt;div&gt;Hello&lt;/div&gt;", "<div>Hello</div>"),
    ("", ""),
    ("plain string", "plain string"),
    ("bad: %E0%A4%A", "bad: %E0%A4%A"),
    ("%2541 %%341", "%41 %41"),
    ("&amp;lt; &amp &ampx &nope; &notit; &eacute;", "&lt; & &x &nope; ¬it; é"),
    ("&#65;&#x41;&#128512;&#0;&#x80;&#xD800;&#99999999999;&#65", "AA\U0001F600�€��A"),
    ("a\r\nb\rc", "a\nb\nc"),
    ("< u003C", "< <"),
]


def test_decode_text(spark):
    raw, want = zip(*DECODED)
    assert column(spark, raw, X.decode_text) == list(want)


def test_entropy(spark):
    values = ["", None, "aaaa", "aabb", "abcdefgh", "Ünï", "k3y!k3y!zz"]
    got = column(spark, values, X.shannon_entropy)
    for value, h in zip(values, got):
        n = len(value or "")
        want = -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0
        assert h == pytest.approx(want, abs=1e-9)


def test_preview_and_snippet(spark):
    assert column(spark, ["a" * 100, "b" * 101], X.preview) == ["a" * 100, "b" * 97 + "..."]
    got = column(spark, ["0123\n56789"], lambda c: X.snippet(c, F.lit(5), F.lit(2), 2))
    assert got == ["... 3 5678 ..."]


def test_line_and_column(spark):
    text = "one\ntwo\nthree"
    for index, want in ((0, (1, 1)), (2, (1, 3)), (4, (2, 1)), (9, (3, 2))):
        line = column(spark, [text], lambda c: X.line_of(c, F.lit(index)))[0]
        col = column(spark, [text], lambda c: X.column_of(c, F.lit(index)))[0]
        assert (line, col) == want


DOMAINS = [
    ("www.example.com", "www.example.com", "example.com"),
    ("sub.domain.com.pl", "sub.domain.com.pl", "domain.com.pl"),
    ("example.com", "example.com", "example.com"),
    ("localhost", "localhost", "localhost"),
    ("localhost:4000", "localhost:4000", "localhost:4000"),
    ("127.0.0.1", None, None),
    ("256.0.0.1", "256.0.0.1", "0.1"),
]


def test_domain_info(spark):
    hosts, current, base = zip(*DOMAINS)
    assert column(spark, hosts, U.current_hostname) == list(current)
    assert column(spark, hosts, U.base_domain) == list(base)


def test_resolve_url_like_a_browser(spark):
    base = "https://ex.com/a/b/c.html?x=1#y"
    refs = ["d.js", "./d.js", "../d.js", "../../../d.js", "/r/./s/../t", "//cdn.ex.com/x", "?q=1", "https://other.org/z",
            "d/", "..", ".", "e f.js"]
    want = [urldefrag(urljoin(base, r)).url.replace(" ", "%20") for r in refs]
    assert column(spark, refs, lambda c: U.resolve_url(c, F.lit(base))) == want


def test_unsafe_and_odd_urls(spark):
    refs = ["javascript:alert(1)", "data:text/html,x", "HTTP://EX.com:80", "https://u:p@ex.com:8443/p?q#f", "  /t\n ", "", "#f"]
    base = F.lit("https://ex.com/a?b=1")
    assert column(spark, refs, lambda c: U.resolve_url(c, base)) == [
        None, None, "http://ex.com/", "https://u:p@ex.com:8443/p?q", "https://ex.com/t", "https://ex.com/a?b=1",
        "https://ex.com/a?b=1"]


def test_report_names(spark):
    urls = ["https://www.example.com/user/profile/settings", "https://example.com", "not-a-valid-url",
            "https://example.com/a/?q=/b", None]
    assert column(spark, urls, U.report_name) == [
        "recon_www.example.com_user_profile_settings.json", "recon_example.com.json", "recon_scan_results.json",
        "recon_example.com_a.json", "recon_scan_results.json"]


def test_scannable(spark):
    urls = ["https://a.com", "http:weird", "ftp://a", "chrome://x", None, "https://addons.mozilla.org/x",
            "https://chrome.google.com/webstore/y", "https://chromewebstore.google.com/"]
    assert column(spark, urls, U.is_scannable) == [True, True, False, False, False, False, False, False]


def test_sanitize(spark):
    rows = [("x" * 300, "d" * 600, "s" * 3000, "k" * 20000, "4", "7", True), (None, "", None, None, "1.5", "x", None)]
    df = spark.createDataFrame(rows, "id string, description string, source string, secret string, line string, "
                                     "column string, is_source_too_large boolean")
    a, b = sanitize_findings(df).collect()
    assert [len(v) for v in a[:4]] == [200, 500, 2000, 10000] and a[4:] == (4, 7, True)
    assert tuple(b) == ("Unknown", None, "", "", None, None, False)
