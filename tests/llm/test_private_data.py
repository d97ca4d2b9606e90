import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagesieve.llm import private_data as D
from pagesieve.llm.queries import QUERIES

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@given(st.text(alphabet="aB1290.@+- ()%é٣", max_size=60))
@settings(deadline=None, max_examples=1500)
def test_fixed_kinds_against_the_patterns(text):
    assert D.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 1_000_000, "a@" * 200_000, "1" * 1_000_000, "1.1." * 200_000, "+1" * 300_000, "a." * 500_000 + "@"):
        D.base_spans(text)


def test_patterns_find_unseen_identifiers(docs):
    seeds = [f"Please write. Contact: user{i}@mail.example.org today" for i in range(5)]
    unseen = ["More on this, contact: AB-77123 now", "contact: AB-77123 and badge # AB-77123"]
    other = ["badge # 88-12-77", "version: 2.0.111 of this", "contact: nobody here", None, ""]
    texts = seeds + unseen + other
    rows = {r.doc_id: r for r in D.private_spans(docs(texts), confidence=0.7).orderBy("doc_id").collect()}
    found = {i: [texts[i][s.start:s.end] for s in r.spans if s.kind == 4] for i, r in rows.items()}
    assert found[5] == ["AB-77123"] and "AB-77123" in found[6]
    assert not any(found[i] for i in (*range(5), 8, 9, 10, 11))
    assert D.private_spans(docs(texts).limit(0)).count() == 0


def test_plain_contexts_of_all_kinds_at_production_parameters(docs):
    def card(i):
        digits = f"411111111111{i:03}"
        last = next(d for d in "0123456789" if D.luhn(digits + d))
        return " ".join((digits + last)[k:k + 4] for k in range(0, 16, 4))

    seeds = {
        "You may write to {} about it": [f"user{i}@mail.example.org" for i in range(5)],
        "The request came from {} last night": [f"203.0.113.{i}" for i in range(5)],
        "card: {} was charged": [card(i) for i in range(5)],
        "Just call me at {}, please": [f"+1 (743) 555-38{i}4" for i in range(5)],
    }
    unseen = ["AB-77123", "host-0042.lan", "9999 8888 7777 6665", "743 555 3824"]
    texts = [place.format(value) for place, values in seeds.items() for value in values]
    texts += [place.format(value) for place, value in zip(seeds, unseen)]
    texts += ["It weighs 12345.6 grams", "Nothing to see"]
    rows = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans if s.kind == 4] for r in D.private_spans(docs(texts)).collect()}
    assert [rows[20 + k] for k in range(4)] == [[x] for x in unseen]
    assert not any(rows[k] for k in (*range(20), 24, 25))


def test_contexts_and_instances():
    text = "Write to a@b.example or call +1 (743) 555-3824; id=AB-77123 card: 4111 1111 1111 1111."
    found = [(text[s:e], seed) for s, e, seed in D.instances(text, D.base_spans(text))]
    assert found == [("a@b.example", True), ("+1 (743) 555-3824", True), ("AB-77123", False), ("4111 1111 1111 1111", True)]
    at = text.index("+1")
    assert D.contexts(text, at, at + 17) == ["call _", "or call _", "example or call _"]
    at = text.index("AB-")
    assert D.contexts(text, at, at + 8) == ["id = _", "; id = _", "_ card"]


def test_long_contexts_are_linear():
    for text in ("1 " * 500_000, "a1b2c" * 200_000, "12345 " * 100_000, "id=" * 300_000 + "12345", "(" * 500_000, "ab " * 300_000 + "12345x"):
        list(D.placed_values(text, D.base_spans(text)))


def test_query_against_the_patterns(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_bootstrapped_private_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(D.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(D.joined(base).split(",")) <= set(r.spans.split(","))
