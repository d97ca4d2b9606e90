from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagesieve.llm.line_dedup import dedup_lines


def plain(texts):
    seen, out = set(), []
    for text in texts:
        parts = text.split("\n") if text is not None else []
        gone = set()
        for i in range(len(parts) - 2):
            window = tuple(parts[i:i + 3])
            if not any(p.strip() for p in window):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(window)
        out.append(text if not gone else "\n".join(p for i, p in enumerate(parts) if i not in gone))
    return out


@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "", " "]), max_size=9).map("\n".join)), max_size=6))
@settings(deadline=None, max_examples=12, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_against_brute_force(docs, texts):
    rows = dedup_lines(docs(texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == plain(texts)


def test_rows_columns_and_repeats_stay(docs):
    one = docs(["a\nb\nc\nd", "x\na\nb\nc", None, ""])
    rows = dedup_lines(one.union(one)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["a\nb\nc\nd"] * 2 + ["x"] * 2 + [None] * 2 + [""] * 2
    assert rows[2].row == 1 and rows[2]._removed_lines == 3
    assert dedup_lines(one.limit(0)).count() == 0
