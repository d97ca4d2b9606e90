import hashlib
import random

from pyspark.sql import functions as F

from pagesieve.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, at int, leaf int, root int, grp int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + 8])) for i in range(0, len(low), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + 8])))
        at //= 8
    return out


def plain(rows, changed):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf(row, row[1]), leaf(row, changed(row[1]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1]))
        trees[name] = climb([r[1] for r in groups[name]])
    top = climb([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for at, (row, own, then) in enumerate(groups[name]):
            steps = path(trees[name], at) + path(top, g)
            node = then
            for left, right in steps:
                node = sha(left + node + right)
            out.append((row[0], own, trees[name][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOCS).repartition(3)
    made = merkle.manifest(docs, FIELDS, "lang", "doc_id", {"text": merkle.lower_ascii(F.col("text"))})
    got = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(), merkle.fold(F.coalesce("later_leaf", "leaf"))).collect()
    return sorted(map(tuple, got), key=str)


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_against_brute_force(spark):
    draw = random.Random(1)
    texts = [None, "", "plain", "Mixed Case É", "ß" * 70_000]
    rows = [(draw.choice([None, *range(3000)]), draw.choice(texts), "en", draw.choice([None, "s"]), draw.choice([None, 3])) for _ in range(1300)]
    rows += [(i, "Text", f"l{i}", "s", 4) for i in range(530)]
    rows += [(5, "X", None, "s", 1)] * 9 + [(None, None, None, None, None)] * 2 + [(1, "a", "", "", 0)]
    assert found(spark, rows) == plain(rows, lowered)


def test_small_trees(spark):
    for n in (1, 2, 8, 9, 64, 65):
        rows = [(i, f"Text {i}", "en", "s", 4) for i in range(n)]
        assert found(spark, rows) == plain(rows, lowered)
    assert found(spark, []) == []


def test_paths_have_a_step_for_each_level(spark):
    rows = [(i, str(i), "en" if i < 70 else "de", "s", 4) for i in range(71)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOCS)
    made = merkle.manifest(docs, FIELDS, "lang", "doc_id").collect()
    assert {len(r.path) for r in made if r.lang == "en"} == {4} and {len(r.path) for r in made if r.lang == "de"} == {1}
    assert {r.later_leaf for r in made} == {None}
    assert {(len(x.left) + len(x.right)) % 64 for r in made for x in r.path} == {0}
