import math
import random

from pyspark.sql import functions as F

from pagesieve.llm import languages
from pagesieve.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, score double, lang_pred int"


def normal(text, codes):
    """Codes of a text as the definition has them, runs of gaps as one."""
    out = [languages.GAP]
    for c in text:
        small = c.lower() if len(c.lower()) == 1 else c
        code = codes.get(ord(small), languages.OTHER) if c.isalpha() else languages.GAP
        if code != languages.GAP or out[-1] != languages.GAP:
            out.append(code)
    return out


def phrases(codes, learned):
    """Greedy longest matches in a learned sequence; a code that it lacks is one."""
    n, at = 0, 0
    while at < len(codes):
        size = 1
        while at + size < len(codes) and holds(learned, codes[at:at + size + 1]):
            size += 1
        at, n = at + size, n + 1
    return n


def holds(learned, part):
    return bytes(part) in learned


def test_automata_and_parses_against_brute_force(spark):
    draw = random.Random(3)
    def words(letters, n):
        return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 5))) for _ in range(n))

    rows = [(i, words("abcd" if i % 2 else "cdeé", 60), "x" if i % 2 else "y", 0.0, 1) for i in range(60)]
    model = languages.fit(spark.createDataFrame(rows, DOCS))
    assert model.names == ["x", "y"] and (model.bits > 10).all()
    texts = [words("abcdeéfÉ", draw.randint(1, 90)) for _ in range(40)] + ["", "a", "12", "ß", " a  b ", "İ", "\n\na\n", "日本"]
    got, sizes, letters = languages.Parser(model).phrases(texts)
    samples = languages.sample(spark.createDataFrame(rows, DOCS))
    for k, name in enumerate(model.names):
        # what was learned, an end code between excerpts
        share = languages.LEARNED_CHARS // 2
        learned = b"\0".join(bytes(normal("\n" + t, model.codes)) for t in samples[name])[:share]
        for i, text in enumerate(texts):
            codes = normal(text, model.codes)
            # a gap at the end of a text is that of the next one's start
            codes = codes if len(codes) == sizes[i] else codes[:sizes[i]]
            expected = sum(phrases(codes[a:a + languages.PIECE], learned) for a in range(0, len(codes), languages.PIECE))
            assert got[i][k] == expected, (text, name)
            assert letters[i] == sum(c.isalpha() for c in text)


def test_automaton_knows_all_substrings_and_no_others():
    draw = random.Random(5)
    for _ in range(20):
        codes = bytes(draw.randint(1, 3) for _ in range(draw.randint(1, 40)))
        states = languages.automaton(codes)
        for _ in range(200):
            part = bytes(draw.randint(1, 3) for _ in range(draw.randint(1, 8)))
            at = 0
            for c in part:
                at = states[at].get(c) if at is not None else None
            assert (at is not None) == (part in codes)


def test_edge_cases(spark):
    rows = [(i, "le chat est sur la table et il dort", "fr", 1.0, 2) for i in range(0, 40)]
    rows += [(i, "the cat is on the table and it sleeps", "en", 1.0, 2) for i in range(40, 80)]
    rows += [(None, "the cat", None, 1.0, 2), (100, None, "en", 1.0, 2), (101, "", "fr", 1.0, 2), (102, "12 _ 34", "en", 1.0, 2)]
    rows += [(103, "the table and " * 400_000, "fr", 1.0, 2), (104, "LE CHAT DORT", None, 1.0, 2), (104, "LE CHAT DORT", None, 1.0, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    got = languages.predicted(docs, languages.fit(docs.where("doc_id < 100"))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (0, 79, 100, 101, 102, 103, 104, None)] == ["fr", "en", "und", "und", "und", "en", "fr", "en"]
    assert by_id[100].score == 0 and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id == 104 for r in got) == 2
    # one language, none, no rows
    assert {r.lang_pred for r in languages.predicted(docs, languages.fit(docs.where("lang = 'fr' AND doc_id < 40"))).collect()} == {"fr", "und"}
    assert {(r.lang_pred, r.score) for r in languages.predicted(docs, languages.fit(docs.limit(0))).collect()} == {("und", 0.0)}
    assert languages.predicted(docs.limit(0), languages.fit(docs.limit(0))).count() == 0


def test_learns_from_its_share_only(spark):
    rows = [(i, "aa bb", "kept" if i % 2 else None, 0.0, 1) for i in range(200)] + [(None, "cc", "null-id", 0.0, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    hidden = docs.where(languages.held_out(F.col("doc_id"))).withColumn("lang", F.lit("hidden"))
    assert list(languages.sample(docs.where(~languages.held_out(F.col("doc_id"))).unionByName(hidden))) == ["kept"]


def test_accuracy_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op12_cross_parsing_language"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    right = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98 and math.isfinite(right)
