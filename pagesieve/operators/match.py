"""Match engine: every match of every rule with its place in the text.

One regex pass over a text marks all matches of a rule; the marked text is cut
at the marks, and offset, line and column follow from the lengths of the
pieces.  Nothing is shuffled and no text is searched twice for the same rule.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.functions.text import js_trim, let, line_breaks, shannon_entropy
from pagesieve.rules import LEAD_WINDOW, Rule, assigned_lead, word_lead
from pagesieve.sources.layout import spread

# Noncharacters, which Unicode keeps out of interchanged text.  A text that
# holds one all the same takes the slower branch of ``_blocks``.
_EDGE, _INNER = "\ufdd0", "\ufdd1"

# Matches per chunk.  Building an array element by element costs the square of
# its length, so long match lists are walked in chunks.
_CHUNK = 512

MAX_RULES = 10_000

_STATE = "struct<off:int,line:int,col:int>"
_HIT = "struct<match:string,finding:string,method:string,off:int,line:int,col:int>"


def check_rules(rules: Sequence[Rule]) -> None:
    """Reject rules that could match nothing at all, or a table too large to broadcast."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the rule table is broadcast and holds at most {MAX_RULES}")
    for rule in rules:
        if re.compile(rule.pattern).search("") is not None:
            raise ValueError(f"rule {rule.rule_id or rule.category!r} matches the empty string")
        if rule.word and re._parser.parse(rule.word).getwidth()[1] > LEAD_WINDOW:
            raise ValueError(f"the word lead of rule {rule.rule_id or rule.category!r} may need more than {LEAD_WINDOW} characters")


def _replacement(rule: Rule) -> str:
    method = f"${rule.method_group}" if rule.method_group else ""
    return f"{_EDGE}$0{_INNER}${rule.group}{_INNER}{method}{_EDGE}"


def _block(gap: Column, match: Column, finding: Column, method: Column) -> Column:
    def tail(text: Column) -> Column:
        return F.length(F.substring_index(text, "\n", -1))

    return F.struct(
        match.alias("match"), finding.alias("finding"), method.alias("method"),
        F.length(gap).alias("gap_len"), line_breaks(gap).alias("gap_lines"), tail(gap).alias("gap_tail"),
        F.length(match).alias("len"), line_breaks(match).alias("lines"), tail(match).alias("tail"),
    )


def _blocks(content: Column, pattern: Column, replacement: Column, group: Column, method_group: Column) -> Column:
    """One struct per match: the text before it, the match and its groups."""
    def from_marks(parts: Column) -> Column:
        def block(i: Column) -> Column:
            gap = F.element_at(parts, F.lit(2) * i + F.lit(1))
            fields = F.split(F.element_at(parts, F.lit(2) * i + F.lit(2)), _INNER, -1)
            return let(fields, lambda f: _block(
                gap, F.element_at(f, 1), F.element_at(f, 2), F.element_at(f, 3)))

        count = F.floor((F.size(parts) - F.lit(1)) / F.lit(2)).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - F.lit(1)), block))

    def from_lists(_: Column) -> Column:
        gaps = F.split(content, pattern, -1)
        matches = F.regexp_extract_all(content, pattern, F.lit(0))
        findings = F.regexp_extract_all(content, pattern, group)
        methods = F.regexp_extract_all(content, pattern, F.coalesce(method_group, F.lit(0)))
        rows = F.filter(F.arrays_zip(
            gaps.alias("g"), matches.alias("m"), findings.alias("f"), methods.alias("h")),
            lambda r: r["m"].isNotNull())
        return F.transform(rows, lambda r: _block(
            r["g"], r["m"], r["f"], F.when(method_group.isNotNull(), r["h"]).otherwise(F.lit(""))))

    marked = F.split(F.regexp_replace(content, pattern, replacement), _EDGE, -1)
    clash = content.contains(_EDGE) | content.contains(_INNER)
    return F.when(clash, from_lists(content)).otherwise(let(marked, from_marks))


def _at_match(state: Column, block: Column) -> tuple[Column, Column, Column]:
    moved = F.when(block["gap_lines"] > 0, block["gap_tail"]).otherwise(state["col"] + block["gap_tail"])
    return state["off"] + block["gap_len"], state["line"] + block["gap_lines"], moved


def _after_match(state: Column, block: Column) -> Column:
    off, line, col = _at_match(state, block)
    col = F.when(block["lines"] > 0, block["tail"]).otherwise(col + block["tail"])
    return F.struct(
        (off + block["len"]).alias("off"), (line + block["lines"]).alias("line"), col.alias("col"))


def _start() -> Column:
    return F.struct(F.lit(0).alias("off"), F.lit(1).alias("line"), F.lit(0).alias("col"))


def _chunks(blocks: Column) -> Column:
    """Runs of at most ``_CHUNK`` blocks, each with the position it starts at."""
    def first_state(chunk: Column, state: Column) -> Column:
        return F.aggregate(chunk, state, _after_match)

    def cut(bs: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("no"), _start().alias("state"), bs.alias("blocks")))
        last = F.floor((F.size(bs) - F.lit(1)) / F.lit(_CHUNK)).cast("int")
        runs = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.struct(k.alias("no"), F.slice(bs, k * F.lit(_CHUNK) + F.lit(1), F.lit(_CHUNK)).alias("blocks")),
        )
        grown = F.aggregate(
            runs,
            F.struct(_start().alias("state"), F.slice(whole, 1, 0).alias("out")),
            lambda acc, run: F.struct(
                first_state(run["blocks"], acc["state"]).alias("state"),
                F.concat(acc["out"], F.array(F.struct(
                    run["no"].alias("no"), acc["state"].alias("state"), run["blocks"].alias("blocks")))).alias("out"),
            ),
        )
        return F.when(F.size(bs) <= _CHUNK, whole).otherwise(grown["out"])

    return let(blocks, cut)


def _walk(state: Column, blocks: Column) -> Column:
    def step(acc: Column, block: Column) -> Column:
        off, line, col = _at_match(acc["state"], block)
        hit = F.struct(
            block["match"].alias("match"), block["finding"].alias("finding"), block["method"].alias("method"),
            off.alias("off"), line.alias("line"), (col + F.lit(1)).alias("col"))
        return F.struct(
            _after_match(acc["state"], block).alias("state"),
            F.concat(acc["out"], F.array(hit)).alias("out"))

    empty = F.array().cast(f"array<{_HIT}>")
    return F.aggregate(blocks, F.struct(state.alias("state"), empty.alias("out")), step)["out"]


def _locate(texts: DataFrame, keep: list[str], pattern: Column, replacement: Column,
            group: Column, method_group: Column, limit: int | None) -> DataFrame:
    blocks = _blocks(F.col("content"), pattern, replacement, group, method_group)
    if limit is not None:
        blocks = F.slice(blocks, 1, limit)
    runs = texts.select(*keep, F.explode(_chunks(blocks)).alias("_run"))
    hits = runs.select(
        *keep, F.col("_run.no").alias("_no"),
        F.posexplode(_walk(F.col("_run.state"), F.col("_run.blocks"))).alias("_pos", "_hit"))
    return hits.select(
        *keep,
        (F.col("_no") * F.lit(_CHUNK) + F.col("_pos")).alias("match_ord"),
        F.col("_hit.match").alias("match"),
        F.col("_hit.finding").alias("finding"),
        F.when(F.col("_hit.method") != "", F.upper(F.col("_hit.method"))).alias("http_method"),
        F.col("_hit.off").alias("index"),
        F.col("_hit.line").alias("line"),
        F.col("_hit.col").alias("column"),
    )


def scannable_text(sources: DataFrame) -> DataFrame:
    """Sources worth matching: some text, and not over the size gate."""
    keep = F.coalesce(F.col("content"), F.lit("")) != ""
    if "is_too_large" in sources.columns:
        keep = keep & ~F.col("is_too_large")
    return sources.where(keep)


def _text_keys(sources: DataFrame) -> list[str]:
    return [c for c in sources.columns if c != "content"]


def _spread_texts(sources: DataFrame, keep: list[str]) -> DataFrame:
    return spread(scannable_text(sources), [c for c in ("page_id", "source") if c in keep])


def match_rule(sources: DataFrame, rule: Rule, limit: int | None = None) -> DataFrame:
    """All non-overlapping matches of one rule, in text order."""
    check_rules([rule])
    keep = _text_keys(sources)
    texts = _spread_texts(sources, keep)
    if rule.has_lead:
        texts = texts.where(_rule_lead(F.col("content"), rule))
    none = F.lit(rule.method_group).cast("int")
    return _locate(texts, keep, F.lit(rule.java), F.lit(_replacement(rule)), F.lit(rule.group), none, limit)


def _rule_lead(content: Column, rule: Rule) -> Column:
    tests = []
    if rule.word:
        tests.append(content.rlike(word_lead(rule.word)))
    if rule.assigned:
        tests.append(content.rlike(assigned_lead(rule.assigned)))
    tests += [F.lower(content).contains(text) for text in rule.text]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _alternatives(pattern: str) -> list[str]:
    return [pattern] if "(" in pattern or "[" in pattern else pattern.split("|")


def _by_first(patterns: Sequence[str]) -> str:
    """Alternatives grouped by first character, so that most are never tried."""
    grouped: dict[str, set[str]] = defaultdict(set)
    other: set[str] = set()
    for pattern in (p for joined in patterns for p in _alternatives(joined)):
        if pattern[0].isalnum():
            grouped[pattern[0]].add(pattern[1:])
        else:
            other.add(pattern)
    heads = [c + "(?:" + "|".join(sorted(rest)) + ")" for c, rest in sorted(grouped.items())]
    return "|".join(heads + sorted(other))


def _begins_with(pattern: str) -> Callable[[Column], Column]:
    return lambda start: start.rlike(rf"(?is)^(?:{pattern})")


def _names_any(low: Column, names: str) -> Column:
    """Cheap first test for one of the names of an assignment lead."""
    heads = list(dict.fromkeys(re.match("[a-z]+", name).group() for name in _alternatives(names)))
    test = low.contains(heads[0])
    for head in heads[1:]:
        test = test | low.contains(head)
    return test


def candidates(content: Column, rules: Sequence[Rule]) -> Column:
    """Ordinals of the rules whose leads appear in ``content``.

    Leads of one kind share a regex, and a rule's own lead is looked at only
    where the joint one is found.
    """
    numbered = list(enumerate(rules))
    words = [(i, r.word) for i, r in numbered if r.word]
    assigned = [(i, r.assigned) for i, r in numbered if r.assigned]
    texts = [(i, r) for i, r in numbered if r.text]
    always = [i for i, r in numbered if not r.has_lead]
    none = F.array().cast("array<int>")

    def words_of(starts: Column) -> Column:
        own = F.array(*[F.when(F.exists(starts, _begins_with(p)), F.lit(i)) for i, p in words])
        return F.when(F.size(starts) > 0, own).otherwise(none)

    def gather(low: Column) -> Column:
        parts = [F.array(*[F.lit(i) for i in always]) if always else none]
        if words:
            joint = word_lead(_by_first([p for _, p in words]))
            parts.append(let(F.regexp_extract_all(content, F.lit(joint), F.lit(1)), words_of))
        if assigned:
            joint = assigned_lead(_by_first([p for _, p in assigned]))
            own = F.array(*[
                F.when(_names_any(low, p) & content.rlike(assigned_lead(p)), F.lit(i)) for i, p in assigned])
            parts.append(F.when(content.rlike(joint), own).otherwise(none))
        by_text: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, r in texts:
            by_text[r.text].append(i)
        for lits, members in by_text.items():
            test = low.contains(lits[0])
            for text in lits[1:]:
                test = test | low.contains(text)
            parts.append(F.when(test, F.array(*[F.lit(i) for i in members])).otherwise(none))
        return F.array_distinct(F.array_compact(F.concat(*parts)))

    return let(F.lower(content), gather)


_RULE_SCHEMA = T.StructType([
    T.StructField("rule_ord", T.IntegerType(), False),
    T.StructField("rule_id", T.StringType()),
    T.StructField("category", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("_pattern", T.StringType(), False),
    T.StructField("_replacement", T.StringType(), False),
    T.StructField("_group", T.IntegerType(), False),
    T.StructField("_method_group", T.IntegerType()),
    T.StructField("entropy_floor", T.DoubleType()),
])


def rule_table(sources: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (i, r.rule_id, r.category, r.description, r.java, _replacement(r), r.group, r.method_group, r.entropy)
        for i, r in enumerate(rules)
    ]
    return sources.sparkSession.createDataFrame(rows, _RULE_SCHEMA)


def scan(sources: DataFrame, rules: Sequence[Rule], limit: int | None = None) -> DataFrame:
    """Matches of all ``rules`` over all ``sources`` in one pass over the table.

    The rules each text deserves are found first; only those pairs are
    matched.  The join brings in a rule table whose size ``check_rules`` bounds.
    """
    check_rules(rules)
    keep = _text_keys(sources)
    texts = _spread_texts(sources, keep)
    # Exploded where it is computed: a named column would be filtered on first
    # and the filter would work the leads out a second time.
    pairs = texts.select(*keep, "content", F.explode(candidates(F.col("content"), rules)).alias("rule_ord"))
    pairs = pairs.join(F.broadcast(rule_table(sources, rules)), "rule_ord")
    named = keep + ["rule_ord", "rule_id", "category", "description", "entropy_floor"]
    return _locate(
        pairs, named, F.col("_pattern"), F.col("_replacement"), F.col("_group"), F.col("_method_group"), limit)


def with_entropy(matches: DataFrame, finding: str = "finding") -> DataFrame:
    return matches.withColumn("entropy", shannon_entropy(F.col(finding)))


def entropy_filter(matches: DataFrame) -> DataFrame:
    """Keep matches at or above their rule's floor; a rule without one keeps all."""
    floor = F.col("entropy_floor")
    return matches.where(floor.isNull() | (shannon_entropy(F.col("finding")) >= floor))


def clean_group(matches: DataFrame) -> DataFrame:
    """Trim findings and drop the empty ones, among them absent groups."""
    return matches.withColumn("finding", js_trim(F.col("finding"))).where(F.col("finding") != "")


def cap_matches(matches: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` candidates per source and rule, first ones first."""
    return matches.where(F.col("match_ord") < limit)
