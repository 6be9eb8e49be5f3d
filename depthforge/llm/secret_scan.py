"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule is written once, as a small tree of literals, character classes, alternatives and
repetitions. The tree gives the Java pattern and, by the calculus of trigram indexes, a Boolean
query over lower-case trigrams that every matching text fulfils. The index holds postings
(trigram, document); only trigrams that some query names are posted, for no other posting list
is ever read. Postings are intersected per rule, and the candidates are verified by the pattern on
the whole text. A rule with no mandatory trigram scans every text.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A node is ("lit", text), ("set", class source), ("opt", node), ("many", node, least), ("seq", nodes...), ("alt", nodes...) or ("group", node).
Node = tuple


def lit(text: str) -> Node:
    return ("lit", text)


def chars(source: str, least: int = 1, most: int | None = None) -> Node:
    """Characters of a class, ``least`` to ``most`` of them (None: any number)."""
    return ("set", source, least, most)


def opt(node: Node) -> Node:
    return ("opt", node)


def seq(*nodes: Node) -> Node:
    return ("seq", *nodes)


def alt(*nodes: Node) -> Node:
    return ("alt", *nodes)


def group(node: Node) -> Node:
    return ("group", node)


def pattern(node: Node, either_case: bool = False) -> str:
    """Source of the pattern, the same for Java and RE2."""
    kind = node[0]
    if kind == "lit":
        return "".join(f"[{c.lower()}{c.upper()}]" if either_case and c.isascii() and c.isalpha() else re.sub(r"([^\w\s])", r"\\\1", c) if c not in "_-<>=:\"' " else "\\x20" if c == " " else c for c in node[1])
    if kind == "set":
        _, source, least, most = node
        times = {(1, 1): "", (0, 1): "?", (0, None): "*", (1, None): "+"}.get((least, most), f"{{{least},{'' if most is None else most}}}" if least != most else f"{{{least}}}")
        return f"[{source}]{times}"
    if kind == "opt":
        return f"(?:{pattern(node[1], either_case)})?"
    if kind == "seq":
        return "".join(pattern(n, either_case) for n in node[1:])
    if kind == "alt":
        return "(?:" + "|".join(pattern(n, either_case) for n in node[1:]) + ")"
    return f"({pattern(node[1], either_case)})"


# --- Boolean trigram queries ---------------------------------------------------------------

#: A query is None (any text) or a set of clauses, all of which must hold; a clause is a set of
#: conjunctions of trigrams, one of which must hold.
Clause = frozenset
MOST_STRINGS = 64


@dataclass
class _Info:
    """What is known of the texts that a node matches: all of them (if few), or ends; and clauses."""

    exact: set[str] | None
    prefix: set[str] = field(default_factory=lambda: {""})
    suffix: set[str] = field(default_factory=lambda: {""})
    clauses: frozenset = frozenset()


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(strings: set[str]) -> frozenset:
    """One of the strings occurs; no clause if one of them has no trigram."""
    each = {trigrams(s) for s in strings}
    # a conjunction that holds more trigrams than another adds nothing to the disjunction
    return frozenset() if not each or frozenset() in each else frozenset([Clause(a for a in each if not any(b < a for b in each))])


def _cross(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x, y in itertools.product(a, b)}


def _analyse(node: Node) -> _Info:
    kind = node[0]
    if kind == "lit":
        return _Info({node[1].lower()})
    if kind == "set":
        _, source, least, most = node
        members = set(source.replace("\\", "").lower()) if "-" not in source[1:-1] else set("?" * (MOST_STRINGS + 1))
        small = most == 1 and 0 < len(members) <= 4 and "-" not in source[1:-1] and "x20" not in source
        return _Info(members | ({""} if least == 0 else set())) if small else _Info(None)
    if kind == "group":
        return _analyse(node[1])
    if kind == "opt":
        inner = _analyse(node[1])
        return _Info(inner.exact | {""}) if inner.exact is not None else _Info(None)
    parts = [_analyse(n) for n in node[1:]]
    if kind == "alt":
        if all(p.exact is not None for p in parts):
            return _Info(set().union(*(p.exact for p in parts)))
        # one clause for the whole: the first clause of each branch, if all have one
        firsts = [next(iter(sorted(_full(p), key=len)), None) for p in parts]
        return _Info(None, clauses=frozenset() if None in firsts else frozenset([Clause(frozenset().union(*firsts))]))
    known = _Info({""})
    for p in parts:
        if known.exact is not None and p.exact is not None and len(known.exact) * len(p.exact) <= MOST_STRINGS:
            known = _Info(_cross(known.exact, p.exact), clauses=known.clauses | p.clauses)
            continue
        clauses = known.clauses | p.clauses
        tail = known.exact if known.exact is not None else known.suffix
        head = p.exact if p.exact is not None else p.prefix
        if len(tail) * len(head) <= MOST_STRINGS:
            clauses |= _clause(_cross(tail, head))
        clauses |= _clause(known.exact or set()) | _clause(p.exact or set())
        suffix = _cross(known.suffix, p.exact) if p.exact is not None and known.exact is None and len(p.exact) * len(known.suffix) <= MOST_STRINGS else p.exact if p.exact is not None else p.suffix
        prefix = known.exact if known.exact is not None else known.prefix
        known = _Info(None, prefix, suffix, clauses)
    return known


def _full(info: _Info) -> frozenset:
    return info.clauses | (_clause(info.exact) if info.exact is not None else _clause(info.prefix) | _clause(info.suffix))


def trigram_query(node: Node) -> list[list[list[str]]]:
    """Conjunction of disjunctions of conjunctions of trigrams; empty: no mandatory trigram."""
    return sorted(sorted(sorted(c) for c in clause) for clause in _full(_analyse(node)))


# --- rules -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``measured`` is the capture group (0: the match) that must have ``least`` characters."""

    kind: str
    tree: Node
    measured: int = 0
    least: int = 1
    either_case: bool = False

    @property
    def regex(self) -> str:
        return pattern(self.tree, self.either_case)


QUOTE, BLANK = chars("\"'", 0, 1), chars("\\x20", 0)
#: The base kinds, in the order in which spans at the same place are listed, and further kinds after them.
BASE_RULES = (
    Rule("assign", seq(group(alt(lit("password"), lit("passwd"), lit("secret"), lit("token"), seq(lit("api"), opt(lit("_")), lit("key")))), QUOTE, BLANK, chars(":=", 1, 1), BLANK, QUOTE, group(chars("A-Za-z0-9+/_.=-"))), 2, 6, True),
    Rule("access", seq(lit("AKIA"), chars("A-Z0-9")), 0, 20),
    Rule("hex", chars("0-9a-f"), 0, 24),
)
MORE_RULES = (
    Rule("pem", seq(lit("-----BEGIN "), chars("A-Z\\x20", 0), lit("PRIVATE KEY-----"))),
    Rule("hub", seq(lit("gh"), chars("pousr", 1, 1), lit("_"), chars("A-Za-z0-9")), 0, 40),
    Rule("chat", seq(lit("xox"), chars("abprs", 1, 1), lit("-"), chars("A-Za-z0-9-")), 0, 15),
    # parts of no more than 1000 characters: a part may begin inside another, so without a bound a long run of beginnings takes quadratic time
    Rule("jwt", seq(lit("eyJ"), chars("A-Za-z0-9_-", 1, 1000), lit("."), lit("eyJ"), chars("A-Za-z0-9_-", 1, 1000), lit("."), chars("A-Za-z0-9_-"))),
)
RULES = BASE_RULES + MORE_RULES


def build_index(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """Postings (trigram, key) of ``texts`` (key, text) for the trigrams ``wanted``; letters in lower case."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted))))
    return low.select("key", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...], wanted: list[str]) -> DataFrame:
    """Intersect postings: a row (key, rules) for each document that fulfils a rule's query.

    The postings of a document meet as one bit set, made by a sum that is combined before the shuffle.
    """
    bit = {t: i for i, t in enumerate(wanted)}
    words = -(-len(wanted) // 60)
    sums = [F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("trigram") % 60).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(f"b{w}") for w in range(words)]
    sets = postings.groupBy("key").agg(*sums)

    def all_of(names: list[str]) -> Column:
        out = F.lit(True)
        for w in range(words):
            if mask := sum(1 << bit[t] % 60 for t in names if bit[t] // 60 == w):
                out = out & (F.col(f"b{w}").bitwiseAND(F.lit(mask)) == mask)
        return out

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for clause in trigram_query(rule.tree):
            some = F.lit(False)
            for names in clause:
                some = some | all_of(names)
            out = out & some
        return out

    found = F.array_compact(F.array(*(F.when(holds(r), F.lit(r.kind)) for r in rules)))
    return sets.select("key", found.alias("rules")).filter(F.size("rules") > 0)


NO_SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"
#: Matches whose places are summed up together; both the sums inside such a group and those over groups stay short.
GROUP = 256


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of the rule's matches, leftmost first, in code points.

    An array that grows by one in each step of an aggregate is copied each time, so places are
    summed in groups of GROUP matches from 0, and the groups are then moved to where they begin.
    """
    regex = rule.regex
    between = F.transform(F.split(text, regex), lambda p: F.length(p))
    whole = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda m: F.length(m))
    measured = whole if rule.measured == 0 else F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(rule.measured)), lambda m: F.length(m))
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("size"), measured.alias("measured"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(NO_SPANS).alias("found"))
    span = lambda begin, end: F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))

    def step(state: Column, p: Column) -> Column:
        begin = state["end"] + p["gap"]
        end = begin + p["size"]
        return F.struct(end.alias("end"), F.when(p["measured"] >= rule.least, F.concat(state["found"], F.array(span(begin, end)))).otherwise(state["found"]).alias("found"))

    def grouped(ps: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(ps), F.lit(1)) - 1) / GROUP).cast("int"))
        return F.transform(firsts, lambda g: F.aggregate(F.slice(ps, g * GROUP + 1, F.lit(GROUP)), start, step))

    def moved(groups: Column) -> Column:
        none = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{NO_SPANS}>").alias("found"))
        shift = lambda s, g: F.array(F.transform(g["found"], lambda x: span(s["end"] + x["start"], s["end"] + x["end"])))
        return F.aggregate(groups, none, lambda s, g: F.struct((s["end"] + g["end"]).alias("end"), F.concat(s["found"], shift(s, g)).alias("found")), lambda s: F.flatten(s["found"]))

    # arrays of one element bind a value that lambdas use more than once
    return F.transform(F.transform(F.array(pairs), grouped), moved)[0]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Find secrets in every whole text: rows (doc_id, spans) with spans an array of
    (start, order, kind, end) by start, then by the order of ``rules``; end is exclusive.

    A row comes back for each row of ``docs``, repeated ones too. Null texts count as empty and
    have no spans; null doc_ids stay null. Other columns of ``docs`` are ignored, whatever their
    names. An empty table gives no rows. Rows with the same doc_id and equal texts are looked up as one.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    indexed = [r for r in rules if trigram_query(r.tree)]
    wanted = sorted({t for r in indexed for clause in trigram_query(r.tree) for names in clause for t in names})
    scanned = keyed
    if wanted:
        found = candidates(build_index(keyed, wanted), tuple(indexed), wanted)
        scanned = keyed.join(found.hint("merge"), "key", "left")  # candidates grow with the texts, so they are no side to broadcast
    else:
        scanned = keyed.withColumn("rules", F.array().cast("array<string>"))
    spans = []
    for order, rule in enumerate(rules):
        none = F.array().cast(NO_SPANS)
        if rule in indexed:
            spans.append(F.when(F.array_contains("rules", rule.kind), rule_spans(F.col("text"), rule, order)).otherwise(none))
        else:
            least = rule.regex[:-1] + f"{{{rule.least}}}" if rule.regex.endswith("+") and rule.tree[0] == "set" else rule.regex
            spans.append(F.when(F.col("text").rlike(least), rule_spans(F.col("text"), rule, order)).otherwise(none))
    return scanned.select(F.col("key.doc_id").alias("doc_id"), F.array_sort(F.flatten(F.array(*spans))).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
