"""Secret scans by a trigram inverted index. Built-in functions only.

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. The index holds,
for the trigrams that some rule asks for, the documents with them; its postings are intersected to candidates,
and only those are scanned with the expression. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealmark.functions.columns import fresh


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (leftmost, not overlapping) whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


#: The first three are the base.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge_token", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
)
_MOST = 24


def _literals(items, any_case: bool) -> tuple[list[frozenset[str]], set[str] | None]:
    """Clauses (each a set of alternative strings) that a match contains, and all its strings when they are few."""
    clauses: list[frozenset[str]] = []
    exact: set[str] = {""}

    def flush():
        nonlocal exact
        if all(len(s) >= 3 for s in exact):
            clauses.append(frozenset(exact))
        exact = {""}

    for op, arg in items:
        own: set[str] | None = None
        if op is sre.LITERAL:
            own = {chr(arg).lower() if any_case else chr(arg)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            own = {chr(a).lower() if any_case else chr(a) for _, a in arg}
        elif op is sre.SUBPATTERN:
            inner, own = _literals(arg[3], any_case)
            if own is None:
                flush()
                clauses += inner
                continue
        elif op is sre.BRANCH:
            parts = [_literals(x, any_case) for x in arg[1]]
            own = set().union(*(p[1] for p in parts)) if all(p[1] is not None for p in parts) else None
        elif op is sre.MAX_REPEAT:
            lo, hi, inner_items = arg
            inner, strings = _literals(inner_items, any_case)
            if (lo, hi) == (0, 1) and strings is not None and len(exact) * (len(strings) + 1) <= _MOST and exact != {""} and all(len(s) < 3 for s in exact):
                own = {"", *strings}
            elif (lo, hi) == (0, 1) and strings is not None and len(exact) == 1 and len(strings) == 1 and exact != {""}:
                own = {"", *strings}
            else:
                flush()
                if lo:
                    clauses += inner
                continue
        if own is None or len(exact) * len(own) > _MOST:
            flush()
            exact = own if own is not None and len(own) <= _MOST else {""}
        else:
            exact = {a + b for a in exact for b in own}
    if clauses or len(exact) > _MOST:
        flush()
        return clauses, None
    return clauses, exact


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets: for each clause, one of its sets is in the text as a whole."""
    clauses, exact = _literals(list(parser.parse(rule.pattern)), rule.any_case)
    if exact is not None and all(len(s) >= 3 for s in exact):
        clauses = [frozenset(exact)]
    return [sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in c}, key=sorted) for c in clauses]


def postings(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, folded, doc): the inverted index over the trigrams of the rules' queries; folded ones ignore case."""
    wanted = sorted({(t, r.any_case) for r in rules for c in trigram_query(r) for s in c for t in s})
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("plain"))
    text = text.where("plain is not null").withColumn("lower", F.lower("plain"))
    grams = F.array(*(F.struct(F.lit(t).alias("trigram"), F.lit(fold).alias("folded")) for t, fold in wanted))
    there = F.filter(grams, lambda g: F.contains(F.when(g["folded"], F.col("lower")).otherwise(F.col("plain")), g["trigram"]))
    return text.select("doc", F.explode(there).alias("g")).select("g.trigram", "g.folded", "doc")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, kinds): per document the rules whose trigram query it meets. Rules without a query aren't listed."""
    asks = []
    for r in rules:
        for k, clause in enumerate(trigram_query(r)):
            for j, grams in enumerate(clause):
                asks += [(r.kind, len(trigram_query(r)), k, j, len(grams), t, r.any_case) for t in sorted(grams)]
    if not asks:
        return docs.select(F.col(id_col).alias("doc"), F.array().cast("array<string>").alias("kinds")).limit(0)
    names = ("kind", "clauses", "clause", "option", "size", "trigram", "folded")
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, a))) for a in asks))
    ask = docs.sparkSession.range(1).select(F.explode(table).alias("a")).select("a.*")  # one row per trigram of a rule
    hits = postings(docs, id_col, text_col, rules).distinct().join(F.broadcast(ask), ["trigram", "folded"])
    whole = hits.groupBy("doc", "kind", "clauses", "clause", "option", "size").agg(F.count("*").alias("n")).where("n = size")
    met = whole.groupBy("doc", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in text: array of struct(start, end) in code points."""
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    gaps = F.split(text, pattern, -1)  # what stands before, between and after the matches
    steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), tested, lambda s, t: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(t).alias("tested")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())
    steps = F.transform(steps, lambda s: F.struct((s["gap"] + s["size"]).alias("upto"), s["size"].alias("size"), s["tested"].alias("tested")))
    # running sums by doubling steps: after the k-th, upto covers 2^k matches; a text has fewer than its length
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.length(text) + 2.0)).cast("int"))
    ahead = lambda acc, s, i, k: s["upto"] + F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), k).cast("int"))["upto"], F.lit(0))
    summed = F.aggregate(
        doublings, steps,
        lambda acc, k: F.transform(acc, lambda s, i: F.struct(ahead(acc, s, i, k).alias("upto"), s["size"].alias("size"), s["tested"].alias("tested"))),
    )
    whole_ones = F.filter(summed, lambda s: s["tested"] >= rule.least)
    return F.transform(whole_ones, lambda s: F.struct((s["upto"] - s["size"]).alias("start"), s["upto"].alias("end")))


def _named(of_rule):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *of_rule)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `secrets`: array of struct(start, end, nr, kind) of all rules' matches, by start, then rule order.

    Positions are code points, end exclusive. Null or empty text: no spans. A very long text costs time in proportion
    to its length and to matches times the logarithm of its length. Spans that start together stand in rule order.
    An empty table gives no rows. A null id is a value of its own in the
    index; rows that repeat an id are scanned for the rules that any of them may match. A column of docs named
    `secrets` is replaced, others pass through whatever their names; repeated rows stay.
    """
    doc, kinds = fresh("secret_doc", docs), fresh("secret_kinds", docs)
    found = candidates(docs, id_col, text_col, rules).withColumnsRenamed({"doc": doc, "kinds": kinds})
    base = docs.drop("secrets")
    rows = base.join(found, base[id_col].eqNullSafe(found[doc]), "left")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,nr:int,kind:string>>")
    all_spans = []
    for nr, rule in enumerate(rules):
        of_rule = (F.lit(nr).alias("nr"), F.lit(rule.kind).alias("kind"))
        named = F.transform(_spans(text, rule), _named(of_rule))
        if trigram_query(rule):
            ask = F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))
        elif rule.group == 0 and rule.least:
            # a run of the least length: most documents have none, and need no list of all their short runs
            ask = text.rlike(rule.pattern[:-1] + f"{{{rule.least}}}") if rule.pattern.endswith("]+") else F.lit(True)
        else:
            ask = F.lit(True)
        all_spans.append(F.when(ask, named).otherwise(none))
    rows = rows.withColumn("secrets", F.sort_array(F.concat(*all_spans)))
    return rows.drop(doc, kinds)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
