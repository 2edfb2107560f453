"""Secret scanning through a trigram inverted index, DataFrame functions only.

1. Each rule's regular expression gives a Boolean trigram query: for every
   run of literals that a match must hold, one of a few strings, each the AND
   of its trigrams (lower case).
2. The inverted index holds, for every trigram that some query names, the
   documents whose lower-cased text has it.
3. Postings are intersected per rule by counting; the candidates' whole texts
   are verified with the regular expression. Rules without a mandatory
   trigram verify every document.

Spans are code points, end exclusive, leftmost and non-overlapping per rule.
``split`` gives the lengths of the gaps between the matches that
``regexp_extract_all`` gives, hence the positions.

Defined results: null text is empty; repeated rows are scanned alike; rows
with one key share their candidates (verification keeps that exact), null
keys too; an empty table gives no rows; other columns pass through, those
named like a result are replaced.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

parser = re._parser  # the syntax tree of a regular expression

MOST_STRINGS = 24  # alternatives that one run of literals may have before it is cut


class Rule(NamedTuple):
    """A match counts if its ``group`` has ``least`` code points or more."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules of the result contract, in its order. Runs of
# one class are taken whole, so a least length may stand in the pattern;
# for "assign" a short match still uses up its text.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Well-known public token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# -- Boolean trigram queries ------------------------------------------------

def _runs(tree) -> list[set[str] | None]:
    """Sets of strings, one of which every match holds at that place, in
    order; None where anything may stand."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg)})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            out.append({chr(c) for _, c in arg})
        elif name == "SUBPATTERN":
            out += _runs(arg[3])
        elif name == "BRANCH":
            whole = [_whole(_runs(branch)) for branch in arg[1]]
            out.append(set().union(*whole) if all(w is not None for w in whole) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            once = _whole(_runs(inner))
            if once is not None and (low, high) == (0, 1):
                out.append({""} | once)
            elif once is not None and low == high and low <= 4:
                out += [once] * low
            else:
                out.append(None)
        elif name != "AT":
            out.append(None)
    return out


def _whole(runs: list[set[str] | None]) -> set[str] | None:
    """The strings of a finite expression."""
    if any(r is None for r in runs):
        return None
    strings = {"".join(p) for p in itertools.product(*runs)}
    return strings if len(strings) <= MOST_STRINGS else None


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of ORs of ANDs of trigrams that any match implies; empty when the
    expression has no mandatory trigram."""
    query, current = [], {""}

    def close() -> None:
        if current and min(map(len, current)) >= 3:
            clauses = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in current}
            query.append(sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted))

    for run in [*_runs(parser.parse(pattern)), None]:
        if run is None:
            close()
            current = {""}
            continue
        joined = {a + b.lower() for a in current for b in run}
        if len(joined) > MOST_STRINGS:
            close()
            joined = {b.lower() for b in run}
        current = joined
    return query


# -- the index ----------------------------------------------------------------

def trigram_index(docs: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """(trigram, key): postings of the trigrams that queries name."""
    lowered = docs.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_low"))  # once, not per trigram
    held = F.array_compact(F.array(*[F.when(F.col("_low").contains(F.lit(t)), F.lit(t)) for t in trigrams]))
    # explode_outer: for explode the optimizer would evaluate the whole array once more, as a filter
    return lowered.select("_key", F.explode_outer(held).alias("trigram")).where("trigram IS NOT NULL")


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _rules): for the documents that satisfy some rule's query, the
    kinds of those rules."""
    spark = docs.sparkSession
    terms, sizes = [], {}
    for r in rules:
        query = trigram_query(r.pattern)
        sizes[r.kind] = len(query)
        terms += [(r.kind, i, j, len(clause), t) for i, any_of in enumerate(query)
                  for j, clause in enumerate(any_of) for t in sorted(clause)]
    index = trigram_index(docs, sorted({t[-1] for t in terms}), key, text)
    queries = spark.createDataFrame(terms, "kind string, run int, clause int, size int, trigram string")
    # the table of queries is as large as the rules: a few rows per rule
    met = (index.join(F.broadcast(queries), "trigram").groupBy("_key", "kind", "run", "clause", "size")
           .agg(F.count_distinct("trigram").alias("n")).where("n = size"))
    runs = met.groupBy("_key", "kind").agg(F.count_distinct("run").alias("n"))
    wanted = F.create_map(*itertools.chain(*[(F.lit(k), F.lit(n)) for k, n in sizes.items()]))
    return runs.where(F.col("n") == wanted[F.col("kind")]).groupBy("_key").agg(
        F.collect_set("kind").alias("_rules"))


# -- verification -----------------------------------------------------------------

SPAN = "array<struct<start: int, kind_no: int, end: int, kind: string>>"


STEP = 256     # matches whose places are added up in one go


def _places(sizes: Column) -> Column:
    """(begin of each step's match, end) from structs (g: gap before, m: match).
    Running sums inside parts of STEP matches and over the parts: an array that
    grows by one entry at a time is copied each time, so none grows long."""
    def running(items: Column, start: Column, size) -> Column:
        def add(state: Column, x: Column) -> Column:
            return F.struct((state["at"] + size(x)).alias("at"), F.concat(state["upto"], F.array(state["at"])).alias("upto"))

        return F.aggregate(items, F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("upto")), add)["upto"]

    zero = F.lit(0).cast("long")
    count = F.ceil(F.size(sizes) / STEP).cast("int")
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
                                          lambda i: F.slice(sizes, i * STEP + 1, F.lit(STEP))))
    parts = F.coalesce(parts, F.array().cast("array<array<struct<g: bigint, m: bigint, t: bigint>>>"))
    totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda n, x: n + x["g"] + x["m"]))
    starts = running(totals, zero, lambda n: n)
    return F.flatten(F.zip_with(parts, starts, lambda p, s: F.zip_with(
        p, running(p, s, lambda x: x["g"] + x["m"]),
        lambda x, at: F.struct((at + x["g"]).alias("begin"), (at + x["g"] + x["m"]).alias("stop"), x["t"].alias("t")))))


def _spans(rule: Rule, no: int, text: Column) -> Column:
    """All spans of one rule in a whole text."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(F.arrays_zip(found.alias("m"), tested.alias("t")), gaps, lambda mt, g: F.struct(
        F.length(g).cast("long").alias("g"), F.coalesce(F.length(mt["m"]), F.lit(0)).cast("long").alias("m"),
        F.length(mt["t"]).cast("long").alias("t")))
    kept = F.filter(_places(sizes), lambda s: s["t"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(
        s["begin"].cast("int").alias("start"), F.lit(no).alias("kind_no"), s["stop"].cast("int").alias("end"),
        F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: structs (start, kind_no, end, kind) by start,
    then by the order of the rules."""
    hits = candidates(docs, rules, key, text)
    joined = docs.drop("spans").join(hits, F.col(key).eqNullSafe(F.col("_key")), "left")
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    parts = []
    for no, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            parts.append(F.when(F.array_contains("_rules", rule.kind), _spans(rule, no, whole)).otherwise(none))
        else:
            parts.append(F.when(whole.rlike(rule.pattern), _spans(rule, no, whole)).otherwise(none))
    return joined.withColumn("spans", F.array_sort(F.concat(*parts))).drop("_key", "_rules")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping
    spans become one."""
    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.when(fresh, F.concat(state["out"], text.substr(state["at"] + 1, s["start"] - state["at"]),
                                      F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), kept.alias("out"))

    state = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add)
    return F.when(F.size(spans) > 0, F.concat(state["out"], text.substr(state["at"] + 1, F.length(text)))).otherwise(text)
