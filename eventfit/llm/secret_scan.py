"""Secret scans with a trigram inverted index, with DataFrame operations only.

Every rule is a regular expression. A Boolean trigram query is derived from
the expression itself: an OR over alternatives of ANDs over the trigrams that
each match of the alternative must hold. The index maps those trigrams to the
texts that hold them; postings are intersected to find candidate texts, and
only those are verified by the expression. A rule without mandatory trigrams
scans all texts.
"""

from __future__ import annotations

import re._constants as sre
from dataclasses import dataclass
from re._parser import parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle


@dataclass(frozen=True)
class Rule:
    """``group``/``least``: a match counts if that group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The base kinds first, then those that the method adds, in the order of ties.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    # of one class of characters, so the least length can stand in the expression without changing any span
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
KINDS = tuple(r.kind for r in RULES)
PLACEHOLDER = "[SECRET]"


def trigrams(literal: str) -> set[str]:
    return {literal[i:i + 3] for i in range(len(literal) - 2)}


#: A class of at most so many letters is spelt out; so many alternatives are followed at most, and so many repetitions.
CLASS_LETTERS, ALTERNATIVES, REPEATS = 8, 64, 4
_GAP = None  # any characters, or none: trigrams don't reach across


def _runs(spelt: tuple) -> list[str]:
    return "".join("\0" if c is _GAP else c for c in spelt).split("\0")


def _longest(alternatives: list[tuple]) -> int:
    """The letters in a row that every alternative holds at least."""
    return min(max(map(len, _runs(a))) for a in alternatives)


def _joined(left: list[tuple], right: list[tuple]) -> list[tuple]:
    """Every alternative of one part followed by every one of the next; of too many, the part that asks for less becomes a gap."""
    if len(left) * len(right) > ALTERNATIVES:
        left, right = (left, [(_GAP,)]) if _longest(left) >= _longest(right) else ([(_GAP,)], right)
    return list(dict.fromkeys(a + b for a in left for b in right))


def _letters(items: list) -> list[tuple]:
    """The letters of a character class, if they are few."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 2 * CLASS_LETTERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return [(_GAP,)]
    return [(c,) for c in sorted(found)] if len(found) <= CLASS_LETTERS else [(_GAP,)]


def _alternatives(nodes) -> list[tuple]:
    """What the matches of a parsed expression spell in lower case: alternatives of letters and gaps."""
    out: list[tuple] = [()]
    for op, value in nodes:
        if op is sre.LITERAL:
            own = [(chr(value).lower(),)]
        elif op is sre.IN:
            own = _letters(value)
        elif op is sre.SUBPATTERN:
            own = _alternatives(value[3])
        elif op is sre.BRANCH:
            own = [a for branch in value[1] for a in _alternatives(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = _alternatives(inner)
            own = [()]
            for _ in range(min(least, REPEATS)):
                own = _joined(own, once)
            if (least, most) == (0, 1):
                own = [(), *once]
            elif most > least or least > REPEATS:
                own = _joined(own, [(_GAP,)])
        elif op is sre.ATOMIC_GROUP:
            own = _alternatives(value)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            own = [()]  # matches no characters
        else:
            own = [(_GAP,)]
        out = _joined(out, own if len(own) <= ALTERNATIVES else [(_GAP,)])
    return out


def query_of(rule: Rule) -> tuple[tuple[str, ...], ...]:
    """The rule's trigram query, derived from its expression: alternatives, each the trigrams that must all occur.

    Empty if some alternative has no trigram: the rule is then scanned in full.
    Trigrams are of lower-cased text, whether or not the rule minds the case.
    """
    found = []
    for spelt in _alternatives(parse(rule.pattern)):
        found.append(tuple(sorted(set().union(*map(trigrams, _runs(spelt))))))
    # an alternative whose trigrams hold another's asks for nothing beyond it
    least = [q for q in dict.fromkeys(found) if not any(set(o) < set(q) for o in found)]
    return tuple(sorted(least)) if all(least) else ()


def postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index ``(trigram, row_key)`` for the trigrams that the rules ask for; ``texts(row_key, text)``."""
    wanted = sorted({t for r in rules for alternative in query_of(r) for t in alternative})
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return texts.select("row_key", F.lower("text").alias("low")).select(F.explode(found).alias("trigram"), "row_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(row_key, kinds)``: the rules whose trigram query each text fulfils, by intersecting postings.

    The postings of a text meet in its own small group (at most one row for
    each trigram asked for), so a common trigram burdens no task.
    """
    holds = index.groupBy("row_key").agg(F.collect_set("trigram").alias("have"))
    kinds = []
    for r in rules:
        if q := query_of(r):
            fits = [F.size(F.array_except(F.array(*[F.lit(t) for t in alternative]), F.col("have"))) == 0 for alternative in q]
            any_ = fits[0]
            for x in fits[1:]:
                any_ = any_ | x
            kinds.append(F.when(any_, F.lit(r.kind)))
    return holds.select("row_key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of ``(start, end, kind)`` of the rule's matches: leftmost, non-overlapping, in code points.

    The text between the matches and the matches themselves are taken by the
    same expression, so running sums of their lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(held, F.length).alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    ran = F.aggregate(
        F.filter(steps, lambda s: s["size"].isNotNull()), start,
        lambda a, s: F.struct((a["at"] + s["gap"] + s["size"]).alias("at"), F.when(s["held"] < rule.least, a["out"]).otherwise(
            F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["size"]).alias("end"))))).alias("out")),
        lambda a: a["out"])
    return F.transform(ran, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(rule.kind)).alias("kind"), s["end"].alias("end")))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``(texts, hits)``: the rows with a key, and ``(row_key, spans)`` for those rows that hold secrets.

    ``docs`` needs ``doc_id`` and ``text``; its other columns come along. The
    key is the id with a hash of the text, so copies under many ids do not
    meet in one task. Nulls and empty texts hold none.
    """
    texts = docs.withColumn("row_key", F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    scanned = [r for r in rules if not query_of(r)]
    indexed = [r for r in rules if query_of(r)]
    hits = None
    if indexed:
        found = settle(candidates(postings(texts.select("row_key", "text"), indexed), indexed), "secret_candidates")
        one = texts.select("row_key", "text").join(found, "row_key").dropDuplicates(["row_key"])
        parts = [F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r)).otherwise(_none()) for r in indexed]
        hits = one.select("row_key", F.concat(*parts).alias("spans")).where(F.size("spans") > 0)
    for r in scanned:
        full = texts.select("row_key", "text").where(F.col("text").rlike(r.pattern)).dropDuplicates(["row_key"]).select("row_key", spans_of(F.col("text"), r).alias("spans")).where(F.size("spans") > 0)
        hits = full if hits is None else hits.unionByName(full)
    merged = hits.groupBy("row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))
    return texts, settle(merged, "secret_hits")


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with ``spans``: ``(start, kind, end)`` by start, then kind.

    Null and empty texts have an empty array; null or repeated ids get a row
    each; spans that begin together come in the order of the kinds; a very long
    text is one row's work; other columns are ignored; an empty table gives an
    empty result.
    """
    texts, hits = find_secrets(docs.select("doc_id", "text"), rules)
    keys = texts.select("doc_id", "row_key")
    return keys.join(hits, "row_key", "left").select("doc_id", F.coalesce("spans", _none()).alias("spans"))


def spans_text(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end``, comma-joined, of all spans or of the base kinds."""
    names = F.array(*[F.lit(k) for k in KINDS])
    if base_only:
        n = sum(r.base for r in RULES)
        spans = F.filter(spans, lambda s: s["kind"] < n)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with every secret replaced; overlapping spans become one placeholder.

    Other columns are unchanged, whatever their names. Null texts stay null,
    empty ones empty; rows with null or repeated ids are each answered; very
    long texts are one row's work, as their secrets are found by expressions;
    of spans that begin together the longer one counts; an empty table stays empty.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    texts, hits = find_secrets(whole, rules)
    joined = texts.join(hits.select("row_key", F.col("spans").alias("secret_spans")), "row_key", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return (F.when(s["end"] <= a["at"], a)
                .when(s["start"] < a["at"], F.struct(s["end"].alias("at"), a["out"].alias("out")))
                .otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], gap, F.lit(placeholder)).alias("out"))))

    clean = F.aggregate("secret_spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.lit(2**31 - 1))))
    text = F.when(F.col("secret_spans").isNotNull(), clean).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("whole_row").getField(c).alias(c) for c in docs.columns])
