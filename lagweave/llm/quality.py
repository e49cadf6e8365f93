"""Quality rules: a short-circuit cascade whose order comes from measured rejection per cost.

Costs and selectivities are measured on a random sample of the whole table: each rule is run over the sample by itself and timed, and
one pass over it counts which rules reject which rows. Then the rule that rejects most per second comes first, the next one is
chosen by what it rejects of the rest, and so on. The base rules are rules like the others: in ``keep`` the costly search for
repeated windows runs only on rows that cheaper rules have let through. The sample sets the order and the reported reason, never which
rows are kept: a row is kept if no rule rejects it.

Everything runs as DataFrame expressions inside the JVM; no row leaves its partition, so a hot source or
a huge group of copies changes nothing.

Defined cases: a null text counts as the empty text; a text without words has ``n_words`` 0 and fails the base rules; a very long text is
judged whole; repeated rows get a verdict each; rules of equal rejection per cost are ordered by name; an empty table gives an empty
result; columns of the input other than ``doc_id`` and ``text`` are ignored by ``score`` and kept by ``keep``, whatever their names;
``measured`` adds columns to its input, whose own names must not be among them nor begin with two underscores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.shared import materialize

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Low bits of a packed window hold its position. An array of 2**28 words takes more than the 2 GB that Spark lets an array take.
_POSITION_BITS = 28
_POSITION = (1 << _POSITION_BITS) - 1
#: Rows of the sample, about, and how often each rule is timed on it (the least time counts).
SAMPLE, TIMES = 1000, 2


@dataclass(frozen=True)
class Rule:
    """``rejects``: true for rows to reject, as an expression over ``__text``, ``__words`` (an array) and ``n_words``."""

    name: str
    rejects: Column


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_words(df: DataFrame) -> DataFrame:
    """``df`` with ``__text``, ``__words`` and ``n_words`` of its column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("__text", text).withColumn("__trimmed", F.btrim("__text", F.lit(BLANKS)))
    words = F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", BLANK_RUN))
    return df.withColumn("__words", words).drop("__trimmed").withColumn("n_words", F.size("__words").cast("long"))


def _places_exactly(words: Column) -> Column:
    """Positions of the 3-word windows found twice or more, in order; windows are compared as they are."""
    word = lambda i: F.get(words, i)
    windows = F.transform(words, lambda w, i: F.struct(w.alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("at")))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def found(s: Column) -> Column:
        return F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | F.when(k > 0, same(x, F.get(s, k - 1))).otherwise(False))

    ordered = F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))
    return _let(ordered, lambda s: F.sort_array(F.transform(found(s), lambda x: x["at"].cast("long"))))


def _packed(words: Column) -> Column:
    """Each 3-word window as (36 bits of hash, 28 bits of position) in one long, sorted."""
    word = lambda i: F.get(words, i)
    packed = F.transform(words, lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("long")))
    return F.sort_array(F.slice(packed, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def _links(words: Column, packed: Column) -> Column:
    """Of each packed window and the next one, 1: they are equal, 2: only their hash bits are, 0: neither."""
    word = lambda i: F.get(words, i)
    at = lambda x: x.bitwiseAND(F.lit(_POSITION)).cast("int")
    bits = lambda x: F.shiftright(x, _POSITION_BITS)

    def link(x: Column, y: Column) -> Column:
        same = F.lit(True)
        for j in range(3):
            same = same & (word(at(x) + j) == word(at(y) + j))
        return F.when(bits(x) == bits(y), F.when(same, F.lit(1)).otherwise(F.lit(2))).otherwise(F.lit(0))

    return F.transform(packed, lambda x, k: link(x, F.get(packed, k + 1)))


def _places(words: Column, packed: Column, links: Column) -> Column:
    kept = F.filter(packed, lambda x, k: (F.get(links, k) == 1) | F.when(k > 0, F.get(links, k - 1) == 1).otherwise(False))
    quick = F.sort_array(F.transform(kept, lambda x: x.bitwiseAND(F.lit(_POSITION))))
    return F.when(F.array_contains(links, 2), _places_exactly(words)).otherwise(quick)


def _covered(places: Column) -> Column:
    steps = F.transform(places, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, i + 1), x + 3) - x))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def repeat_words(words: Column) -> Column:
    """The number of words in 3-word windows found twice or more.

    A primitive sort of packed windows brings equal ones together in position order, and neighbours with equal hash bits are
    compared word by word. If such neighbours differ, bits of different windows may lie between equal ones: that text is sorted by
    its windows themselves.
    """
    return _let(_packed(words), lambda s: _let(_links(words, s), lambda near: _let(_places(words, s, near), _covered)))


def with_repeat_words(df: DataFrame) -> DataFrame:
    """The same for every row, step by step in columns, which compiled projections take faster than one nested expression."""
    words = F.col("__words")
    df = df.withColumn("__packed", _packed(words)).withColumn("__links", _links(words, F.col("__packed")))
    df = df.withColumn("__places", _places(words, F.col("__packed"), F.col("__links")))
    return df.withColumn("n_repeat_words", _covered(F.col("__places"))).drop("__packed", "__links", "__places")


def word_chars() -> Column:
    return F.length(F.translate("__text", BLANKS, "")).cast("long")


def n_symbols() -> Column:
    return (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long")


def line_counts() -> Column:
    """``n`` lines with a word, ``dup`` of them equal to an earlier one."""
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def may_repeat(words: Column) -> Column:
    """False only where repeated words are at most half of all. A window found m times is m places and (m - 1) fewer distinct
    windows, so places are at most twice the windows less the distinct ones, with three words each; equal hashes only add to that."""
    word = lambda i: F.get(words, i)
    windows = F.greatest(F.size(words) - 2, F.lit(0))
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2))), F.lit(1), windows)
    return 100 * 6 * (windows - F.size(F.array_distinct(hashes))).cast("long") > 50 * F.size(words)


def base_rules(repeated: Column | None = None) -> list[Rule]:
    """The contract's own rules; ``repeated``: the number of repeated words where it is known already."""
    words = F.col("__words")
    repeats = may_repeat(words) & (100 * repeat_words(words) > 50 * F.col("n_words")) if repeated is None else 100 * repeated > 50 * F.col("n_words")
    return [Rule("few_words", F.col("n_words") < 50), Rule("repeats", repeats)]


def default_rules(known: bool = False) -> list[Rule]:
    """Rules beside the base ones. Thresholds are far from clean prose: they reject markup, tables and shouting.

    ``known``: the base measures are columns already.
    """
    text, words = F.col("__text"), F.col("n_words")
    chars, symbols, lines = (F.col("word_chars"), F.col("n_symbols"), F.col("__lines")) if known else (word_chars(), n_symbols(), line_counts())
    shouts = F.length(text) - F.length(F.translate(text, "!", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return [
        Rule("symbols", 4 * symbols > words),
        Rule("dup_lines", _let(lines, lambda x: 2 * x["dup"] > x["n"])),
        Rule("word_length", _let(chars, lambda n: (n > 25 * words) | (n < 2 * words))),
        Rule("shouts", 4 * shouts > words),
        Rule("capitals", 2 * capitals > chars),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Texts of about ``rows`` random rows of the whole table, with their words, in one partition of the shared folder."""
    n = docs.count()
    share = min(1.0, rows / max(n, 1))
    return with_words(materialize(docs.select("text").sample(fraction=share, seed=7).repartition(1), "sample"))


def costs(sample: DataFrame, rules: Sequence[Rule], times: int = TIMES) -> list[float]:
    """Seconds that each rule takes over the sample, beyond those for its words, which all rules share."""

    def seconds(rejects: Column) -> float:
        least = float("inf")
        for _ in range(times):
            begin = time.perf_counter()
            # a plan of its own each time: a plan that has run keeps its shuffled sums
            sample.select("n_words", rejects.alias("r")).agg(F.max("n_words"), F.count_if(F.col("r"))).collect()
            least = min(least, time.perf_counter() - begin)
        return least

    idle = seconds(F.lit(False))
    return [max(seconds(r.rejects) - idle, 1e-4) for r in rules]


def order_rules(sample: DataFrame, rules: Sequence[Rule], cost: Sequence[float] | None = None) -> list[Rule]:
    """Rules by rejection per cost over ``sample``; ties by name.

    The greedy order re-estimates: after a rule is placed, the next one is chosen by what it rejects among
    the rows that are left, as the bit masks of rejections are counted.
    """
    cost = costs(sample, rules) if cost is None else cost
    mask = sum((F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(1 << k)).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
    alive = [(r["m"], r["n"]) for r in sample.select(mask.alias("m")).groupBy("m").agg(F.count("*").alias("n")).collect()]  # at most a row of the sample each
    left, order = list(range(len(rules))), []
    while left:
        best = min(left, key=lambda k: (-sum(n for m, n in alive if m >> k & 1) / cost[k], rules[k].name))
        order.append(rules[best])
        left.remove(best)
        alive = [x for x in alive if not x[0] >> best & 1]
    return order


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, else null. CASE evaluates no condition after that one."""
    out = F.when(rules[0].rejects, F.lit(rules[0].name))
    for r in rules[1:]:
        out = out.when(r.rejects, F.lit(r.name))
    return out


def _fenced(df: DataFrame) -> DataFrame:
    """Catalyst would push a condition below the projections and so split texts again inside its expressions, once for each
    word; it moves none across a column that is not deterministic."""
    return df.withColumn("__fence", F.monotonically_increasing_id())


def judged(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``docs`` with words, ``reason`` and ``kept``, rules taken in the given order."""
    df = _fenced(with_words(docs)).withColumn("reason", cascade(rules))
    return df.withColumn("kept", F.col("reason").isNull() & (F.col("__fence") >= 0))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures of every row."""
    df = with_words(docs).withColumn("word_chars", word_chars()).withColumn("n_symbols", n_symbols())
    df = df.withColumn("__lines", line_counts()).withColumn("n_dup_lines", F.col("__lines.dup"))
    df = _fenced(with_repeat_words(df))
    few, repeats = base_rules(F.col("n_repeat_words"))
    return df.withColumn("base_failed", few.rejects | repeats.rejects)


def score(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, ``base_failed``, ``kept`` and the ``reason`` of a rejection.

    The measures are asked of every row, so here the cascade begins with them and saves work of the other rules only.
    """
    docs = docs.select("doc_id", "text")
    known = {r.name: r for r in default_rules(known=True)}
    order = base_rules(F.col("n_repeat_words")) + [known[r.name] for r in order_rules(sample_of(docs), default_rules())]
    df = measured(docs).withColumn("reason", cascade(order))
    df = df.withColumn("kept", F.col("reason").isNull() & (F.col("__fence") >= 0))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


def keep(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that the base rules and ``rules`` keep, with all their columns.

    The cascade sees each row where it lies: columns are carried in a struct, so no name can clash.
    """
    rules = base_rules() + list(default_rules() if rules is None else rules)
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs["text"].alias("text"))
    return judged(carried, order_rules(sample_of(docs), rules)).where("kept").select("__row.*")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM dup, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
m AS (SELECT w.r, doc_id, t, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars > 25 * n_words OR word_chars < 2 * n_words
            OR 4 * length(regexp_replace(t, '[^!]+', '', 'g')) > n_words
            OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > word_chars) AS kept
FROM b
"""
