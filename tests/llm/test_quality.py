import re
from collections import defaultdict

from pyspark.sql import functions as F

from lagweave.llm import quality

BLANK = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(3)}
    n = len(words)
    base = n < 50 or 100 * len(covered) > 50 * n
    chars, symbols, dups = sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines))
    capitals = sum(c.isupper() for c in text)
    kept = not (base or 4 * symbols > n or 2 * dups > len(lines) or chars > 25 * n or chars < 2 * n or 4 * text.count("!") > n or 2 * capitals > chars)
    return n, chars, symbols, dups, len(covered), base, kept


PROSE = " ".join(f"wörd{i} of text" for i in range(40))
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a a", PROSE, PROSE + "\n" + PROSE, "x\x0by\x1cz é日", "A\nA\n A\n\nB", "the end " * 30000,
    PROSE.upper(), " | ".join(PROSE.split()), "!! ".join(PROSE.split()), "\n".join([*PROSE.split(), *PROSE.split()]), "a" * 5000, ". ".join("abcdefghijklmnopqrstuvwxyz" * 5),
]


def rows(df):
    return {r["doc_id"]: tuple(r)[1:8] for r in df.collect()}


def test_matches_plain_python(spark):
    df = spark.createDataFrame([(i, t, True, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept boolean, n_words int").repartition(3)
    scored = quality.score(df)
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in scored.collect()} == {i: brute(t) for i, t in enumerate(TEXTS)}
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(TEXTS) if brute(t)[6]]
    few = df.where("doc_id not in (6, 7)").unionByName(df.where("doc_id = 6")).unionByName(df.where("doc_id = 6"))
    assert quality.keep(few).where("doc_id = 6").count() == 2
    assert quality.keep(df.limit(0)).count() == 0 and quality.score(df.limit(0)).count() == 0


def test_order_is_by_rejection_per_cost_and_changes_no_verdict(spark):
    df = spark.createDataFrame([(i, f"{PROSE} {'!' * i}") for i in range(100)], "doc_id long, text string")
    shouts = F.length("__text") - F.length(F.translate("__text", "!", ""))
    cheap, dear, idle = (quality.Rule(n, shouts >= k) for n, k in (("cheap", 50), ("dear", 40), ("idle", 1000)))
    sample = quality.sample_of(df, 1000)
    assert [r.name for r in quality.order_rules(sample, [dear, idle, cheap], [1.0, 1e-4, 0.01])] == ["cheap", "dear", "idle"]
    assert [r.name for r in quality.order_rules(sample, [dear, idle, cheap], [0.01, 1e-4, 0.01])] == ["dear", "cheap", "idle"]
    # ties go by name
    assert [r.name for r in quality.order_rules(sample, [quality.Rule("b", shouts >= 5), quality.Rule("a", shouts >= 5)], [1.0, 1.0])] == ["a", "b"]
    verdicts = [sorted(r["doc_id"] for r in quality.judged(df, rules).where("kept").select("doc_id").collect()) for rules in ([cheap, dear], [dear, cheap])]
    assert verdicts[0] == verdicts[1] == list(range(40))


def test_costs_are_measured(spark):
    df = spark.createDataFrame([(i, f"{PROSE} " * 40) for i in range(200)], "doc_id long, text string")
    sample = quality.sample_of(df, 1000)
    dear = F.length(F.regexp_replace(F.regexp_replace("__text", "(o|f|t|e|x)+", "y"), r"[^\p{Lu}]+(a|b|c)*", "")) > 10**9
    rules = [quality.Rule("dear", dear), quality.Rule("cheap", F.col("n_words") < 3)]
    cost = quality.costs(sample, rules)
    assert cost[0] > 3 * cost[1]
    # both reject nothing or all alike, so what was measured decides
    both = [quality.Rule("a_dear", F.coalesce(dear, F.lit(False)) | (F.col("n_words") > 0)), quality.Rule("b_cheap", F.col("n_words") > 0)]
    assert [r.name for r in quality.order_rules(sample, both)] == ["b_cheap", "a_dear"]


def test_windows_with_equal_hash_bits(spark, monkeypatch):
    # no hash bits at all: every pair of neighbours looks equal
    monkeypatch.setattr(quality, "_POSITION_BITS", 63)
    monkeypatch.setattr(quality, "_POSITION", (1 << 63) - 1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t is None or len(t) < 5000], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.measured(df).select("doc_id", "n_repeat_words").collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(TEXTS) if t is None or len(t) < 5000}


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    plan = quality.score(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
