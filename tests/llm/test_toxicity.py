import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from lagweave.llm import toxicity as tx

INSULTS = ["grobble", "snarkwit", "zumfel"]


def brute(s, t, order, decay):
    """The kernel by listing all subsequences."""
    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kernel_matches_enumeration(order):
    rng = random.Random(order)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(40)]
    s, t = tx.pad(words[:20], 7), tx.pad(words[20:], 8)
    want = [brute(a, b, order, 0.7) for a, b in zip(words[:20], words[20:], strict=True)]
    assert np.allclose(tx.ssk(s, t, order, 0.7), want, rtol=1e-4)


def corpus(n=300):
    rng = random.Random(3)
    syllables = ["ta", "ren", "mo", "li", "sok", "ve", "pan", "dri", "u", "ste"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    texts, labels = [], []
    for _ in range(n):
        sentences = [[word() for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 5))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 4)):
                rng.choice(sentences).append(rng.choice(INSULTS))
        texts.append(" ".join(" ".join(s).capitalize() + "." for s in sentences))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_learns_and_tolerates_gaps():
    texts, labels = corpus()
    model = tx.fit(texts[:200], labels[:200])
    import pyarrow as pa

    score = lambda xs: tx.scores(pa.array(xs), model, tx.Memory(model))
    assert ((score(texts[200:]) >= 0.5) == labels[200:]).mean() > 0.97
    clean = "Tamo liren sok ve {} pan dri {} mo."
    plain = score([clean.format("grobble", "zumfel")])[0]
    assert plain >= 0.5
    for a, b in (("g r o b b l e", "zum-fel"), ("GRO.BBLE", "z*u*m*f*e*l"), ("grobble,", "ZUMFEL!!")):
        assert score([clean.format(a, b)])[0] == pytest.approx(plain, abs=0.05)
    assert score([clean.format("renta", "liste")])[0] < 0.5


LABELLED = "/root/testdata/sf0.1"


def test_held_out_insults_with_letters_put_in():
    """At threshold 0.5: documents with telling words as they are, and with one letter put into each of them, or spaced out."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in pq.read_table(f"{LABELLED}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{LABELLED}/labels.parquet").to_pylist() if r["doc_id"] in docs}
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known, held = sorted(i for i in labels if not out(i)), sorted(i for i in labels if out(i))
    model = tx.fit([docs[i][0] for i in known], np.array([labels[i] for i in known]))
    predicted = lambda texts: tx.scores(pa.array(texts, pa.large_string()), model, tx.Memory(model)) >= 0.5
    got, truth = predicted([docs[i][0] for i in held]), np.array([labels[i] for i in held])
    assert got[truth == 1].mean() >= 0.9 and got[truth == 0].mean() <= 0.01
    for language in ("en", "de", "fr", "es"):
        mine = np.array([docs[i][1] == language for i in held])
        assert got[mine & (truth == 1)].mean() >= 0.86, language
    # the landmarks that stand in English toxic documents only are the English insults
    english = [i for i in known if docs[i][1] == "en"]
    words = [w.strip(tx.BEGIN + tx.END) for w in model.marks.words]
    telling = [w for w in words if w.isascii() and sum(w in docs[i][0].lower().split() for i in english if labels[i]) >= 10]
    telling = [w for w in telling if not any(w in docs[i][0].lower().split() for i in english if not labels[i])]
    assert len(telling) >= 8
    rng = random.Random(3)
    pattern = re.compile(r"(?<!\w)(" + "|".join(telling) + r")(?!\w)", re.I)
    having = [docs[i][0] for i in held if labels[i] and pattern.search(docs[i][0])]

    def inserted(word):
        k = rng.randrange(1, len(word))
        return word[:k] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[k:]

    plain = predicted(having).mean()
    assert plain >= 0.95
    for form in (inserted, " ".join, ".".join, lambda w: w[:2] + "*" + w[2:]):
        assert predicted([pattern.sub(lambda m: form(m[0]), t) for t in having]).mean() >= 0.9 * plain


def test_defined_cases(spark):
    texts, labels = corpus(120)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(900, None, 1), (901, "", 1), (902, "zumfel grobble " * 20000, 1), (903, "x" * 200000, 1), (5, texts[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(3, None), (4, 0)], "doc_id long, toxic int")
    model = tx.train(docs, marks)
    got = {r["doc_id"]: r["score"] for r in tx.score(docs, model).collect()}
    assert len(got) == len({r[0] for r in rows}) and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901] < 0.5 and got[902] > 0.5 and got[903] < 0.5
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == labels[i] for i in held]) > 0.9
    kept = tx.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(got[r[0]] < 0.5 for r in rows)
    assert tx.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in tx.score(docs, tx.train(docs, marks.limit(0))).collect()} == {0.0}
