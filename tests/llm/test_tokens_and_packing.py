import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lagweave.llm import bpe, packing, tokens
from lagweave.llm.queries import tokenizer_path
from lagweave.llm.shared import fresh_dir

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def strange(n=1500):
    rng = random.Random(2)
    letters = [*"abcdefghij'stvemlld  \n\t\r  123.,!?", " ", "　", "\xa0", "é", "ß", "日", "<|endoftext|>", "'ll", "'re", "\x1c", "  ", "\n\n", "😀", "Ж", "’", "̀"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["", "  ", " \n", None, "a", "word " * 30000]


def test_ids_are_the_librarys(library, monkeypatch):
    texts = strange()
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for remembered in (bpe.REMEMBERED, 300):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        encoder = bpe.Encoder(PATH)
        for part in (pa.array(texts), pa.array(["cut off", *texts]).slice(1)):
            assert [x.tolist() for x in encoder.ids_of(part)] == want
            assert encoder.counts_of(part).tolist() == [len(w) for w in want]
    encoder.twin = None
    encoder._forget()
    assert [x.tolist() for x in encoder.ids_of(pa.array(texts))] == want


def test_other_tokenizers_go_to_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    encoder = bpe.Encoder(path)
    texts = strange(50)
    assert encoder.counts_of(pa.array(texts)).tolist() == [len(encoder.encode_text(t or "")) for t in texts]


def test_counts_and_cache(spark, library, monkeypatch):
    texts = [None, "", "one two", "one two", "three " * 700, "<|endoftext|>x"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(2, "one two", 7)], "doc_id long, text string, digest int").repartition(3)
    cache = fresh_dir(spark, "cache")
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(texts), (2, "one two")])
    encoded = []
    plain = tokens.encode_counts
    monkeypatch.setattr(tokens, "encode_counts", lambda misses, path: (encoded.append(misses.count()), plain(misses, path))[1])
    for _ in range(2):
        assert Counter(tuple(r) for r in tokens.count_tokens(df, PATH, cache).collect()) == want
    new = df.unionByName(spark.createDataFrame([(9, "new", 7)], df.schema))
    assert tokens.count_tokens(new, PATH, cache).count() == 8
    assert encoded == [4, 0, 1]
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_the_histogram(seed):
    rng = random.Random(seed)
    sizes = rng.choices(range(1, 1025), k=rng.choice([1, 50, 3000])) if seed else [1024] * 5
    histogram = Counter(sizes)
    packed = packing.configurations(dict(histogram))
    found, held = packed.configurations, Counter()
    for pattern, times in found:
        assert sum(n * k for n, k in pattern) <= 1024
        for n, k in pattern:
            held[n] += k * times
    assert held == histogram
    used, least = sum(t for _, t in found), -(-sum(sizes) // 1024)
    if len(sizes) == 3000:  # the program is solved: a dual bound says so, and nearly all pieces lie as it says
        assert packed.program.gap <= 0.02 and packed.share >= 0.9
        assert sum(k for n, k in histogram.items() if n < 1024) * 0.2 < packed.program.bound <= packed.program.value * (1 + 1e-9)
    room = sorted(sizes, reverse=True)
    best_fit = []
    for n in room:
        fits = [i for i, r in enumerate(best_fit) if r >= n]
        if fits:
            best_fit[min(fits, key=lambda i: best_fit[i])] -= n
        else:
            best_fit.append(1024 - n)
    assert least <= used <= len(best_fit)


def exact_bound(sizes, capacity):
    """The fewest sequences of all, by trying every way."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, [r - sizes[k] if j == i else r for j, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(3))
def test_few_pieces_against_all_ways(seed):
    rng = random.Random(seed)
    for _ in range(12):
        sizes = sorted(rng.choices(range(1, 21), k=9), reverse=True)
        packed = packing.configurations(dict(Counter(sizes)), 20, 300)
        used, best = sum(t for _, t in packed.configurations), exact_bound(sizes, 20)
        full = sizes.count(20)
        assert packed.program.bound + full <= best + 1e-9 and best <= used <= best + 1


def test_knapsack_prices_match_enumeration():
    rng = random.Random(1)
    prices = np.array([0.0] + [rng.choice([0.0, rng.random()]) for _ in range(12)])
    best, _ = packing.price_knapsacks(prices, 12)

    def most(room):
        return max([0.0, *(prices[n] + most(room - n) for n in range(1, room + 1) if prices[n])])

    assert np.allclose(best, [most(c) for c in range(13)])


def test_pieces_and_places(spark, library):
    texts = [None, "", "a", "word " * 5000, "\n".join(t for t in strange(200) if t), *[f"text {i} " * (i % 90) for i in range(300)], *["copy of a text"] * 100]
    df = spark.createDataFrame([(i % 380, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(4)
    got = packing.pack(df, PATH).collect()
    want = Counter()
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i % 380, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(df.limit(0), PATH).count() == 0
