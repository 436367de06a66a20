"""The ten operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import hashlib
import math
import random
import sys
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bpe, decontaminate, html_text, jaccard, language_model, quality, repeats, token_ids, toxicity, vectors
from lumenfold.llm.common import Bounded

ODD = [None, "", " \n\t", "a", "x <|endoftext|> y<|startoftext|>z", "İstanbul ΑΣ ΟΔΟΣ ﬁ", "é à́ 　z  two", "don't WE'LL", "漢字かな \U0001F600", "a \n b\t\tc   d \n", "\x00\x1c a\x85b"]


def words_of(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(spark, rows):
    """(doc_id, text) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, handle int, codes string, cut_text string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        base = words_of(rng, rng.choice([1, 2, 3, 8, 30, 100, 300]))
        for _ in range(rng.choice([1, 2, 3, 6])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(base)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, t) for k, t in enumerate(ODD)]
    rows.append((rows[3][0], rows[3][1]))  # a repeated row
    rows.append((len(rows), " ".join(words_of(rng, 30_000))))
    return rows


def test_vectors(spark):
    r = np.random.default_rng(3)
    base, rows = r.standard_normal((20, 16)), []
    for _ in range(150):
        v = (base[r.integers(20)] + r.standard_normal(16) * r.choice([0, 0.05, 0.2, 0.3, 0.35])).astype(np.float32)
        rows.append([float(x) for x in v * r.choice([1, 3])])
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [float("inf")] * 16, rows[5], rows[5]]
    ids = [int(i) for i in r.permutation(len(rows))]
    # a vec_id of several vectors, and vectors without one
    ids[10], ids[40], ids[77], ids[5], ids[60] = ids[90], ids[90], None, None, None
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<float>")
    ok = {}
    for k, v in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(float)
            ok[k] = a / np.linalg.norm(a)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.95]
    group = reachable(range(len(rows)), links)
    least = {g: min((ids[k] for k in group if group[k] == g and ids[k] is not None), default=None) for g in group.values()}
    count = Counter(x for pair in links for x in pair)
    order = lambda t: tuple((x is not None, x) for x in t)
    want = sorted(((i, count[k], least[group[k]], i == least[group[k]]) for k, i in enumerate(ids)), key=order)
    for block in (40, None):
        got = [tuple(x) for x in vectors.near_duplicates(df, block=block).collect()]
        assert sorted(got, key=order) == want


@pytest.mark.parametrize("dim", [5, 64, 100])
def test_code_estimates_are_unbiased_and_bounded(dim):
    r = np.random.default_rng(0)
    x = r.standard_normal((400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x + 0.3 * r.standard_normal(x.shape) / 8
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    estimate, low, high = vectors.estimates(vectors.Codes(x), vectors.Planes(q))
    true = x @ q.T
    assert (low <= true + 1e-6).all() and (high >= true - 1e-6).all()
    assert abs((estimate - true).mean()) < 0.005


def test_few_pairs_are_computed_again_and_none_is_lost():
    r = np.random.default_rng(4)
    x = r.standard_normal((2000, 64))
    near = x[:300] + 0.04 * r.standard_normal((300, 64)) * r.uniform(0, 8, (300, 1))
    x = np.concatenate([x, near])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, tried = vectors.links(vectors.Codes(x), x, x, 0.95)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.95)), strict=True))
    assert len(i) > len(x) and tried < 0.005 * len(x) ** 2


def reachable(nodes, links):
    up = {i: i for i in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def test_token_ids(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_ids.vocabulary())
    rows = [*corpus, (7, "one id of several texts"), (7, "another and longer text of the same id"), (7, "one id"), (7, None)]
    path = str(tmp_path / "ids")
    token_ids.write_tokens(documents(spark, rows), path)
    back = token_ids.read_tokens(spark, path)
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))
    want = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    stored = sorted(back.collect(), key=lambda r: (r["part"], r["row"]))
    assert [(r["doc_id"], list(r["ids"])) for r in stored] == want
    assert [list(r["ids"]) for r in token_ids.read_tokens(spark, path, [4]).collect()] == [ids for i, ids in want if i == 4]
    at, starts = 0, []
    for i, ids in want:
        starts.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_ids.layout(back).collect()) == sorted(starts)


def token_columns(spark, path, monkeypatch, **more):
    """What ``write_tokens`` does with the columns of one task, to be called here."""
    made = []
    with monkeypatch.context() as m:
        m.setattr(token_ids, "map_batches", lambda df, make, schema: made.append(make) or df)
        token_ids.write_tokens(documents(spark, [(1, "a")]), path, **more)
    return made[0]()


def test_token_ids_of_pieces_by_column(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(token_ids.vocabulary()), random.Random(17)
    words = sorted({"".join(rng.choice("aeinorsthé") for _ in range(rng.randint(5, 9))) for _ in range(4000)})
    texts = ["".join(w + rng.choice([" ", " ", ", ", ".\n", "\n\n"]) for w in rng.sample(words, 400)) + "x" for _ in range(20)]
    each = token_columns(spark, str(tmp_path / "ids"), monkeypatch)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts})
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        out = list(each(batch))
    finally:
        sys.setprofile(None)
    assert [x for b in out for x in b.column("ids").to_pylist()] == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    # the interpreter does nothing piece by piece: its work grows with texts, and pieces are Arrow's and the library's
    assert calls["call"] + calls["c_call"] < len(set(" ".join(texts).split())) // 2


def test_token_ids_with_little_memory(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(token_ids.vocabulary()), random.Random(23)
    atoms = ["the", "Foo", "Über", "été", "ÿ", "×", "ª", "'s", "don't", "42", "3.14", "...", "!?", "(", "\\", "€", "漢字", "e\u0301", "\u200b", "\x00", "<|endoftext|>", "<|endoftext", "Ġ", "ĊFoo", "w" * 200]
    gaps = [*[" "] * 8, "", "\n", "\n", "\n\n", "\n\n\n", "  ", " \n", "\n ", "\t", "\r\n", "\x1c", "\x85", "\u2003"]
    texts = ["".join(rng.choice(atoms) + rng.choice(gaps[: rng.choice([12, 21])]) for _ in range(rng.choice([0, 1, 2, 5, 20]))) for _ in range(600)]
    texts += [rng.choice(gaps) + t for t in texts] + [t.rstrip() for t in texts] + [None, "", "\n", "\n\n", " ", "a\n", "\na"]
    want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    for cache, size in ((0, 1), (3, 50), (40, 3000), (700_000, 1 << 20)):
        each = token_columns(spark, str(tmp_path / f"{cache}"), monkeypatch, cache=cache, chunk_bytes=size)
        got = []
        for k in range(0, len(texts), 500):
            for b in each(pa.RecordBatch.from_pydict({"doc_id": list(range(k, min(k + 500, len(texts)))), "text": pa.array(texts[k : k + 500], pa.string())})):
                assert b.column("row").to_pylist() == b.column("doc_id").to_pylist()
                assert b.column("n_tokens").to_pylist() == list(map(len, b.column("ids").to_pylist()))
                got += b.column("ids").to_pylist()
        assert got == want
        assert len(token_ids._encoder(token_ids.vocabulary(), cache).words) <= cache


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    got = sorted((r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded"]) for r in bpe.encode_documents(documents(spark, corpus), bpe.vocabulary(), True, True).collect())
    want = []
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_long_words(monkeypatch):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(bpe.vocabulary()), random.Random(3)
    monkeypatch.setattr(bpe.WordBPE, "LONG", 3)
    coder = bpe.WordBPE(bpe.vocabulary())
    for letters in ("ab", "aeinrst", "a", "thequickbrown", "é漢aß1"):
        for n in (2, 5, 40, 700):
            text = "".join(rng.choices(letters, k=n))
            assert np.frombuffer(coder.encode(text.encode()), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    coder.encode(("".join(rng.choices("aeinrst", k=400_000)) + "a" * 400_000).encode())
    assert time.process_time() - began < 60


def test_forced_boundaries_cut_where_no_token_spans():
    coder = bpe.WordBPE(bpe.vocabulary())
    word = coder._symbols("thequickbrownfox</w>")
    parts = coder.fragments(word)
    assert "".join(parts) == word
    assert all(a[-1] + b[0] not in coder.inside for a, b in zip(parts, parts[1:], strict=False))


def test_toxicity_held_out_accuracy():
    rng = random.Random(2)
    bad = ["idiot", "moron", "loser", "pathetic", "scum"]
    syllables = ["th", "er", "an", "on", "in", "re", "ha", "ti", "es", "nd"]
    plain = lambda n: ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    texts, labels = [], []
    for k in range(900):
        w = plain(rng.randint(5, 200))
        if k % 3 == 0:
            for _ in range(2 + len(w) // 40):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad))
        texts.append(" ".join(w).encode())
        labels.append(int(k % 3 == 0))
    model = toxicity.Toxicity.fit(texts[:600], labels[:600])
    cache = model.cache()
    predicted = [model.score(toxicity.words(t), cache) >= 0.5 for t in texts[600:]]
    assert np.mean([p == (y == 1) for p, y in zip(predicted, labels[600:], strict=True)]) >= 0.95
    mean = lambda w: np.mean(model.margins[toxicity.grams(w)])
    assert mean(b"idiiot") > mean(b"ander") and mean(b"patheticc") > mean(b"thonre")
    assert 0 <= model.score([], cache) < 0.5


def test_toxicity_reads_every_window():
    rng = random.Random(11)
    texts, labels = [], []
    for k in range(300):
        w = [rng.choice("aeiou") + f"w{rng.randrange(400)}".replace("1", "a").replace("2", "o") for _ in range(3000 if k % 30 == 0 else 40)]
        if k % 2 == 0:  # near the end of a long text
            w[-20:-19] = ["blockhead", "and", "blockhead"] if k % 30 else ["numbskull", "and", "numbskull"]
        texts.append(" ".join(w).encode())
        labels.append(1 - k % 2)
    model = toxicity.Toxicity.fit(texts, labels)
    mean = lambda w: np.mean(model.margins[toxicity.grams(w)])
    assert mean(b"numbskull") > mean(b"aw300") and mean(b"blockhead") > mean(b"aw300")


def test_toxicity_of_few_labels_follows_the_same_rule():
    texts = [b"you rotten scoundrel", b"a quiet day by the river", b"rotten scoundrel go away", b"the river is quiet", b"bread and butter", b"scoundrel so rotten", b"a day with bread"] * 2
    model = toxicity.Toxicity.fit(texts, [1, 0, 1, 0, 0, 1, 0] * 2)
    cache = model.cache()
    bad, good = (model.score(toxicity.words(t), cache) for t in (b"such a rotten scoundrel", b"a day by the river"))
    assert bad > good


def test_toxicity_query_without_labels(spark, corpus):
    docs = documents(spark, corpus)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r["score"] for r in toxicity.score_documents(docs, model).collect()} == {0.5}


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts, strict=True):
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        kept = bytes(x for x, y in zip(b, cover, strict=True) if not y)
        out.append((i, len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("length", "seed"), [(200, 1), (40, 2), (12, 4)])
def test_repeats(spark, length, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40 if length < 100 else 400)] + ["é", "ß", "漢字"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 20, 60, 90]))) for _ in range(12)]
    rows = []
    for k in range(100):
        parts = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))
            if rng.random() < 0.4:
                j = rng.randrange(len(x))
                x = x[:j] + rng.choice("xyz") + x[j + 1 :]
            parts.append(x)
        rows.append((k, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, "ab " * 300), (203, "zq" * 150), (204, rows[3][1]), (3, rows[3][1])]
    docs = documents(spark, rows)
    assert sorted(map(tuple, repeats.remove_repeats(docs, length).collect())) == brute_repeats(rows, length)
    if length == 40:
        kept = repeats.deduplicate(docs, length)
        assert kept.columns == docs.columns and {r["handle"] for r in kept.collect()} == {1}


@pytest.mark.parametrize(("size", "bits"), [(3000, 9), ((1 << 24) + 5000, 24)])
def test_pointers_beyond_the_bits_of_a_position(size, bits):
    raw = np.random.default_rng(6).integers(97, 123, size, dtype=np.uint8)
    raw[-600:-300] = raw[100:400]
    h = repeats.Hasher(0, size)
    prefix = h.prefix(raw)
    own = repeats.pointers(prefix, size, h, 200, 32, bits)
    starts = np.arange(size - 199)
    assert len(own) == len(starts) and (own >= starts).all() and (own <= starts + 168).all()
    same = np.arange(101)
    assert (own[100 + same] - 100 == own[size - 600 + same] - (size - 600)).all()
    for k in np.random.default_rng(7).integers(0, len(starts), 40).tolist() + [len(starts) - 1]:
        grams = h.of(prefix, np.arange(k, k + 169), np.arange(k, k + 169) + 32) >> np.uint64(bits)
        assert own[k] == k + int(np.argmin(grams))


def test_repeats_of_a_text_above_16_mib():
    size = (1 << 24) + 5000
    raw = np.random.default_rng(8).integers(97, 123, size, dtype=np.uint8)
    raw[-600:-300] = raw[-2000:-1700]
    refiner = repeats.Refiner(200)
    _, common, whole, codes = refiner.records([raw.tobytes()])
    low, high, at = repeats.decode(codes)
    assert (low <= high).all() and (high <= at).all() and (at + 32 <= low + 200).all() and high.max() == size - 200
    twice = np.flatnonzero(np.bincount(np.unique(common, return_inverse=True)[1])[np.unique(common, return_inverse=True)[1]] > 1)
    blocks = refiner.blocks(raw.tobytes(), codes[twice])
    _, key, c = refiner.strings(raw.tobytes(), np.unique(blocks[2]))
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    start = repeats.decode(c)[0]
    assert set(start[n[inverse] > 1].tolist()) == {*range(size - 2000, size - 1899), *range(size - 600, size - 499)}


def brute_hits(items, w, window):
    hit, names = [False] * len(w), set()
    for name, raw in items:
        x = decontaminate.normalise(raw)
        if not x:
            continue
        k = min(window, len(x))
        wins = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in wins:
                names.add(name)
                hit[i : i + k] = [True] * k
    return sum(hit), names


def test_automaton():
    rng = random.Random(1)
    for _ in range(300):
        letters = [b"a", b"b", b"c", b"d", b"e"][: rng.randint(1, 5)]
        items = [(str(i), b" ".join(rng.choices(letters, k=rng.randint(0, 9)))) for i in range(rng.randint(0, 6))]
        window = rng.randint(2, 5)
        w = rng.choices([*letters, b"z"], k=rng.randint(0, 40))
        runs, names = decontaminate.ItemAutomaton(items, window).match(w)
        assert (sum(b - a for a, b in decontaminate.joined(runs)), names) == brute_hits(items, w, window)


def test_automaton_of_repeats_takes_linear_time():
    took = []
    for n in (4000, 16_000):
        began = time.process_time()
        automaton = decontaminate.ItemAutomaton([("a", b"x " * n), ("b", b"x " * (n - 5)), ("c", b"y z")])
        assert automaton.match([b"x"] * n) == ([(0, n)], {"a", "b"})
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(k, " ".join(words_of(rng, n))) for k, n in enumerate([5, 13, 20, 40, 13])] + [(7, None), (8, "--")]
    long = " ".join(words_of(rng, 700))
    rows = [(0, "start " + items[3][1] + " end"), (1, long), (2, long + " " + items[1][1].upper() + ". tail"), (3, items[0][1]), *((10 + k, t) for k, t in enumerate(ODD))]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    raw = [(str(i), (t or "").encode()) for i, t in items]
    want = {}
    for i, t in rows:
        w = decontaminate.normalise((t or "").encode())
        hit, names = brute_hits(raw, w, 13)
        want[i] = (len(w), hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0 and 20 * hit >= len(w))
    for shard in (500_000, 20):  # one automaton, and several that a task holds in turn
        assert {r["doc_id"]: tuple(r)[1:] for r in decontaminate.scan(docs, bench, shard_words=shard).collect()} == want
    kept = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(kept) == {i for i in want if not want[i][4]}
    assert kept[2] == long + " . tail" and kept[1] == long and kept[10] is None


def test_items_without_id_make_hits(spark):
    rng = random.Random(13)
    items = [(None, " ".join(words_of(rng, 20))), (4, " ".join(words_of(rng, 20)))]
    docs = documents(spark, [(0, "a " + items[0][1]), (1, items[0][1] + " b " + items[1][1]), (2, "c d")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.scan(docs, bench).collect()}
    of = lambda names: hashlib.sha256(names).hexdigest()
    assert got == {0: (21, 20, 0, of(b""), True), 1: (41, 40, 1, of(b"4"), True), 2: (2, 0, 0, of(b""), False)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [2]


def test_language_model(spark, corpus):
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    docs = spark.createDataFrame([(i, t, learn(i)) for i, t in corpus], "doc_id long, text string, learn boolean")
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in corpus]
    count = Counter(w for i, t in tokens if learn(i) for w in t)
    n, v = sum(count.values()), len(count)
    got = sorted(language_model.score_documents(docs).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    for r, (i, t) in zip(got, sorted(tokens, key=lambda x: (x[0], len(x[1]))), strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r["score"] < 0


def test_language_model_learns_across_words(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{k % 90}" for k in range(a, a + rng.randint(0, 60))) for a in (rng.randrange(300) for _ in range(150))]
    texts += [" ".join(words_of(rng, 40, 200)) + " zebra" for _ in range(50)] + ["", None]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:150]]
    rows = [(k, t, k % 3 > 0) for k, t in enumerate(texts)] + [(1000 + k, t, False) for k, t in enumerate(shuffled)]
    got = {r["doc_id"]: r["score"] for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), 4096).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in rows}
    count = Counter(tuple(w[k : k + n]) for i, t, learn in rows if learn for w in [tokens[i]] for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total, once = sum(c for g, c in count.items() if len(g) == 1), sum(c == 1 for g, c in count.items() if len(g) == 1 and g[0])
    twice, unseen = sum(c == 2 for g, c in count.items() if len(g) == 1 and g[0]), max(1, once)
    each_unseen = unseen / (total + unseen) / max(1, once * (once - 1) / (2 * (twice + 1)))
    quantised = lambda c: c and round(2 ** (math.floor(2 * math.log2(c) + 1e-9) / 2))

    def probability(w, k):
        p = count[(w[k],)] / (total + unseen) or each_unseen
        for n in range(2, min(3, k + 1) + 1):
            c = count[tuple(w[k - n + 1 : k])]
            of = c if n == 2 else quantised(c)
            p = (min(quantised(count[tuple(w[k - n + 1 : k + 1])]), of) + 4 * p) / (of + 4)
        return p

    for i, w in tokens.items():
        assert got[i] == pytest.approx(sum(math.log10(probability(w, k)) for k in range(len(w))), rel=1e-9)
    held = [k for k in range(0, 150, 3) if len(texts[k].split()) > 5]
    assert all(got[k] > got[1000 + k] for k in held if texts[k] != shuffled[k])


def test_word_ngrams_improve_held_out_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 7 != 2).alias("learn"))
    with_filter, without = (language_model.score_documents(docs, smooth=w).where("not learn").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first() for w in (language_model.SMOOTH, 1e12))
    n, base, score = with_filter
    assert score / n > base / n + 0.05 and score / n > without[2] / n + 0.05


def test_filter_grows_with_what_it_holds():
    sizes = []
    for n in (20_000, 200_000):
        ids = np.random.default_rng(n).integers(0, 1 << 48, 2 * n, dtype=np.uint64)
        count = np.random.default_rng(1).integers(1, 50, n)
        shard = language_model.LogBloom.of(ids[:n], count)
        assert (shard.read(ids[:n]) >= np.maximum(1, count / 1.5)).all() and np.mean(shard.read(ids[n:]) > 0) < 0.03
        sizes.append(len(shard.bits))
    assert sizes[1] >= 8 * sizes[0]


def test_filter_reads_quantised_counts():
    ids = np.arange(5000)
    count = np.random.default_rng(0).integers(1, 10_000, len(ids))
    back = language_model.LogBloom.of(ids, count).read(ids)
    assert (back >= np.maximum(1, count / 1.5)).all() and np.mean(back <= count + 1) > 0.95


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; text", "plain & text"),
        ("<p>a<p>b", "a\nb"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One  two<br>three.<p><b>Short</article><footer>f</footer>", "T\nOne two three.\nShort"),
        (f"<div class='cookie-notice'>{'We use cookies. ' * 20}</div><div><p>{'Real text. ' * 20}</p><p>End.</p></div><aside>{'Other. ' * 40}</aside>", ("Real text. " * 20).strip() + "\nEnd."),
        (f"<body><header><h1>Site</h1></header><main><article><p>{'Long text. ' * 12}</p><div class=ad>Buy</div><form>Sign up</form></article><section id=comments><p>{'Nice! ' * 40}</p></section></main>", ("Long text. " * 12).strip()),
        ("<script>var a='</p><p>no'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
        ('<p class="a"">hello</p>', "hello"),
        ("<p class='a' title=\"b>c\">x &lt; y</p>", "x < y"),
        (f"<div class=page-footer>About</div><div class='container has-sidebar'><p>{'Good text. ' * 20}</p></div><div class=comments-wrapper>{'Me too. ' * 40}</div>", ("Good text. " * 20).strip()),
        (f"<article><p>{'Long text. ' * 12}</p><article class=comment>{'Nice! ' * 40}</article></article>", ("Long text. " * 12).strip()),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


_BODY = "<p>" + "A first paragraph of the article, long enough to stand by itself. " * 3 + "</p>"


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ('<p class="advert">Buy this now, it is cheap and good.</p>', False),
        ("<p hidden>Nobody sees this line of the article at all.</p>", False),
        ('<p class="cookie-notice">We use cookies on this page for you.</p>', False),
        ('<ul><li class="ad">Buy that as well, it is cheaper.<li>Second item</ul>', "Second item"),
        ('<ul><li class="ad"><div>Buy that as well, it is cheaper.</div></li></ul>', False),
        ('<div class="search-algorithms"><p>How searching works in practice, told at length.</p></div>', True),
        ('<section id="form-factor"><p>The shape of the machine, told at length here.</p></section>', True),
        ('<div class="related-work"><p>What others did before this work, told at length.</p></div>', True),
        ('<div class="site-footer"><p>All rights reserved by the makers of this.</p></div>', False),
        ('<h2 class="title">A headline in between</h2>', True),
        ('<p class="advert">Buy this now.</p>After it, text of the article goes on.', "After it, text of the article goes on."),
    ],
)
def test_names_on_every_element(inside, kept):
    import re

    text = kept if isinstance(kept, str) else re.sub("<[^>]*>", "", inside) if kept else None
    body = re.sub("<[^>]*>", "", _BODY).strip()
    got = html_text.main_text(f"<html><body><article><h1>Title</h1>{_BODY}{inside}{_BODY}</article></body></html>")
    assert got == "\n".join(["Title", body, *([text] if text else []), body])


def test_half_characters_go_altogether():
    raw = "é".encode() + b"x" * 10 + "é".encode() + "z".encode()
    assert repeats.kept_text(raw, [(1, 13)]) == "z" and repeats.kept_text(raw, [(2, 12)]) == "ééz" and repeats.kept_text(raw, []) == raw.decode()


def test_margins_do_not_depend_on_the_hash_seed():
    import subprocess
    import sys

    code = "import sys; sys.path.insert(0, %r); from lumenfold.llm import toxicity as t; print([t.grams(w) for w in (b'abcdefgh', 'wörter'.encode())], t.Toxicity.fit([b'bad bad words here', b'good things here'] * 4, [1, 0] * 4).margins.tobytes().hex()[:4000])"
    root = repeats.__file__.rsplit("/", 3)[0]
    run = lambda seed: subprocess.run([sys.executable, "-c", code % root], env={**__import__("os").environ, "PYTHONHASHSEED": seed}, capture_output=True, text=True, check=True).stdout
    assert run("1") == run("2")


def test_surge_and_dive_decide(data):
    """Without any telling names, the distribution of text alone finds nearly all articles, and its threshold decides."""
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table(f"{data}/pages.parquet").column("html").to_pylist()
    bare = [re.sub(r"<(/?)(nav|article|footer|header|main|aside)\b[^>]*>", r"<\1div>", p).replace(' class="ad"', "") for p in pages]
    whole = [html_text.main_text(p) for p in pages]
    right = lambda surge: np.mean([html_text.main_text(p, surge) == t for p, t in zip(bare, whole, strict=True)])
    assert right(html_text.SURGE) >= 0.85 and right(40) < 0.2 and right(10) == 0


def test_blocks_without_a_surge_are_no_text():
    long = "A paragraph that is long enough to be the text of a page, and goes on for a while after that. " * 3
    page = f"<article><h2>Short</h2><p>teaser</p></article><article><h1>Title</h1><p>{long}</p><p>So.</p></article>"
    assert html_text.main_text(page) == f"Title\n{long.strip()}\nSo." and html_text.main_text(page, 5) == f"Short\nteaser\nTitle\n{long.strip()}\nSo."


def brute_text(page):
    """Windows, regions and blocks by the plain definitions, line by line."""
    found = html_text.lines(page)
    weight, block = html_text.weights(found)
    window = lambda k: sum(weight[j] for j in range(k, min(k + 3, len(weight))))
    least = min(html_text.SURGE, max((window(k) for k in range(len(found))), default=0) / 2)
    open_, seeds = False, set()
    for k in range(len(found)):
        open_ = window(k) * 3 > least if open_ else window(k) > least and weight[k] * 3 > least
        if open_:
            seeds.add(k)
    kept = [k for k in range(len(found)) if k in seeds or block[k] and any(block[j] == block[k] for j in seeds)]
    return "\n".join(found[k].text for k in kept if not found[k].named and (weight[k] or block[k]))


def test_texts_of_all_pages_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    want = {r["page_id"]: brute_text(r["html"] or "") for r in rows.collect()}
    assert got == want and sum(map(bool, want.values())) > 0.9 * len(want)


def test_regions_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        w = [rng.choice([0, 0, 5, 20, 60, 200]) for _ in range(rng.randint(0, 30))]
        window = lambda k, w=w: sum(w[k : k + html_text.LINES])
        least, inside, want = min(html_text.SURGE, max(map(window, range(len(w))), default=0) / 2), False, []
        for k in range(len(w)):
            inside = window(k) * html_text.LINES > least if inside else window(k) > least and w[k] * html_text.LINES > least
            want.append(inside)
        got = [any(a <= k < b for a, b in html_text.regions(w)) for k in range(len(w))]
        assert got == want


def test_broken_markup_takes_linear_time():
    for bad in ('<a ="', "<p class='x\">t", "<!", "<a ", "<script ", "<a class=", "<!-- ", "<div class=class "):
        began = time.process_time()
        html_text.main_text(bad * 40_000)
        assert time.process_time() - began < 3


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (1, "u", None, 3), (2, None, "<p>x", 4)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "u", "", 0), (1, "u", "", 0), (2, None, "x", 1)]


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        w = words_of(rng, rng.randint(5, 120))
        bad = k % 5 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad and k % 2 else " ".join(x + "%%%" for x in w) if bad else " ".join(w).capitalize() + "."
        rows.append((k, text))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, 0 if bad else 1))
    rows += [(1000 + k, t) for k, t in enumerate(ODD[:4])]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.selected(docs, marks)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert len({k for k in range(400) if k % 5} - kept) <= 4 and len({k for k in range(400) if not k % 5} & kept) <= 4
    assert {1000, 1001, 1002} <= kept
    assert quality.selected(docs, marks.limit(0)).count() == len(rows)
    every = quality.resample(docs.union(docs.where("doc_id < 3")), marks, keep=0.25)  # repeated rows share their fate
    assert 0 <= every.where("selected").count() - round(0.25 * (len(rows) + 3)) <= 3
    assert every.where("doc_id < 3").groupBy("doc_id").agg(F.countDistinct("selected").alias("n")).where("n > 1").count() == 0


def test_resampling_follows_the_weights(spark):
    """Over many seeds a row comes first as often as its share of the weights, at any temperature."""
    weight = np.asarray([0.0, 0.5, 1.0, 2.0, -1.0])
    rows = spark.createDataFrame([(k, float(w)) for k, w in enumerate(weight)], "doc_id long, w double").crossJoin(spark.range(6000).select(F.col("id").cast("string").alias("seed")))
    for temperature in (1.0, 2.0):
        keyed = rows.withColumn("key", quality.gumbel_key(F.col("w"), F.col("doc_id"), F.col("seed"), temperature))
        first = {r["doc_id"]: r["count"] / 6000 for r in keyed.groupBy("seed").agg(F.max_by("doc_id", "key").alias("doc_id")).groupBy("doc_id").count().collect()}
        want = np.exp(weight / temperature) / np.exp(weight / temperature).sum()
        assert all(abs(first[k] - want[k]) < 0.025 for k in range(5))


def test_quality_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(x.upper() if k % 4 == 0 else x for x in words_of(rng, rng.randint(0, 60)))) for k in range(200)] + [(None, "no id"), (300, None)]
    labels = [(k, int(k % 4 > 0)) for k in range(0, 200, 2)]
    got = quality.resample(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), keep=60).collect()
    raw, target = Counter(), Counter()
    bag = {i: quality.features((t or "").encode(), Bounded(quality._piece)) for i, t in rows}
    for f in bag.values():
        raw.update(f.tolist())
    for i, q in labels:
        if q:
            target.update(bag[i].tolist())
    size = quality.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    assert all(r["log_ratio"] == pytest.approx(sum(map(ratio, bag[r["doc_id"]].tolist())), abs=1e-9) for r in got)
    assert {r["selected"] for r in sorted(got, key=lambda r: -r["gumbel_key"])[:60]} == {True} and sum(r["selected"] for r in got) == 60



def test_top_k_bound_is_exact(spark):
    x = np.round(np.random.default_rng(1).normal(0, 50, 3000) * 2**20) / 2**20
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 7, 1500, 3000):
        assert quality.top_k_bound(df, "v", k) == np.sort(x)[-k]


@pytest.mark.parametrize(("size", "threshold", "tile"), [(3, Fraction(9, 10), 512), (3, Fraction(9, 10), 8), (5, Fraction(4, 5), 512)])
def test_jaccard(spark, corpus, size, threshold, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    sets = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * threshold.denominator >= threshold.numerator * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    want = reachable(sets, links)
    docs = documents(spark, [*corpus, (None, "no id here at all")])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, size, threshold).collect()}
    assert got.pop(None) == (3 if size == 3 else 1, None)  # a text of five words
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    kept = jaccard.one_of_each(docs, size, threshold)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *want.values()}


def test_repeated_rows_and_null_ids_stay_once(spark):
    rng = random.Random(9)
    long = [" ".join(words_of(rng, 120, 5000)) for _ in range(6)]
    rows = [(1, long[0]), (1, long[0]), (1, long[0]), (None, long[1]), (7, long[1]), (None, long[1]), (None, long[2]), (None, long[2]), (9, long[3]), (9, long[4]), (8, long[3]), (5, long[5]), (3, None), (3, None), (None, "")]
    kept = jaccard.one_of_each(documents(spark, rows), 5, Fraction(4, 5))
    want = [(1, long[0]), (7, long[1]), (None, long[2]), (8, long[3]), (9, long[4]), (5, long[5]), (3, None), (3, None), (None, "")]
    order = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=order) == sorted(want, key=order)
    left = repeats.deduplicate(kept)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=order) == sorted(want, key=order)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard.near_duplicates(docs).count() == 0
    assert repeats.remove_repeats(docs).count() == 0 and repeats.deduplicate(docs).count() == 0
    assert decontaminate.scan(docs, bench).count() == 0
    assert quality.selected(docs, labels).count() == 0
    assert language_model.score_documents(docs.withColumn("learn", F.lit(True))).count() == 0
    assert bpe.encode_documents(docs, bpe.vocabulary()).count() == 0
    assert toxicity.score_documents(docs, toxicity.train(docs, labels, F.lit(True))).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            assert docs.count() <= n
            n = docs.count()
    assert out.count() == n > 0


def test_subpackage_queries_are_registered():
    import __spark_entry__

    assert {q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in __spark_entry__.queries()
