"""Encoding, packing and subjects: exact comparisons, exact round trips, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from keyloom.llm import bpe, packing, subjects

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.rank, special_tokens={})


# ---------------------------------------------------------------- encoding


def test_encoding_is_exact_on_the_corpus(spark, reference, vocabulary):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(documents).collect()}
    assert got == {k: reference.encode_ordinary(v or "") for k, v in texts.items()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode_column(bpe.encode_column(documents)).collect()}
    assert back == {k: v or "" for k, v in texts.items()}


def test_encoding_of_random_and_hard_texts(reference, vocabulary):
    rng = random.Random(0)
    alphabets = ["ab", "abc ", "the ing", "é中\U0001f600‍", "01.,- \n\t", "".join(map(chr, range(32, 127))), " \xa0　\r\n"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["a" * 20_000, " " * 9_999, "=" * 7_777 + "x", "ab" * 5_000, "<|endoftext|>", "don't 'S WE'RE", "\x00\x01"]
    for t in texts:
        ids = vocabulary.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert vocabulary.decode(ids) == t


def test_pair_table_agrees_with_merging(reference, vocabulary):
    rng = random.Random(1)
    for _ in range(3000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        joined = vocabulary.tokens[a] + vocabulary.tokens[b]
        assert vocabulary.compatible(a, b) == (list(reference._encode_single_piece(joined)) == [a, b])


def test_encoding_edges(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (None, "hi", "x"), (3, "z" * 300_000, "x")], "doc_id long, text string, ids string")
    got = bpe.encode_column(df).collect()
    assert [len(r["ids"]) for r in got[:3]] == [0, 0, 1] and got[3]["doc_id"] is None and len(got) == 5
    assert dict(bpe.encode_column(df).dtypes)["ids"] == "array<int>"
    assert bpe.encode_column(df.limit(0)).count() == 0 and bpe.token_counts(df).where("n_tokens = 0").count() == 2
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert rows(bpe.decode_column(nulls)) == [(1, None), (2, "")]
    with pytest.raises(ValueError):
        bpe.load_vocabulary().decode([99_999_999])
    with pytest.raises(ValueError):
        bpe.Vocabulary(b"YQ== 5")


# ---------------------------------------------------------------- packing


def check_packing(items, placed, capacity):
    """Nothing lost, nothing over, nothing split that fits, no two items over each other."""
    whole = Counter()
    for key, piece, size, container, start in placed:
        assert 0 < size and 0 <= start and start + size <= capacity
        whole[key] += size
    want = Counter()
    for key, size in items:
        if size:
            want[key] += size
    assert whole == want
    pieces = Counter(k for k, *_ in placed)
    for key, n in Counter(k for k, s in items if s).items():
        expected = sum(-(-s // capacity) for k, s in items if k == key and s)
        assert pieces[key] == expected
    taken = {}
    for _, _, size, container, start in placed:
        taken.setdefault(container, []).append((start, size))
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    return len(taken)


@pytest.mark.parametrize("capacity", [1, 7, 100])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    items = [(i, rng.choice([None, 0, 1, 2, 3, rng.randint(1, 60), 250])) for i in range(400)] + [(5, 40)] * 3 + [(900 + i, 33) for i in range(200)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long").withColumn("size", F.lit("clash"))
    got = [tuple(r) for r in packing.pack(df.repartition(5), capacity).collect()]
    used = check_packing(items, got, capacity)
    total = sum(s or 0 for _, s in items)
    assert used <= 1.05 * total / capacity + 2
    assert packing.pack(df.limit(0), capacity).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_packing_is_best_fit_quality():
    rng = np.random.default_rng(0)
    sizes = np.clip(rng.lognormal(4.2, 1.1, 20_000).astype(int), 1, 4096)
    steps, used = packing.plan(Counter(sizes.tolist()), 4096)
    assert used <= np.ceil(sizes.sum() / 4096) * 1.002
    assert steps[:, 2].sum() == len(sizes)
    # two of three thirds and a bit: nothing can share more than two
    _, used = packing.plan({40: 99}, 100)
    assert used == 50
    assert packing.plan({}, 10)[1] == 0


def test_packing_of_the_corpus(spark):
    counts = bpe.token_counts(spark.read.parquet(f"{DATA}/documents.parquet"))
    got = [tuple(r) for r in packing.pack(counts, 4096).collect()]
    items = [(r["doc_id"], r["n_tokens"]) for r in counts.collect()]
    used = check_packing(items, got, 4096)
    assert used <= sum(n for _, n in items) / 4096 * 1.03 + 1
    assert {k for k, piece, *_ in got if piece == 1} == {k for k, n in items if n > 4096}


# ---------------------------------------------------------------- subjects


def test_visible_text():
    text = '[quote="kernel_fan"]Bake <b>bread</b>.[/quote]\nluke_lawyer wrote:\n> > Tune the guitar.\nSee http://court.example/x [url=http://a.b]link[/url]\n-- \nbob\nDoctor by day'
    got = " ".join(w for s in subjects.sentences(text) for w in s)
    assert got == "bake bread tune the guitar see"
    assert list(subjects.sentences(None)) == [] and list(subjects.sentences(" \n")) == []
    assert list(subjects.sentences("a -- b")) == [["a", "b"]]


def test_subjects_held_out(spark):
    """A quarter of the labels is held out; labels are noisy, so the bar is what noise leaves."""
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/subject_labels.parquet")
    names = [r[0] for r in spark.read.parquet(f"{d}/subjects.parquet").select("subject").collect()]
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = subjects.train(documents, labels.where(~held), names)
    kept = labels.where(held).select("doc_id").distinct()
    want = {tuple(r) for r in labels.where(held & F.col("subject").isNotNull()).collect()}
    found = subjects.subject_posteriors(documents, model).join(kept, "doc_id").select("doc_id", "subject")
    got = {tuple(r) for r in found.collect()}
    assert len(got & want) / len(got) > 0.87 and len(got & want) / len(want) > 0.87


def test_subjects_edges(spark):
    documents = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "the guitar and the choir", "s"), (4, "knead the dough", "s"), (4, "knead the dough", "s"), (5, "x" * 200_000, "s")], "doc_id long, text string, subject string")
    labels = spark.createDataFrame([(3, "music"), (3, "music"), (4, "cooking"), (2, None), (99, "music"), (3, "unknown"), (None, "music")], "doc_id long, subject string")
    model = subjects.train(documents, labels, ["music", "cooking", "music", None])
    got = {tuple(r[:2]) for r in subjects.subject_posteriors(documents, model, least=0.0).where("posterior > 0").collect()}
    assert all(k in (3, 4, 5) for k, _ in got)
    assert subjects.subject_posteriors(documents.limit(0), model).count() == 0
    none = subjects.train(documents, labels.limit(0), ["music"])
    assert subjects.subject_posteriors(documents, none).count() == 0


def test_subjects_do_not_depend_on_partitions(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/subject_labels.parquet")
    names = [r[0] for r in spark.read.parquet(f"{d}/subjects.parquet").select("subject").collect()]
    found = []
    for n in (1, 24):
        words = subjects.sentence_words(documents.repartition(n))
        model = subjects.train(words, labels, names)
        found.append(sorted(tuple(r) for r in subjects.subject_posteriors(words, model).select("doc_id", "subject").collect()))
    assert found[0] == found[1] and len(found[0]) > 1000
    with pytest.raises(ValueError):
        subjects.train(words, labels, names, dimensions=1000)


def test_features_of_a_sentence():
    import pyarrow as pa

    words = pa.array([[5, 7, 5, 9], [], [5, 7]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([words, pa.array([[3, 1], [], [2]], pa.list_(pa.int32()))], ["words", "sizes"])
    flat, starts, owner = subjects.batch_features(batch, 1 << 16)
    assert starts.tolist() == [0, 6, 8] and owner.tolist() == [0, 0, 2] and len(flat) == 12
    assert flat[0] == flat[2] == flat[8] and flat[1] == flat[9]  # words
    assert flat[3] == flat[10] and flat[3] != flat[4]  # pairs, in order
    assert all(flat[i] >= 1 << 15 for i in (5, 7, 11)) and len({int(flat[i]) for i in (5, 7, 11)}) == 3  # sentences
    assert all(flat[i] < 1 << 15 for i in (0, 1, 2, 3, 4, 6, 8, 9, 10))


def test_margins_and_curves():
    m = subjects.margins(np.array([[3.0, 1.0, 0.0]]))
    assert m.tolist() == [[2.0, -2.0, -3.0]]
    assert subjects._isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == pytest.approx([0.1, 0.4, 0.4, 0.9])
    x = np.linspace(-29.75, 29.75, 120)
    hist = np.stack([np.where(x > 2, 4.0, 96.0), np.where(x > 2, 96.0, 4.0)], 1)  # four in a hundred labels are wrong
    curve = subjects._curve(hist)
    assert (np.diff(curve) >= 0).all() and curve[x < 1].max() < 0.1 and curve[x > 3].min() > 0.9
    assert subjects._curve(np.zeros((120, 2)))[60] < 0.5 < subjects._curve(np.zeros((120, 2)))[70]
