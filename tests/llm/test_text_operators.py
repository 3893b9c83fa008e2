"""Operators 1, 2, 3, 9 and 10 against the public libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mosaique.llm import bpe, decontaminate, fuse_filter, language_id, pretokens, token_counts, token_store, wavelet
from mosaique.llm.common import fresh_path
from mosaique.llm.tokenizer_library import Library

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, key string, ids string, size long, node long"
RANDOM = random.Random(5)
ODD = [
    None,
    "",
    " ",
    "a",
    "hello  world \n\n x",
    " lead and trail ",
    "don't we'll I'M",
    "日本語 text \U0001f600\U0001f600",
    "a" * 3000,
    "".join(RANDOM.choice("abc") for _ in range(5000)),
    "x\x1cy \x1c z  q",
    "<|endoftext|> in <|endoftext|>text",
    "line.\nNext line\tend",
    "same text",
    "same text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "k", "i", 1, 2) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4]], DOCS).repartition(3)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary.load(MULTI).ranks, special_tokens={})


def test_rank_queue_pops_in_order():
    queue = bpe.RankQueue(50_000)
    for rank in (40_000, 3, 64, 4096, 3):
        queue.push(rank, np.array([rank]))
    seen = []
    while (entry := queue.pop()) is not None:
        seen.append((entry[0], len(entry[1])))
        if entry[0] == 64:
            queue.push(5, np.array([1]))
    assert seen == [(3, 2), (64, 1), (5, 1), (4096, 1), (40_000, 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe tion's\néあ  01!"), max_size=120))
def test_bpe_equals_library(tik_text):
    encoder = bpe.Encoder.load(MULTI, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    ids = encoder.encode([tik_text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(tik_text)
    assert encoder.decode(ids) == tik_text.encode()


def test_bpe_operator(docs, tik):
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, t in enumerate(ODD):
        ids = tik.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    rows = bpe.encode(docs, MULTI, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["text_bytes"]) for r in bpe.decode(rows, MULTI).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert rows.count() == len(ODD) + 1
    assert bpe.round_trip(docs.filter("false"), MULTI, public_tokenizers.PATTERN).count() == 0


def thue_morse(n):
    """A word and its complement, which collide under every polynomial hash modulo a power of two from some length on."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [16, 32, 48, 64, 256, 1024, 4096])
def test_words_with_equal_hashes(tik, monkeypatch, n):
    one, two = thue_morse(n)
    texts = [f"x {one}", f"x {two}", one, two, f"{two} {one} {two}", f"y {one} z"]
    tokenizer = Tokenizer.from_file(JSON)
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for weak in (False, True):  # then all words of one length share a hash
        encoder, library = bpe.Encoder(bpe.Vocabulary.load(MULTI), public_tokenizers.PATTERN), Library(JSON)
        if weak:
            for memo in (encoder.memo, library.memo):
                monkeypatch.setattr(memo, "_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
        for batch in (texts, texts[:1], texts[1:2], texts[::-1], ODD[1:], texts):  # together, then one after the other
            texts_ = [t or "" for t in batch]
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts_)] == [tik.encode_ordinary(t) for t in texts_]
            assert [encoder.decode(x).decode() for x in encoder.encode(texts_)] == texts_
        for at in ([0, 1, 2, 3, 4, 5], [1], [0], [5, 3, 1]):
            assert [np.frombuffer(x, "<u4").tolist() for x in library.ids([texts[i] for i in at])] == [want[i] for i in at]


@pytest.mark.parametrize(("words", "size"), [(0, 48), (5, 48), (40, 3)])
def test_full_memory_of_words(tik, monkeypatch, words, size):
    monkeypatch.setattr(pretokens, "MEMO_WORDS", words)
    monkeypatch.setattr(pretokens, "MEMO_BYTES", size)
    encoder, rng = bpe.Encoder(bpe.Vocabulary.load(MULTI), public_tokenizers.PATTERN), random.Random(words)
    for _ in range(6):
        texts = [" ".join(rng.choice(["a", "bb", "ccc", "long-word-" * 9, "é", "x1", "Q"]) + str(rng.randrange(9)) for _ in range(rng.randint(0, 30))) for _ in range(8)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [tik.encode_ordinary(t) for t in texts]
    assert encoder.memo.store.words == encoder.memo.bytes.words <= words


def test_library_by_pieces_equals_whole():
    tokenizer = Tokenizer.from_file(JSON)
    texts = [t or "" for t in ODD]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in Library(JSON).ids(texts)] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, docs, name):
    path, cache = public_tokenizers.path(name), fresh_path(spark, "counts")
    library = Library(path)
    want = {i: (len((t or "").encode()), len(library.ids([t or ""])[0]) // 4) for i, t in enumerate(ODD)}
    for _ in range(2):  # the second time all are hits
        got = token_counts.token_counts(docs, path, cache).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(ODD) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for t in ODD})
    more = spark.createDataFrame([(99, "new text"), (98, "same text")], "doc_id long, text string")
    assert token_counts.token_counts(more, path, cache).count() == 2
    assert spark.read.parquet(cache).count() == len({t or "" for t in ODD}) + 1
    assert token_counts.token_counts(docs.filter("false"), path, cache).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 70_001])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 50_257).astype(np.uint16)
    file = wavelet.WaveletFile(wavelet.dump(ids, np.arange(3), np.array([0, n // 2, n]), 16))
    assert (file.all() == ids).all() and file.keys.tolist() == [0, 1, 2] and file.ends.tolist() == [0, n // 2, n]
    for i in rng.integers(0, n, min(n, 20)).tolist() if n else []:
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert file.access(i) == token and file.count(token) == len(places)
        assert file.count(token, 3, i) == int(((places >= 3) & (places < i)).sum()) if i > 3 else True
        k = int(rng.integers(len(places)))
        assert file.select(token, k) == places[k]
    with pytest.raises(IndexError):
        file.select(50_000, n)
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"x" * 64)


def test_token_store(spark, docs):
    tokenizer, folder = Tokenizer.from_file(JSON), fresh_path(spark, "store")
    files = token_store.write_tokens(docs.dropDuplicates(["doc_id"]), JSON, folder)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_tokens(spark, files, folder).collect()}
    start = 0
    for i, t in enumerate(ODD):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = fresh_path(spark, "store")
    files = token_store.write_tokens(docs.filter("false"), JSON, empty)
    assert files.count() == 0


def test_token_store_of_an_empty_table(spark, docs):
    folder = fresh_path(spark, "store")
    files = token_store.write_tokens(docs.filter("false"), JSON, folder)
    got = token_store.read_tokens(spark, files, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == 0


def test_token_store_of_repeated_and_null_keys(spark):
    tokenizer, folder = Tokenizer.from_file(JSON), fresh_path(spark, "store")
    rows = [(None, "no key"), (3, "three"), (3, "three"), (3, "other three"), (1, None), (None, "no key")]
    files = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), JSON, folder)
    got = sorted(map(tuple, token_store.read_tokens(spark, files, folder).collect()), key=lambda r: r[1])
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert [r[0] for r in got] == [None, None, 1, 3, 3, 3] and sorted(r[3] for r in got) == sorted(crc(t) for _, t in rows)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()


def test_token_store_ranges(spark, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_ROWS", 5)
    monkeypatch.setattr(token_store, "FILE_TOKENS", 20)
    rows = spark.range(40).selectExpr("(id * 7) % 40 AS doc_id", "repeat('word ', cast(id % 9 as int)) AS text")
    folder = fresh_path(spark, "store")
    got = token_store.read_tokens(spark, token_store.write_tokens(rows, JSON, folder), folder).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(40))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_fuse_filter(keys):
    keys = np.array(sorted(keys), dtype=np.uint64)
    data = fuse_filter.build(keys)
    assert fuse_filter.contains(data, keys).all()
    others = np.random.default_rng(1).integers(0, 2**63, 2000, dtype=np.uint64)
    assert fuse_filter.contains(data, others[~np.isin(others, keys)]).mean() < 0.01


def test_fuse_filter_large():
    keys = np.random.default_rng(2).integers(0, 2**63, 100_000, dtype=np.uint64)
    keys = np.unique(keys)
    data = fuse_filter.build(keys)
    assert fuse_filter.contains(data, keys).all() and len(data) < 2.6 * len(keys)


WORDS = {
    "en": "the of and that with from this have are for not thing ring sing".split(),
    "de": "der die und das ist nicht mit auf ein wir sch ung keit lich".split(),
    "fr": "le la et les des une est pas que dans vous eau tion ment".split(),
}


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([4, 12, 60]))).upper() if i % 5 == 0 else " ".join(rng.choice(WORDS[lang]) for _ in range(20)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    train = spark.createDataFrame(rows[:120] + [(500, None, "en"), (501, "xx", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert model.labels == ["de", "en", "fr"]
    test = spark.createDataFrame(rows[120:] + [(600, None, "en"), (601, "", "en"), (602, "123 !!", "en"), (603, "und " * 20_000, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(test.withColumnRenamed("lang", "score"), model).collect()}
    assert [got[i]["lang_pred"] for i in (600, 601, 602)] == ["und"] * 3 and got[600]["score"] == 0.0
    assert got[603]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[120:]]) > 0.97
    nothing = language_id.fit(train.filter("false"))
    assert {r["lang_pred"] for r in language_id.identify_keys(test, nothing).collect()} == {"und"}
    assert language_id.identify_keys(test.filter("false"), model).count() == 0


def test_language_id_with_many_labels(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"{chr(97 + lang // 26)}{chr(97 + lang % 26)}{rng.choice('xyz')}" for _ in range(12)), f"l{lang:03d}") for i, lang in enumerate(list(range(300)) * 2)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 300
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 0.9 * len(rows)


def test_long_texts_are_scored_in_parts(monkeypatch):
    model = language_id.Model(["a", "b", "c"], np.zeros(3), np.random.default_rng(0).normal(size=(1 << language_id.BITS, 3)).astype(np.float32))
    texts = ["", "one", "", "two three " * 30, "x", "1", "", "four"]
    whole = model.predict(texts)
    monkeypatch.setattr(language_id, "ROW_BLOCK", 3)
    monkeypatch.setattr(language_id, "LABEL_BLOCK", 2)
    parts = model.predict(texts)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_language_id_does_not_depend_on_batches():
    model = language_id.Model(["a", "b"], np.zeros(2), np.random.default_rng(0).normal(size=(1 << language_id.BITS, 2)).astype(np.float32))
    texts = ["one two", "", "x", "Ünï 12 code", "one two"]
    labels, scores = model.predict(texts)
    alone = [model.predict([t]) for t in texts]
    assert labels == [a[0][0] for a in alone] and np.allclose(scores, [a[1][0] for a in alone])


def _brute(text: str, item: str) -> bool:
    """Whether a window of the item occurs within its budget: semi-global edit distance, cell by cell."""
    data = [np.frombuffer(x.encode(), np.uint8) for x in (text, item)]
    text_, item_ = (decontaminate.normalise(x, np.array([0, len(x)]))[0].tobytes().decode("latin-1").strip(" ") for x in data)
    if len(item_) < decontaminate.LEAST_BYTES:
        return bool(item_) and f" {item_} " in f" {text_} "
    width = decontaminate.WINDOW
    starts = [0] if len(item_) <= width else [*range(0, len(item_) - width, decontaminate.STRIDE), len(item_) - width]
    for s in starts:
        window = item_[s : s + width]
        row = [0] * (len(text_) + 1)
        for i, c in enumerate(window, 1):
            new = [i]
            for j, d in enumerate(text_, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        if min(row) <= len(window) // decontaminate.BYTES_PER_EDIT:
            return True
    return False


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [prose(n) for n in (3, 5, 9, 14, 25, 40)] + ["", "short", "Que Él dixo ÑANDÚ " * 4, "Él, ella!", "x y", "y z y"]

    def spoil(text: str, edits: int) -> str:
        chars = list(text)
        for _ in range(edits):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        return "".join(chars)

    texts = [None, "", "x", prose(400), "Short.", "shorts", "a short", "él ELLA", "él ellas", "x", "y z y z y", "x y z", "y", "z y"]
    for item in items:
        if len(item) > 20:
            for edits in (0, 2, 4, 7, 12):
                texts.append(f"{prose(12)}, {spoil(item, edits)}. {prose(9)}")
            texts += [item, item.upper().replace(" ", "  \n"), f"{prose(5)} {item[: len(item) // 2]}"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*items, None])], "item_id long, text string, doc_id long")
    rows = decontaminate.leaks(docs, bench).collect()
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if t and _brute(t, x)}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(want) > 25
    assert len(rows) == len(want) and all(r["windows"] >= 1 and r["edits"] >= 0 for r in rows)
    assert decontaminate.leaks(docs.filter("false"), bench).count() == 0
    assert decontaminate.leaks(docs, bench.filter("false")).count() == 0


@pytest.mark.parametrize("slice_hits", [7, 300])
def test_decontamination_in_small_slices(spark, monkeypatch, slice_hits):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("aeintr") for _ in range(rng.randint(1, 5))) for _ in range(n))
    items = ["na " * 60, "abc " * 30 + prose(20), prose(60), "na " * 30 + prose(10), prose(60) * 2]
    texts = ["na " * 400, "xna " * 50, f"{prose(30)} {items[2]} {prose(30)} {items[2][20:150]}", items[1] * 3, items[4] + items[0], *items, prose(900), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:3])), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items + items[:2])), "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_HITS", slice_hits)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == whole and len({x[0] for x in whole}) > 10
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if t and _brute(t, x)}
    assert {(i, j) for i, j, _, _ in whole if i < len(texts) and j < len(items)} == want


def test_decontamination_of_long_repetitive_texts():
    import tracemalloc

    index = decontaminate.Index.of(["na " * 200, "one two three four five " * 30, "na"])
    text = ("na " * 3_400_000).encode()
    tracemalloc.start()
    owner, window, edits = index.leaks(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert set(owner.tolist()) == {0} and not edits.any() and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    rng = random.Random(1)
    items = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(2000)]
    assert decontaminate.Index.of(items).size - (1 << decontaminate.FILTER_BITS >> 3) < 10 * sum(map(len, items))


def test_decontamination_with_other_types_of_keys(spark):
    docs = spark.createDataFrame([("d", "in the middle of it all", 1), (None, "x", 2)], "doc_id string, text string, windows int")
    bench = spark.createDataFrame([("q1", "middle of it"), (None, "x")], "item_id string, text string")
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect()), key=str) == [("d", "q1", 1, 0), (None, None, 1, 0)]


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    items = [f"item number {i} has words of its own like w{i}x{i * 7}y and v{i * 13}" for i in range(9)]
    docs = spark.createDataFrame([(i, f"before that. {t} - after") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} >= {(i, i) for i in range(9)}
