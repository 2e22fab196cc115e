import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import tokenfiles as tf
from sparkloom.llm.mphf import PerfectHash, key_hashes
from sparkloom.session import scratch_dir

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 70, 5000])
def test_perfect_hash(n):
    h = key_hashes(list(range(n)))
    index = PerfectHash.build(h)
    assert index.n == n and sorted(index.numbers(h).tolist()) == list(range(n))


def test_keys_that_are_not_there(tmp_path):
    w = tf.ShardWriter(f"file://{tmp_path}/a/x.tok", "<u2")
    for k in (None, -5, 1, 1, 1, 9):
        w.add(k, np.array([k or 0], "<i2").tobytes() * 3)
    with pytest.raises(ValueError):
        w.add(3, b"")
    w.close()
    r = tf.ShardReader(f"file://{tmp_path}/a/x.tok")
    assert [list(x) for x in r.find([1, None, 9, -5])] == [[2, 3, 4], [0], [5], [1]]
    assert sum(len(x) for x in r.find(list(range(100, 1100)))) == 0
    assert r.read(5).tolist() == [9, 9, 9]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|endoftext|>", "x", " ", "\n", "<|", "of", "日本"]), max_size=9).map("".join), st.text("ab.,' \n\t\r\x1c\x85\xa01_é", max_size=40)))
def test_cached_encoding_is_the_library_s(library, text):
    got = np.frombuffer(tf.text_tokenizer(PATH).encode([text], "<u2")[0], "<u2").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, library):
    rng = random.Random(1)
    docs = [(rng.randrange(-50, 500), "the cat" * rng.randrange(9) + f" {i}<|endoftext|>") for i in range(300)]
    docs += [(None, "null key"), (None, None), (7, None), (8, ""), (8, ""), (2**62, "é" * 70000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id bigint, text string, start int")
    manifest = tf.write_token_files(df.repartition(5), f"{scratch_dir(spark)}/t", PATH)
    got = tf.read_token_files(manifest, df, with_ids=True).collect()
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, start = [], 0
    for k, t in order:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got], key=lambda r: r[1]) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    manifest = tf.write_token_files(df, f"{scratch_dir(spark)}/t", PATH)
    assert tf.read_token_files(manifest, df).collect() == []


def test_special_strings_long_words_and_scripts_without_blanks(library, monkeypatch):
    cjk = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(30_000))
    texts = ["x<|endoftext|>y", "<|endoftext|>", "a b <|endoftext|> c", cjk, f"one {cjk[:400]} two {cjk}", "q" * 200_000, "Zm9v" * 50_000 + " end", "plain words"]
    coder = tf.TextTokenizer(PATH)
    for group in (texts, texts[::-1], texts[:1]):
        got = [np.frombuffer(x, "<u2").tolist() for x in coder.encode(group, "<u2")]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in group]
    assert coder.first_held < 10_000 and all(len(c) <= tf.LONGEST for c in coder.first)
    monkeypatch.setattr(tf, "KEPT_BYTES", 10)
    monkeypatch.setattr(tf, "FIRST_BYTES", 10)
    for t in ("some words here", "and other words, too", "some words here"):
        assert np.frombuffer(coder.encode([t], "<u2")[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_one_key_over_several_shards(spark, library):
    df = spark.createDataFrame([(k, f"text number {i:04d}") for i in range(400) for k in ([5] if i % 4 else [i])], "doc_id bigint, text string")
    manifest = tf.write_token_files(df.repartition(4), f"{scratch_dir(spark)}/t", PATH, shard_bytes=300)
    assert manifest.where("least <= 5 and greatest >= 5").count() > 3
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tf.read_token_files(manifest, df).collect())
    want, start = [], 0
    for k, t in sorted((r.doc_id, r.text) for r in df.collect()):
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        want.append((start, k, n))
        start += n
    assert got == want
