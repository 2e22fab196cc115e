import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bpe
from sparkloom.llm.pretokens import _PLAIN, pretokens

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fast_split_agrees_on_its_characters():
    import re

    plain = re.compile(f"[{_PLAIN}]")
    chars = [chr(c) for c in range(0x2100) if plain.match(chr(c))]
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice(chars if rng.random() < 0.5 else " \n\t'sre1_a") for _ in range(rng.randrange(12)))
        assert pretokens(t) == regex.findall(P.PATTERN, t), repr(t)
    for c in chars:
        for t in (c, f"a{c}1", f" {c} {c}", f"{c}\n"):
            assert pretokens(t) == regex.findall(P.PATTERN, t), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(library, text):
    got = bpe.encoder(PATH).encode([text])[0]
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == library.encode_ordinary(text)
    assert bpe.encoder(PATH).decode(got) == text.encode()


def test_long_pretokens(library):
    rng = random.Random(2)
    table = bpe.rank_table(PATH)
    for n in (1, 2, 3, 31, 32, 33, 64, 65, 500, 3000):
        for alphabet in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éa漢"):
            piece = "".join(rng.choice(alphabet) for _ in range(n))
            want = library.encode_ordinary(piece)
            raw = piece.encode()
            one = table.ranks.get(raw)
            assert ([one] if one is not None else bpe.encode_long(table, raw)) == want
            if one is None and len(raw) <= bpe.WIDEST:
                assert bpe.encode_rows(table, [raw, b"ab", raw])[::2] == [want, want]


def test_query_rows(spark, library):
    docs = [(1, "Hello  world's\n\n x"), (1, "Hello  world's\n\n x"), (2, None), (3, ""), (None, "z" * 5000), (4, "漢字 ½ ́")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, ids string")
    got = bpe.encoded(df, PATH).collect()
    assert len(got) == len(docs)
    for r in got:
        assert [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)] == library.encode_ordinary(r.text or "")
    back = bpe.decoded(bpe.encoded(df, PATH), PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    digest = bpe.encoded(df.where("doc_id = 2"), PATH, as_digests=True).first().ids
    assert (digest.n_tokens, digest.ids_sha256, digest.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert bpe.encoded(df.where("false"), PATH).count() == 0
