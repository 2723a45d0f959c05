import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lamplight.llm import packing, splitting
from lamplight.llm.tokenizer import PATTERN, Encoder, default_path, vocabulary, with_token_count, with_token_ids


@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = [
    None, "", " ", "a  b   c\n\n d \n", "\x00\x1c\x85 x", "<|endoftext|> isn't 12,5 Đồng 😀👩‍👩‍👧", "é­x", "\r\n\f\tq  ", "x" * 20_000, "é😀" * 3000, "word " * 5000, "  lead", "trail  ", "　    a", "don't'll've",
]


def test_equals_the_public_tokenizer(public):
    ids, per = Encoder(vocabulary(default_path())).encode(TEXTS)
    assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == [public.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t a'sé1.😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(public, text):
    ids, _ = Encoder(vocabulary(default_path())).encode([text])
    assert ids.tolist() == public.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a \u00a0 \u00a0 b", "a\u00a0 \u00a0b", "x\n \n \ny", "<td> \u00a0 \u00a0 \u00a0</td> c"])
def test_spaces_within_other_white_space(public, text):
    """Without two adjacent spaces such white space was cut at each of its spaces."""
    enc = Encoder(vocabulary(default_path()))
    want = public.encode(text, add_special_tokens=False).ids
    assert enc.encode([text])[0].tolist() == want and enc.counts([text]).tolist() == [len(want)]


def test_tiers():
    v = vocabulary(default_path())
    assert sorted(v.hash.slots.tolist()) == list(range(v.hash.n))
    for token in (b" the", b"report", b"\xc3"):
        assert v.whole(token) == v.ranks[token]
    assert v.whole(b"no such token at all") == -1
    assert v.merge(b"report") == [v.ranks[b"report"]]
    assert regex.findall(PATTERN, "a b") == ["a", " b"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 8), (2, None, 8), (3, "", 9)], "k long, text string, ids int")
    rows = with_token_ids(df).orderBy("k").collect()
    assert [(r.k, len(r.ids)) for r in rows] == [(1, 2), (2, 0), (2, 0), (3, 0)]
    assert [r.ids for r in with_token_count(df, out="ids").orderBy("k").collect()] == [2, 0, 0, 0]
    assert with_token_ids(df.limit(0)).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(s)) for i, s in enumerate(rng.integers(0, 900, 600))] + [(1000, 2048), (1001, 5000), (1002, None), (None, 5), (1003, -1), (5, 300)]
    df = spark.createDataFrame(rows, "k long, n long")
    got = packing.pack(df, "k", "n", items_per_shard=150).collect()
    load, size, places = {}, {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.size
        size[r.k] = size.get(r.k, 0) + r.size
        places.setdefault(r.container, []).append(r.place)
    assert max(load.values()) <= 2048 and all(sorted(p) == list(range(len(p))) for p in places.values())
    want = {}
    for k, n in rows:
        if k is not None and n and n > 0:
            want[k] = want.get(k, 0) + n
    assert size == want
    assert all(r.piece == 0 or r.k == 1001 for r in got if r.k != 5)
    assert sum(load.values()) / (2048 * len(load)) > 0.93
    assert packing.pack(df.limit(0), "k", "n").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=40))
def test_windows_hold_everything(sizes):
    w = packing.windows(np.array(sizes, np.int64), 100)
    assert len(w) == len(sizes) and (not sizes or np.bincount(w, sizes).max() <= 100)


def test_equal_items_are_dealt_evenly():
    w = packing.difference(np.full(12, 10), 4)
    assert np.bincount(w, minlength=4).tolist() == [3, 3, 3, 3]


def test_splitting(spark, public):
    long = "\n\n".join(f"Paragraph {i} speaks of things. It has two sentences, and more words." for i in range(200))
    rows = [(1, long), (2, None), (3, ""), (4, "short"), (5, "é😀" * 4000), (6, "x" * 30_000), (6, "x" * 30_000), (None, long), (7, "a" + "\r\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("doc_id", "body AS text", "1 AS piece_no")
    pieces = splitting.split_documents(df).collect()
    by = {}
    for r in pieces:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 5, 6, 7, None} - ({7} if len(public.encode(rows[-1][1]).ids) <= 1024 else set()) and len(by[6]) % 2 == 0
    for k, text in ((1, long), (5, rows[4][1])):
        own = sorted(by[k], key=lambda r: r.piece_no)
        ids = public.encode(text, add_special_tokens=False).ids
        assert "".join(r.new_text for r in own) == text
        assert all(len(r.ids) <= 1024 and r.ids == ids[r.first_token : r.end_token] for r in own)
        assert all(b.ids[:64] == a.ids[-64:] for a, b in zip(own, own[1:], strict=False))
    assert {r.cut for r in by[1][:-1]} <= {"paragraph", "end"}
    assert splitting.split_documents(df.limit(0)).count() == 0


def test_cuts_equal_a_walk():
    rng = np.random.default_rng(2)
    for n in (1, 70, 500, 2000):
        rank = rng.choice([-1, 0, 1, 2, 3, 4], n + 1, p=[0.1, 0.3, 0.4, 0.1, 0.06, 0.04])
        rank[0], rank[-1] = 0, 0
        to = splitting.successors(rank, n, 60, 10)
        walk = [0]
        while walk[-1] < n:
            walk.append(int(to[walk[-1]]))
        assert walk == splitting.cuts(to).tolist()
        assert all(b - max(0, a - 10) * (a > 0) <= 60 for a, b in zip(walk, walk[1:], strict=False))
