import base64
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import packing, tokenizer

tiktoken = pytest.importorskip("tiktoken")
DATA = open(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read()
ENCODE = tokenizer.make_encoder(DATA, kept=50)
ORACLE = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aab  \n'sté日本🙂")), max_size=200))
def test_same_ids_and_round_trip(text):
    ids = ENCODE(text)
    assert ids == ORACLE.encode_ordinary(text) and ORACLE.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 9_000, " " * 9_000, "é日🙂" * 3_000, "<|endoftext|>", "x\x00y"])
def test_long_and_odd_texts(text):
    assert ENCODE(text) == ORACLE.encode_ordinary(text)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids int, n_tokens string")


def test_ids_in_spark(spark):
    rows = [(1, "Hello world", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (1, "Hello world", 1, "x")]
    got = sorted((r.doc_id, list(r.ids)) for r in tokenizer.token_ids(docs(spark, rows)).collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert sorted((r.doc_id, r.n_tokens) for r in tokenizer.token_counts(docs(spark, rows)).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert tokenizer.token_ids(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_holds_capacity(sizes):
    s = np.array(sizes, np.int64)
    bins = packing.best_fit(s, 64)
    if len(s):
        use = np.bincount(bins, weights=s)
        assert use.max() <= 64 and use.min() > 0
        # two containers at most half full would have been one
        assert (use <= 32).sum() <= 1


def test_every_constraint():
    s = np.full(100, 5)
    assert np.bincount(packing.best_fit(s, 100, packing.PackingRules(max_documents=4))).max() == 4
    assert np.bincount(packing.best_fit(s, 100, packing.PackingRules(max_attention=60.0))).max() == 2


def test_packing_in_spark(spark):
    random.seed(2)
    sizes = [(i, random.choice([1, 7, 60, 100, 130, 400])) for i in range(3000)] + [(5000, 0), (5001, None), (5002, 100_000)]
    kinds = spark.createDataFrame([("s", 128), ("l", 1000), ("none", 0), ("null", None)], "container_kind string, capacity_tokens int")
    items = packing.pieces(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), kinds)
    out = packing.pack(items, items.where("container_kind = 's'").count(), packing.PackingRules(shard=300)).collect()
    for kind, cap in (("s", 128), ("l", 1000)):
        own = [r for r in out if r.container_kind == kind]
        use, parts = {}, {}
        for r in own:
            use[r.container_id] = use.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
        assert max(use.values()) <= cap
        for doc, n in sizes:
            if not n:
                assert doc not in parts
            else:
                p = sorted(parts[doc])
                assert sum(x for _, x in p) == n and [k for k, _ in p] == list(range(-(-n // cap))) and all(x == cap for _, x in p[:-1])
        total = sum(use.values())
        assert len(use) <= total / cap * 1.02 + 2
    assert packing.pack(items.limit(0), 0).count() == 0
    assert packing.pieces(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), kinds.limit(0)).count() == 0


def test_items_that_never_go_together(spark):
    """Items of more than half a container leave room in each; no task packs more than a shard of them all the same."""
    items = spark.range(6000).selectExpr("'s' AS container_kind", "100 AS capacity_tokens", "id AS doc_id", "0 AS piece_no", "60 AS n_tokens")
    cut = lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)
    out = packing.pack(items, 6000, packing.PackingRules(shard=300), cut).collect()
    groups = Counter(r.container_id.rsplit("-", 1)[0] for r in out)
    assert len(out) == len({r.container_id for r in out}) == 6000 and max(groups.values()) < 450


def test_best_fit_weighs_every_container():
    """Brute force over all open containers."""
    rng = np.random.default_rng(3)
    rules = packing.PackingRules(weights=(1.0, 0.5, 0.5), max_documents=6, max_attention=2500.0)
    sizes = rng.integers(1, 50, 400)
    room, docs, cost, want = [], [], [], np.zeros(400, int)
    for i in np.argsort(-sizes, kind="stable"):
        s = float(sizes[i])
        norms = [(1 / 64**2 * (r - s) ** 2 + 0.5 / 36 * (d - 1) ** 2 + 0.5 / 2500**2 * (c - s * s) ** 2, b) for b, (r, d, c) in enumerate(zip(room, docs, cost)) if r >= s and d >= 1 and c >= s * s]
        if norms:
            b = min(norms)[1]
        else:
            b = len(room)
            room.append(64.0), docs.append(6.0), cost.append(2500.0)
        room[b], docs[b], cost[b], want[i] = room[b] - s, docs[b] - 1, cost[b] - s * s, b
    assert (packing.best_fit(sizes, 64, rules) == want).all()


def test_many_kinds_are_joined(spark, monkeypatch):
    sizes = spark.createDataFrame([(1, 5), (2, 12), (3, 0)], "doc_id bigint, n_tokens int")
    kinds = spark.createDataFrame([(f"k{i}", 4 + i) for i in range(5)], "container_kind string, capacity_tokens int")
    want = sorted(map(tuple, packing.pieces(sizes, kinds).collect()))
    monkeypatch.setattr(packing, "MOST_KINDS", 2)
    assert sorted(map(tuple, packing.pieces(sizes, kinds).collect())) == want and len(want) == sum(-(-5 // c) + -(-12 // c) for c in range(4, 9))
