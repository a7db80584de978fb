import itertools
import random

import numpy as np
import pytest

from barloom.llm import content as C

BAD = ["you are a stupid worthless idiot {n}", "shut up you filthy moron {n}", "go to hell you pathetic loser", "send me nudes tonight baby", "those people are vermin and should be hunted", "Halt die Fresse, du Idiot"]
GOOD = ["the sharpe of fold {n} is stupid but stable", "kill the job {n} and restart it", "moderation hid {n} comments for abusive language", "the naked put was closed", "funding paid {n} bps today", "Der Lauf {n} endete gut", "women and men answered in equal numbers"]


def corpus(n, seed):
    r = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad = r.random() < 0.25
        parts = [r.choice(GOOD).format(n=r.randint(1, 999)) for _ in range(r.randint(1, 5))]
        if bad:
            parts.insert(r.randint(0, len(parts)), r.choice(BAD).format(n=r.choice(["Ilvara", "Tomsen", "today"])))
        texts.append(". ".join(parts))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    texts, labels = corpus(1500, 1)
    r = random.Random(9)
    noisy = [1 - y if r.random() < 0.03 else y for y in labels]
    return C.train(texts, noisy, C.ContentRules(bits=18))


def test_held_out(model):
    texts, labels = corpus(600, 2)
    got = np.array([model.score(t) >= model.threshold for t in texts])
    y = np.array(labels, bool)
    assert (got & y).sum() / y.sum() > 0.97 and (got & ~y).sum() / max(1, got.sum()) < 0.03


@pytest.mark.parametrize("text", ["YOU ARE A ST​UPID WORTHLESS IDIOT", "you are a 5tup1d w0rthl355 1d10t", "you are a stuuupid worthlesss idiottt", "you are a s.t.u.p.i.d worthless i d i o t", "you are a st*pid worthless id*ot", "you are a stuрid wоrthless idiоt", "you are a sutpid worthless iditoo", "x " * 20000 + "shut up you filthy moron"])
def test_disguises(model, text):
    assert model.score(text) >= model.threshold


def test_round_trip_and_odd_texts(model):
    again = C.Model.load(model.dump(), model.rules)
    for t in (None, "", " ", "go to hell you pathetic loser", "\U0001f642" * 100, "日本語のテキスト", "a" * 100_000, "*" * 50, "1 2 3 4"):
        assert abs(again.score(t) - model.score(t)) < 1e-12
    assert model.score(None) < model.threshold and model.score("日本語のテキスト") < model.threshold


def test_one_class_flags_nothing():
    m = C.train(["a b c"] * 10, [0] * 10, C.ContentRules(bits=10))
    assert m.score("a b c") < m.threshold


def test_in_spark(spark):
    texts, labels = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (9002, "  ", "x", 1.0)], "doc_id bigint, text string, label string, score double")
    verdicts = [(i, i, "r", " Abusive" if y else "NONE") for i, y in enumerate(labels)] + [(9999, 1, "r", None), (9998, 2, "r", "unsure"), (9997, 77777, "r", "none")]
    marks = spark.createDataFrame(verdicts, "label_id bigint, doc_id bigint, rater string, verdict string")
    rules = C.ContentRules(bits=16)
    out = {r.doc_id: r for r in C.score_documents(docs, C.fit(docs, marks, rules), rules).collect()}
    assert len(out) == 403 and not any(out[k].flagged for k in (9000, 9001, 9002))
    assert np.mean([out[i].flagged == bool(y) for i, y in enumerate(labels)]) > 0.95
    assert C.score_documents(docs.limit(0), C.fit(docs, marks.limit(0), rules), rules).count() == 0
    model = C.fit(docs, marks, rules)
    kept = C.score_documents(docs, model, rules, keep=("label",))
    assert kept.columns == ["doc_id", "score", "flagged", "label"] and {r.label for r in kept.collect()} == {"x"}
    with pytest.raises(ValueError):
        C.score_documents(docs, model, rules, most_bytes=10)


def test_all_words_of_two_labelled_documents_are_known():
    words = ["".join(w) for w in itertools.permutations("abcdefg", 4)][:600]
    m = C.train([f"{w} {x}" for w in words[:300] for x in ("once" + w, w)] + ["other " + w for w in words[300:]], [i % 2 for i in range(900)], C.ContentRules(bits=12, rounds=1))
    assert set(words[:300]) < set(m.words.known) and not set(words[300:]) & set(m.words.known)


def test_first_pass_takes_stretches_by_log_odds(monkeypatch):
    # no text shares a word with another but the three of the positive ones
    docs = [" ".join([f"w{i}x{k}" for k in range(30)] + (["stupid", "worthless", "idiot"] if i % 3 == 0 else []) + [f"v{i}x{k}" for k in range(10)]) for i in range(90)]
    chosen, worst = [], C._worst
    monkeypatch.setattr(C, "_worst", lambda parts, lengths: chosen.append(worst(parts, lengths)) or chosen[-1])
    model = C.Model(np.zeros(1 << 16), 0.0, {}, C.ContentRules(bits=16))
    C._ftrl([model.buckets_of(t) for t in docs], np.array([float(i % 3 == 0) for i in range(90)]), C.ContentRules(bits=16, rounds=1))
    assert len(chosen) == 90
    assert sum(at <= 30 and at + length >= 33 and total > 0 for at, length, total in chosen) >= 30
