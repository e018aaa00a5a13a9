import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from versify.llm import cdc_fingerprint, hmm_lm, jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ein Haus"), (4, "Ein Haus"), (None, "ein haus"), (6, "Été a b \U0001f600 c d e f g h")]


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def test_base_score_and_counts(spark, docs):
    rows = ODD + [(100 + i, " ".join(f"w{(i * j) % 17}" for j in range(1, i + 2))) for i in range(60)]
    got = hmm_lm.score_documents(docs(rows, ("w", "block", "score")), rounds=2).collect()
    learn = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    c = Counter(w for t in learn for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), "\n"]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), "\n"]), 6)) for _, t in rows)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert hmm_lm.score_documents(docs(rows).limit(0)).count() == 0


def test_forward_and_expectations_against_enumeration():
    rng = np.random.default_rng(2)
    k, m = 3, 5
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.States(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, m))).T.copy())
    seqs = [[0, 3, 3, 1], [2], [4, 4, 0]]
    seq, edge = np.concatenate(seqs), np.cumsum([0, *map(len, seqs)])
    into = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    hmm_lm.expected(model, seq, edge, into)
    logs = hmm_lm.forward(model, seq, edge)
    start, step, emit = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    for s, log in zip(seqs, logs, strict=True):
        paths = list(itertools.product(range(k), repeat=len(s)))
        p = [model.start[z[0]] * math.prod(model.step[a, b] for a, b in zip(z, z[1:], strict=False)) * math.prod(model.emit[x, a] for x, a in zip(s, z, strict=True)) for z in paths]
        assert abs(log - math.log(sum(p))) < 1e-9
        for z, q in zip(paths, p, strict=True):
            start[z[0]] += q / sum(p)
            for a, b in zip(z, z[1:], strict=False):
                step[a, b] += q / sum(p)
            for x, a in zip(s, z, strict=True):
                emit[x, a] += q / sum(p)
    for got, want in zip(into, (start, step, emit), strict=True):
        assert np.allclose(got, want)


def test_stretches_of_a_long_text_give_the_same_counts(monkeypatch):
    rng = np.random.default_rng(4)
    share = np.full(hmm_lm.CLASSES + 2, 1 / (hmm_lm.CLASSES + 2))
    model = hmm_lm.first_states(share)
    lengths = [900, 1, 450, 449, 7]
    seq, edge = rng.integers(0, 50, sum(lengths)), np.cumsum([0, *lengths])
    sums = []
    for held in (1 << 19, 100):
        monkeypatch.setattr(hmm_lm, "HELD", held)
        into = np.zeros(hmm_lm.STATES), np.zeros((hmm_lm.STATES,) * 2), np.zeros(model.emit.shape)
        hmm_lm.expected(model, seq, edge, into)
        sums.append(into)
    assert all(np.allclose(a, b) for a, b in zip(*sums, strict=True))
    assert abs(sums[0][2].sum() - sum(lengths)) < 1e-6 and abs(sums[0][1].sum() - sum(lengths) + len(lengths)) < 1e-6


def test_score_against_enumeration_of_states_and_words(spark, docs):
    """P(word | state) = E * p(word) / p(class), summed over all paths of states."""
    rows = [(i, t) for i, t in enumerate(["a b", "b c a", "c", "", "A b c", "d a", "a a a b", "new b"] * 3)]
    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in learn for w in [*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    hashes = next(iter(hmm_lm.tokens(pa.array([" ".join(w for w in count if w != "\n")]))))[2]
    of = dict(zip([w for w in count if w != "\n"], hmm_lm.classes(hashes).tolist(), strict=True)) | {"\n": hmm_lm.END}
    share = np.zeros(hmm_lm.CLASSES + 2)
    for w, c in count.items():
        share[of[w]] += (c + 1) / (n + v + 1)
    share[hmm_lm.UNKNOWN] = 1 / (n + v + 1)
    assert abs(share.sum() - 1) < 1e-12
    model = hmm_lm.baum_welch(docs(list(enumerate(learn))), hmm_lm.first_states(np.maximum(share, 1e-12)), 2)
    emit = np.where(share[:, None] > 0, model.emit, 0)
    emit[hmm_lm.UNKNOWN] = 0
    emit *= (1 - share[hmm_lm.UNKNOWN]) / emit.sum(0)

    def chance(word, state):
        if word not in count:
            return share[hmm_lm.UNKNOWN]
        return emit[of[word], state] * (count[word] + 1) / (n + v + 1) / share[of[word]]

    for state in range(hmm_lm.STATES):
        assert abs(sum(chance(w, state) for w in [*count, "never seen"]) - 1) < 1e-9
    for r in hmm_lm.score_documents(docs(rows), rounds=2).collect():
        seq = [*words(rows[r["doc_id"]][1]), "\n"]
        total = 0.0
        for path in itertools.product(range(hmm_lm.STATES), repeat=len(seq)):
            p = model.start[path[0]] * math.prod(model.step[a, b] for a, b in zip(path, path[1:], strict=False))
            total += p * math.prod(chance(w, z) for w, z in zip(seq, path, strict=True))
        assert abs(r["score"] - math.log10(total)) < 1e-6


def test_states_learn(spark, docs):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * j) % 23}" for j in range(1, 40))) for i in range(200)]
    got = [r for r in hmm_lm.score_documents(docs(rows), rounds=4).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 2 * len(got)  # two kinds of texts


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    ids = [i for i, _ in rows]
    low = {x: min((ids[k] for k in range(len(rows)) if label[k] == x and ids[k] is not None), default=None) for x in set(label)}
    return sorted(((ids[k], len(sets[k]), low[label[k]] if sets[k] else ids[k]) for k in range(len(rows))), key=str)


def near_copies(count, size, seed, shared):
    rng = np.random.default_rng(seed)
    base = [f"w{seed}x{k}" for k in range(size)]
    out = []
    for _ in range(count):
        own = list(base)
        for k in rng.choice(size, rng.integers(0, 5), replace=False):
            own[k] = f"e{rng.integers(1 << 40)}"
        out.append(" ".join(own[: size - rng.integers(0, 6)] + shared))
    return out


@pytest.mark.parametrize("leaf", [4096, 8])
def test_join_is_exact(spark, docs, monkeypatch, leaf):
    for name, value in (("LEAF", leaf), ("CHUNK", min(leaf, 1024)), ("PIVOTS", 4), ("COPIES", 3), ("SEND", 4000), ("COUNT", 4000)):
        monkeypatch.setattr(jaccard_join, name, value)
    passage = [f"p{k}" for k in range(12)]
    texts = [t for g in range(5) for t in near_copies(14, 60 + 25 * g, g, passage if g % 2 else [])]
    texts += ["same text here and there again"] * 9 + [f"only {i} of {i} its {i} own kind" for i in range(30)]
    rows = ODD + [(1000 + 7 * i % 997, t) for i, t in enumerate(texts)]
    got = jaccard_join.jaccard_components(docs(rows, ("set", "uid", "n", "cluster")))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_join_edge_cases(spark, docs):
    assert jaccard_join.jaccard_components(docs([])).count() == 0
    assert [tuple(r) for r in jaccard_join.jaccard_components(docs([(1, None)])).collect()] == [(1, 0, 1)]
    kept = jaccard_join.one_of_each(docs([(5, "a b c d e f"), (2, "A b C d e f"), (9, ""), (8, ""), (None, "a b c d e f")], ("_kept",)))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 8, 9, None]


def test_fingerprints_resist_shifts():
    rng = np.random.default_rng(4)
    text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000))
    f = cdc_fingerprint.fingerprint(text.encode())
    assert sum(f.values()) == len(text)
    assert cdc_fingerprint.likeness(f, cdc_fingerprint.fingerprint(("new words first " + text).encode())) > 0.95
    assert cdc_fingerprint.containment(cdc_fingerprint.fingerprint(text[: len(text) // 3].encode()), f) > 0.95
    half = text[: len(text) // 2] + "".join(rng.choice(list("ijklmnop"), len(text) // 2))
    assert 0.4 < cdc_fingerprint.likeness(f, cdc_fingerprint.fingerprint(half.encode())) < 0.6
    ends = cdc_fingerprint.cuts(cdc_fingerprint.gear_hashes(np.frombuffer(text.encode(), np.uint8)))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= cdc_fingerprint.LARGEST and sizes[:-1].min() >= cdc_fingerprint.LEAST
    assert cdc_fingerprint.fingerprint(b"") == {}


@pytest.mark.parametrize("chars", [300, 10_000_000])
def test_edits_against_brute_force(spark, docs, monkeypatch, chars):
    monkeypatch.setattr(cdc_fingerprint, "RANGE_CHARS", chars)  # many ranges, or one
    rows = [(1, None), (2, ""), (30, "é\U0001f600" * 40), (31, "abc " * 30), (32, "abc " * 30), (-5, "first of all"), (70, "x" * 3000), (71, "end")]
    got = {r["doc_id"]: r for r in cdc_fingerprint.with_edits(docs(rows, ("part", "late", "body"))).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["fingerprint"] == cdc_fingerprint.as_text(cdc_fingerprint.fingerprint(t.encode()))
    assert got[31]["fingerprint"] == got[32]["fingerprint"] and got[31]["near_next"] == 1.0
    assert got[1]["near_next"] == 1.0 and got[2]["near_next"] == 0.0
    alone = cdc_fingerprint.with_edits(docs([(9, "abcd")])).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in alone] == [(1.0, hashlib.sha256(b"abca").hexdigest())]
    assert cdc_fingerprint.with_edits(docs([])).count() == 0


def test_shingles_of_slices(monkeypatch):
    texts = pa.array([t for _, t in ODD] * 3 + ["a b c d e a b c d e a"])
    whole = [s.tolist() for s in jaccard_join.shingle_sets(texts)]
    monkeypatch.setattr("versify.llm.common.SLICE_BYTES", 5)
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts)] == whole
    assert [len(s) for s in whole[:7]] == [0, 0, 0, 1, 1, 1, 5] and len(whole[-1]) == 5
