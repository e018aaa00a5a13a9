import random

from versify.operators import bpe as BPE


def one_by_one(words, n, minimum=2):
    out = []
    words = dict(words)
    while len(out) < n:
        counts = {}
        for w, f in words.items():
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + f
        counts = sorted((-c, p) for p, c in counts.items() if c >= minimum)
        if not counts:
            break
        best = (*counts[0][1], -counts[0][0])
        out.append(best)
        words = merged(words, [best])
    return out


def merged(words, merges):
    out = {}
    for w, f in words.items():
        text = "".join(w)
        for l, r, _ in merges:
            text = text.replace(l + r, BPE.merged_symbol(l, r))
        key = tuple(x + ">" for x in text.split(">")[:-1])
        out[key] = out.get(key, 0) + f
    return out


def test_batches_choose_as_one_by_one():
    rng = random.Random(5)
    several = 0
    for case in range(300):
        letters = [f"<{b:02x}>" for b in range(97, 97 + rng.randint(2, 9))]
        words = {tuple(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, 6) for _ in range(rng.randint(1, 40))}
        want, got, now, known = one_by_one(words, 40), [], dict(words), set()
        while len(got) < 40:
            counts = {}
            for w, f in now.items():
                for p in zip(w, w[1:]):
                    counts[p] = counts.get(p, 0) + f
            top = [(l, r, -c) for c, (l, r) in sorted((-c, p) for p, c in counts.items() if c >= 2)]
            limit = rng.choice((1, 3, 1000))
            batch = BPE.batch_of_merges(top[:limit], known, len(top) < limit)[: 40 - len(got)]
            if not batch:
                break
            several += len(batch) > 1
            got += batch
            known |= {BPE.merged_symbol(l, r) for l, r, _ in batch}
            now = merged(now, batch)
        assert got == want, case
    assert several > 100


def test_training_needs_fewer_jobs_than_merges(spark, monkeypatch):
    jobs, count = [], BPE.count_changes
    monkeypatch.setattr(BPE, "count_changes", lambda *a: jobs.append(1) or count(*a))
    from versify.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    rng = random.Random(3)
    rows = [(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", range(1, 27), k=4)) for _ in range(200)),) for _ in range(20)]
    _, merges = BPE.train_bpe(spark.createDataFrame(rows, "text string"), 60)
    assert len(merges) == 60 and len(jobs) < 60
