"""Line dedup against brute force, and the pipeline stage built on it."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kvspark.llm import kernels as K
from kvspark.llm import line_dedup

from .cases import DOCS, Groups, edit, rows, sentence


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(last[j] + 1, new[-1] + 1, last[j - 1] + (x != y)))
        last = new
    return last[-1]


def simhash(norm):
    raw = np.frombuffer(norm, np.uint8)
    w = K.words(raw, np.array([0, len(raw)]), K.alphabet("alnum", True))
    total = [sum(1 if h >> b & 1 else -1 for h in set(w.hashes.tolist())) for b in range(64)]
    return sum(1 << b for b in range(64) if total[b] > 0)


def fuzzy(norm):
    raw = np.frombuffer(norm, np.uint8)
    return len(K.words(raw, np.array([0, len(raw)]), K.alphabet("alnum", True)).starts) >= line_dedup.FUZZY_WORDS


def lines_brute(data, threshold=0.75):
    """kept text of each row, by the definition of the operator."""
    norms, place = [], []
    top = (1 << 63) - 1
    for n, r in enumerate(data):
        for k, line in enumerate((r[1] if r[1] is not None else "").split("\n")):
            x = line_dedup.normalise(line.encode())
            if len(x.split()) >= line_dedup.MIN_WORDS:
                norms.append(x)
                place.append((n, k))
    names = sorted(set(norms))
    near = [fuzzy(x) for x in names]
    g = Groups(len(names))
    for i in range(len(names)):
        for j in range(i):
            if near[i] and near[j]:
                a, b = names[i].decode(), names[j].decode()
                most = int(max(len(a), len(b)) * (1 - threshold) + 1e-9)
                if abs(len(a) - len(b)) <= most and g.find(i) != g.find(j) and line_dedup.edit_distance(a, b, most) <= most:
                    g.join(i, j)
    at = {x: i for i, x in enumerate(names)}
    order = lambda n: top if data[n][0] is None else data[n][0]
    first = {}
    for x, (n, k) in zip(norms, place):
        c = g.find(at[x])
        first[c] = min(first.get(c, (top + 1, 0)), (order(n), k))
    gone = {}
    for x, (n, k) in zip(norms, place):
        if first[g.find(at[x])] != (order(n), k):
            gone.setdefault(n, set()).add(k)
    out = []
    for n, r in enumerate(data):
        if r[1] is None:
            out.append((r[0], None, 0, 0))
        else:
            lines = r[1].split("\n")
            drop = gone.get(n, set())
            out.append((r[0], "\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop)))
    return Counter(out)


def near_lines(seed):
    rng = random.Random(seed)
    base = [sentence(rng, 25) for _ in range(6)]
    data = []
    for i in range(40):
        lines = [rng.choice(base) if rng.random() < 0.4 else edit(rng, rng.choice(base), 0.04) for _ in range(4)]
        lines += ["", "ok", sentence(rng, 3), "  " + rng.choice(base).upper() + "\t "]
        rng.shuffle(lines)
        data.append((i, "\n".join(lines), *[None] * 9))
    return data


def _found(spark, data):
    df = line_dedup.dedup_lines(spark.createDataFrame(data, DOCS), small=4)
    return Counter(map(tuple, df.select("row.doc_id", "kept", "n_lines", "n_removed").collect()))


def test_near_lines(spark):
    for seed in (1, 2):
        data = near_lines(seed)
        want = lines_brute(data)
        assert sum(n for *_, n in want) > 60
        assert _found(spark, data) == want


def test_cases(spark):
    # rows of one doc_id with unlike texts are ordered by digest: the brute version has no such case
    data = [r for r in rows()[:-1]]
    assert _found(spark, data) == lines_brute(data)


def test_same_doc_id_other_text(spark):
    data = [(1, "one line of some words\nand a second line here", *[None] * 9), (1, "another line of some words\none line of some words", *[None] * 9)]
    found = line_dedup.dedup_lines(spark.createDataFrame(data, DOCS)).agg(F.sum("n_removed"), F.sum("n_lines")).first()
    assert tuple(found) == (2, 4)  # one equal line, one near enough


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_keys_share_at_most_one_hash():
    for n, steps in ((line_dedup.MINS, line_dedup.WORD_STEPS), (line_dedup.GRAM_MINS, line_dedup.GRAM_STEPS)):
        made = [{(i + k) % n for k in steps} for i in range(n)]
        assert all(len(a & b) <= 1 for i, a in enumerate(made) for b in made[:i])


def test_aligned_is_a_bound():
    rng = random.Random(3)
    for _ in range(600):
        x = ["".join(rng.choices("ab\u00e9", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))]
        y = [w for w in x if rng.random() < 0.8]
        y.insert(rng.randint(0, len(y)), "xyz")
        assert line_dedup.aligned(x, y, 999) >= distance(" ".join(x), " ".join(y))


def test_recall_of_one_word_edits():
    """Candidate keys and the SimHash bound against edit similarity alone, by length of the line."""
    rng = random.Random(21)
    for n in (6, 8, 10, 15, 20, 30, 40):
        found = alike = 0
        for _ in range(150):
            base = sentence(rng, n).split(" ")
            other = list(base)
            other[rng.randrange(n)] = "".join(rng.choices("bdfgkmpz", k=rng.randint(2, 9)))
            pair = [" ".join(base).encode(), " ".join(other).encode()]
            if not line_dedup.alike(pair[0].decode(), pair[1].decode(), 0.75):
                continue
            alike += 1
            raw = np.frombuffer(b"".join(pair), np.uint8)
            cuts = np.array([0, len(pair[0]), len(raw)])
            w, full = (K.words(raw, cuts, K.alphabet(x, True)) for x in ("alnum", "space"))
            sim = line_dedup.sketch(w, full)
            keys, row = line_dedup.keys_of(line_dedup._pack_mins(w, cuts, sim, np.arange(2)))
            found += bool(set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())) and bool(line_dedup.may_link(sim[:1], sim[1:], 0.75)[0])
        assert found >= 0.9 * alike > 90, (n, found, alike)


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(400):
        a = "".join(rng.choices("abc é", k=rng.randint(0, 14)))
        b = "".join(rng.choices("abc é", k=rng.randint(0, 14))) if rng.random() < 0.5 else a[: rng.randint(0, 14)] + "x" + a[rng.randint(0, 5) :]
        d = distance(a, b)
        assert line_dedup.edit_distance(a, b, 99) == d
        for most in range(0, 6):
            assert (line_dedup.edit_distance(a, b, most) <= most) == (d <= most)
        for t in (0.5, 0.75, 0.9):
            assert line_dedup.alike(a, b, t) == (d <= int(max(len(a), len(b)) * (1 - t) + 1e-9))


def test_edit_distances_together():
    rng = random.Random(9)
    for blocks in (1, 2, 4):
        a = ["".join(rng.choices("abc \u00e9", k=rng.randint(64 * blocks - 63, 64 * blocks))) for _ in range(60)]
        b = []
        for x in a:
            y = list(x)
            for _ in range(rng.randint(0, 30)):
                y[rng.randrange(len(y)) :][:1] = rng.choices("abd", k=1)
                y.insert(rng.randint(0, len(y)), rng.choice("abz"))
            b.append("".join(y))
        order = sorted(range(60), key=lambda i: len(b[i]))
        a, b = tuple(a[i] for i in order), tuple(b[i] for i in order)
        assert line_dedup.edit_distances(a, b, blocks).tolist() == [line_dedup.edit_distance(x, y, 9999) for x, y in zip(a, b)]


def test_simhash_of_long_lines():
    norm = " ".join(f"w{i}" for i in range(1200)).encode()
    raw = np.frombuffer(norm, np.uint8)
    w = K.words(raw, np.array([0, len(raw)]), K.alphabet("alnum", True))
    assert int(line_dedup.simhash(w.hashes, w.first)[0]) == simhash(norm)


def edit_only(norms, threshold=0.75):
    """Components over all pairs of lines by edit similarity alone, whatever the candidate step."""
    g = Groups(len(norms))
    for i in range(len(norms)):
        for j in range(i):
            a, b = norms[i], norms[j]
            most = int(max(len(a), len(b)) * (1 - threshold) + 1e-9)
            if abs(len(a) - len(b)) <= most and line_dedup.edit_distance(a, b, most) <= most:
                g.join(i, j)
    return len({g.find(i) for i in range(len(norms))})


def test_word_edits_far_apart_in_simhash(spark):
    # one to three of 8 to 40 words replaced: mostly more than 3 SimHash bits, all within edit similarity
    rng = random.Random(12)
    lines = []
    for n in (8, 12, 20, 30, 40):
        for _ in range(12):
            base = sentence(rng, n).split(" ")
            other = list(base)
            for k in rng.sample(range(n), max(1, n // 12)):
                other[k] = "".join(rng.choices("bdfgkmpz", k=len(base[k])))
            lines += [" ".join(base), " ".join(other)]
    gone = _found(spark, [(i, x, *[None] * 9) for i, x in enumerate(lines)])
    assert sum(r[3] * n for r, n in gone.items()) == len(lines) - edit_only(lines) >= 58


def test_short_lines_and_symbols(spark):
    texts = ["ok\n| --- | --- |\n\nx = a[i] + b(j) - c", "OK\n|  ---  | --- |\n\nx = a[i] + b(j) + c", "two words\n| === |\nbb, cc, dd", "two  words\nno words\nbb%%%%%%%% cc^^^^^^^^ dd########\n  "]
    got = {i: (kept, gone) for i, kept, _, gone in _found(spark, [(i, t, *[None] * 9) for i, t in enumerate(texts)])}
    assert got == {
        0: (texts[0], 0),
        1: ("", 3),  # a word, a table bar, and one symbol of a line of code that is near enough
        2: (texts[2], 0),
        3: ("no words\nbb%%%%%%%% cc^^^^^^^^ dd########\n  ", 1),  # alike but for symbols, and these are most of it
    }


def test_pairs_that_are_not_alike_are_left_early():
    # of pairs that share half their words, few steps of the matrix may be made, and none one pair at a time
    rng = random.Random(31)
    a, b = [], []
    for _ in range(400):
        base = sentence(rng, rng.choice((10, 14, 90))).split(" ")
        share = rng.choice((1, 2, 20))
        a.append(" ".join(base))
        b.append(" ".join("".join(rng.choices("bdfgkmpz", k=len(w))) if rng.randrange(share) == 0 else w for w in base))
    calls = []
    line_dedup.edit_distance, real = lambda *x: calls.append(x) or real(*x), line_dedup.edit_distance
    try:
        got = line_dedup.all_alike(a, b, 0.75)
    finally:
        line_dedup.edit_distance = real
    assert len(calls) < line_dedup.FEW
    want = [real(x, y, 9999) <= int(max(len(x), len(y)) * 0.25 + 1e-9) for x, y in zip(a, b)]
    assert got.tolist() == want and 100 < sum(want) < 300


def test_edit_distances_up_to_a_bound():
    rng = random.Random(14)
    for longest in (30, 90, 400):
        a, b = [], []
        for _ in range(80):
            x = "".join(rng.choices("abc é", k=rng.randint(1, longest)))
            y = list(x)
            for _ in range(rng.randint(0, 1 + len(x) // rng.choice((2, 3, 8)))):
                y.insert(rng.randint(0, len(y)), rng.choice("abz"))
                k = rng.randrange(len(y))
                y[k : k + 1] = rng.choice(("", "a", "zz"))
                y = y or ["a"]
            x, y = sorted((x, "".join(y)), key=len)
            a.append(x)
            b.append(y)
        most = np.array([max(len(y) - len(x), len(y) // 4) for x, y in zip(a, b)])
        want = np.array([line_dedup.edit_distance(x, y, 9999) for x, y in zip(a, b)])
        got = line_dedup.edit_distances(tuple(a), tuple(b), most=most)
        assert (np.where(want <= most, want, -1) == np.where(got <= most, got, -1)).all()
        assert 10 < (want <= most).sum() < 80
