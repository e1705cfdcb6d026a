"""Fingerprints, near-dedup, passages and suffixes against brute force."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import xxhash

from veilspark.llm import blocks, fingerprints, neardup, passages, suffixes


def corpus(seed=5, n=60):
    """Texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    vocabulary = [word() for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [text(60) for _ in range(3)]
    docs = []
    for i in range(n):
        kind = rng.randrange(5)
        if kind == 0 and docs:
            body = rng.choice(docs)[1]
        elif kind == 1 and docs:
            words = rng.choice(docs)[1].split(" ")
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            body = " ".join(words)
        elif kind == 2:
            body = text(rng.randint(0, 60)) + rng.choice([" ", "\n"]) + rng.choice(shared) + " " + text(rng.randint(0, 60))
        else:
            body = text(rng.randint(1, 200))
        docs.append((i, body))
    return docs


def test_word_hashes_do_not_depend_on_the_piece(monkeypatch):
    texts = [t.encode() for _, t in corpus()] + [b"", b"   ", b"x" * 5000]
    whole = blocks.word_hashes(texts)
    monkeypatch.setattr(blocks, "PIECE", 64)
    cut = blocks.word_hashes(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert whole[1].tolist() == [len(t.split()) for t in texts]
    by_word = {}
    for word, h in zip((w for t in texts for w in t.split()), whole[0].tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- passages


def brute_passages(docs, w=35):
    count = {}
    split = [(k, (t or "").encode().split()) for k, t in docs]
    for _, words in split:
        for i in range(len(words) - w + 1):
            g = tuple(words[i : i + w])
            count[g] = count.get(g, 0) + 1
    out = []
    for k, words in split:
        gone = {p for i in range(len(words) - w + 1) if count[tuple(words[i : i + w])] > 1 for p in range(i, i + w)}
        kept = b" ".join(x for p, x in enumerate(words) if p not in gone)
        out.append((k, len(words), len(gone), sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_passages_against_brute_force(frame, odd):
    for docs in (corpus(), corpus(9, 120) + [(1000, "a b " * 200), (1001, "one two three " * 40)], odd):
        got = sorted(map(tuple, passages.passage_digests(frame(docs)).collect()), key=repr)
        assert got == brute_passages(docs)
    assert passages.passage_digests(frame(odd).filter("false")).count() == 0


def test_many_equal_rows(frame):
    """Work and memory grow with the rows, not with their square."""
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text)] * 5000 + [(2, "short text")] * 50 + [(3, text + " x"), (4, " ".join(f"v{i}" for i in range(60)))]
    out = passages.passage_digests(frame(docs)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(1, 60, 60, 5000), (2, 2, 0, 50), (3, 61, 60, 1), (4, 60, 0, 1)]


def test_places_beyond_the_low_bits():
    """Against direct comparison, in a text longer than the bits of a place can number."""
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 63, (1 << blocks.PLACE_BITS) + 5000, dtype=np.uint64)
    values[-2100:-2000] = values[1000:1100]
    take = np.zeros(len(values), bool)
    take[1000:1066] = take[-2100:-2034] = True
    first, n, least, content = blocks.spans_of(blocks.Rolling(values), np.zeros(len(values), np.int64), 35, 5, take)
    low = first < 2000
    assert low.sum() > 1 and (first[~low] - first[low] == len(values) - 3100).all()
    assert (n[low] == n[~low]).all() and (least[low] == least[~low]).all() and (content[low] == content[~low]).all()


def test_passages_cut_from_rows(frame):
    docs = corpus()
    df = frame(docs)
    out = passages.without_passages(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = {r.doc_id: r for r in out.collect()}
    for k, n, removed, digest in brute_passages(docs):
        r = got[k]
        assert sha256(b" ".join(r.text.encode().split())).hexdigest() == digest and r.n_chars == len(r.text)
        assert removed or r.text == dict(docs)[k]


def test_spans_do_not_depend_on_the_place(monkeypatch):
    """A window and its copy beyond the places that the low bits hold have one key and one content."""
    monkeypatch.setattr(blocks, "PLACE_BITS", 8)
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    values[2000:2100] = values[50:150]
    doc = np.zeros(len(values), np.int64)
    take = np.zeros(len(values) - 34, bool)
    take[50:116] = take[2000:2066] = True
    first, n, least, content = blocks.spans_of(blocks.Rolling(values), doc, 35, 5, take)
    a, b = first < 1000, first >= 1000
    assert a.sum() > 1 and (first[a] + 1950 == first[b]).all()
    assert (n[a] == n[b]).all() and (least[a] == least[b]).all() and (content[a] == content[b]).all()
    grams = blocks.mix(blocks.Rolling(values).every(5))
    high = grams >> np.uint64(8)
    want = [i + int(np.argmin(high[i : i + 31])) for i in range(len(grams) - 30)]
    assert blocks.least_places(grams, 31).tolist() == want


# --- suffixes


def brute_suffixes(docs, n=100):
    seen, out = set(), []
    for k, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(b[i : i + n])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((k, len(b), int(gone.sum()), runs, sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffixes_against_brute_force(frame):
    docs = corpus(7, 80) + [(500, "ab" * 300), (501, "x" * 350), (502, ""), (503, None), (504, "é" * 120)]
    fixed = "".join(random.Random(1).choices("abcdefgh ", k=200))
    docs += [(600 + i, fixed[:90] + f"{i * 7919 % 1000:04d}" + fixed[90:]) for i in range(40)]
    for hot in (suffixes.HOT, 8, 2):
        got = sorted(map(tuple, suffixes.suffix_digests(frame(docs), hot=hot).collect()), key=repr)
        assert got == brute_suffixes(docs)


def test_suffixes_of_odd_rows(frame, odd):
    got = suffixes.suffix_digests(frame(odd)).collect()
    assert len(got) == len(odd)
    same = [tuple(r) for r in got if r.doc_id == 6 and r.n_bytes == len("same text here")]
    assert same[0] == same[1] and same[0][2] == 0
    assert suffixes.suffix_digests(frame(odd).filter("false")).count() == 0


def test_longest_previous_factors_against_brute_force():
    rng = np.random.default_rng(3)
    for letters, n in ((3, 150), (2, 220), (1, 130), (200, 150)):
        raw = np.concatenate((np.tile(rng.integers(0, letters, n).astype(np.uint8), 2), rng.integers(0, letters, 60).astype(np.uint8), np.tile(rng.integers(0, letters, 37).astype(np.uint8), 5)))
        starts = np.flatnonzero(rng.random(len(raw) - 99) < 0.8)
        data = raw.tobytes()
        want = [max((next((j for j in range(100) if data[a + j] != data[b + j]), 100) for b in starts[:i]), default=0) for i, a in enumerate(starts)]
        assert suffixes.longest_previous(raw, starts).tolist() == want


def test_previous_smaller():
    rng = np.random.default_rng(4)
    for values in (rng.permutation(500), np.arange(300), np.arange(300)[::-1], np.array([0]), np.array([], int)):
        want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
        assert suffixes.previous_smaller(values).tolist() == want


def test_previous_smaller_behind_long_chains():
    up, down = np.arange(1, 20_001), np.arange(40_000, 20_000, -1)
    for values in (down, np.concatenate([[0], up, down]), np.concatenate([down, [5], up[5:][::-1], up[:4]])):
        want, stack = [], []
        for i, x in enumerate(values.tolist()):
            while stack and values[stack[-1]] > x:
                stack.pop()
            want.append(stack[-1] if stack else -1)
            stack.append(i)
        assert suffixes.previous_smaller(values).tolist() == want


# --- near-dedup


def brute_groups(docs, k, percent=80):
    sets = []
    for _, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    low = {}
    order = lambda d: -1 if d is None else d
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d, key=order)
    return sorted(((d, len(s), low[find(i)], d == low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=repr)


def test_near_duplicates_against_brute_force(frame, odd):
    rng = random.Random(11)
    docs = corpus(13, 150) + [(900 + i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    # a hub whose copies are near it but not near each other
    hub = [f"h{i}" for i in range(60)]
    docs.append((2000, " ".join(hub)))
    for i in range(40):
        docs.append((2001 + i, " ".join(w if j not in (i % 30, (i * 7 + 31) % 60, (i * 3 + 11) % 60) else f"z{i}{j}" for j, w in enumerate(hub))))
    for k in (2, 5):
        got = sorted(map(tuple, neardup.near_duplicates(frame(docs), shingle=k).drop("th").collect()), key=repr)
        assert got == brute_groups(docs, k)
    got = sorted(map(tuple, neardup.near_duplicates(frame(odd)).drop("th").collect()), key=repr)
    assert got == brute_groups(odd, 2)
    assert neardup.near_duplicates(frame(odd).filter("false")).count() == 0


def test_components_that_a_head_does_not_join(frame):
    """Chains and copies of copies: links between nodes that are far from the head of their groups."""
    rng = random.Random(19)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(12):
        words = [w if rng.random() > 0.13 else f"x{i}-{j}" for j, w in enumerate(base)]
        docs.append((len(docs), " ".join(words)))
        for _ in range(rng.randint(0, 3)):
            words = [w if rng.random() > 0.04 else f"y{rng.random()}" for w in words]
            docs.append((len(docs), " ".join(words)))
    got = sorted(map(tuple, neardup.near_duplicates(frame(docs)).drop("th").collect()), key=repr)
    assert got == brute_groups(docs, 2) and 1 < len({r[2] for r in got}) < len(docs)


def brute_components(docs, k, percent=80):
    """Smallest key of each document's component, with all intersections from one product of matrices."""
    sets = [neardup.exact_set(t.encode(), k) for _, t in docs]
    number = {}
    m = np.zeros((len(docs), len(set().union(*sets))), np.float32)
    for i, x in enumerate(sets):
        m[i, [number.setdefault(g, len(number)) for g in x]] = 1
    both, n = m @ m.T, m.sum(axis=1)
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    low = np.arange(len(docs))
    while True:
        new = np.where(linked, low[None, :], len(docs)).min(axis=1)
        if (new == low).all():
            return {docs[i][0]: docs[j][0] for i, j in enumerate(low.tolist())}
        low = new


def test_many_edited_copies(frame, monkeypatch):
    """Copies with many edits from a small vocabulary: nearly all share keys, few are linked, and few pairs are held against each other."""
    rng = random.Random(77)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    docs = []
    for i in range(900):
        words = list(base)
        for _ in range(rng.randint(6, 34)):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)]
        docs.append((i, " ".join(words)))
    # a second family that resembles the first, all of its members linked with each other
    second = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in base]
    for i in range(300):
        words = list(second)
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((2000 + i, " ".join(words)))
    docs.append((5000, " ".join(base)))
    counts, confirmed = [], neardup.confirmed

    def counted(pairs, *args):
        counts.append(pairs.count())
        return confirmed(pairs, *args)

    monkeypatch.setattr(neardup, "confirmed", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(docs)).collect()}
    want = brute_components(docs, 2)
    assert got == want and 20 < len(set(want.values())) < 900
    assert max(counts) < 12 * len(docs)


def test_linked_sets_share_a_prefix_key(spark):
    """Whatever the sets: two linked ones of which at least one isn't linked with the head have a key in common."""
    rng = np.random.default_rng(8)
    for percent in (80, 60, 100):
        head = np.arange(1, 61, dtype=np.uint64)
        sets = []
        for _ in range(150):
            kept = rng.permutation(head)[: rng.integers(25, 61)]
            sets.append(np.unique(np.concatenate((kept, rng.integers(100, 130, rng.integers(0, 25)).astype(np.uint64)))))
        rows = []
        for i, x in enumerate(sets):
            d = np.setxor1d(x, head)
            w = (100 + percent) * len(d) - (100 - percent) * len(x)
            rows.append((7, i, i, len(d), w, neardup.weight_class(w, len(head), percent), d.astype(np.int64).tolist()))
        keys = {}
        for r in neardup.prefix_keys(spark.createDataFrame(rows, neardup.DIFFERENCES_DDL).repartition(3), percent).collect():
            keys.setdefault(r.node, set()).add(r.band)
        near = lambda x, y: 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
        with_head = [near(x, head) for x in sets]
        linked = 0
        for i in range(len(sets)):
            assert (rows[i][5] < 2 * neardup.STEPS) == with_head[i]
            for j in range(i):
                if near(sets[i], sets[j]) and not (with_head[i] and with_head[j]) and len(np.setxor1d(sets[i], sets[j])):
                    linked += 1
                    assert keys.get(i, set()) & keys.get(j, set()), (percent, i, j)
        assert linked > 10 or percent == 100


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(5)
    missed = 0
    for n in (9, 18, 45, 90, 450):
        both, own = n * 8 // 9, n - n * 8 // 9
        for _ in range(400):
            v = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = neardup.band_keys(neardup.registers([np.sort(v[: both + own]), np.sort(np.concatenate((v[:both], v[both + own :])))]))
            missed += not (a == b).any()
    assert missed == 0


def test_large_classes_of_equal_sets(frame, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE_CLASS", 5)
    docs = [(i, "the same words in all of these") for i in range(1, 40)] + [(50, "other words"), (51, "other words"), (60, ""), (61, None)]
    got = sorted(map(tuple, neardup.near_duplicates(frame(docs)).drop("th").collect()), key=repr)
    assert got == brute_groups(docs, 2)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
        n = int(1000 * share / (1 + share) * 2)
        a, b = np.unique(values[:1000]), np.unique(np.concatenate((values[:n], values[1000 : 2000 - n])))
        est = neardup.estimate(*neardup.registers([a, b]))
        assert abs(est - n / (2000 - n)) < 0.12


# --- fingerprints


def brute_signature(text):
    import regex

    h8 = lambda x, seed: xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), seed)
    h4 = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = regex.findall(fingerprints.WORD, text)
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    grams = []
    for i in range(max(1, len(hs) - 2)):
        seed = 42
        for h in hs[i : i + 3]:
            seed = h8(h, seed)
        grams.append(seed if hs else xxhash.xxh64_intdigest(b"", 42))
    seen, numbered = {}, []
    for i, g in enumerate(grams):
        g = signed(g) >> 26
        occurrence = seen.get(g, 0)
        seen[g] = occurrence + 1
        if occurrence:
            g = signed(h4(occurrence, h8(g, 42))) >> 26
        numbered.append((g, i))
    sig = []
    circle = [(signed(g << 26) | i) & (2**64 - 1) for g, i in numbered]
    for i in range(fingerprints.ENTRIES):
        point = (2**63 + i * 2**64 // fingerprints.ENTRIES) % 2**64
        two = sorted(circle, key=lambda x: (x - point) % 2**64)[:2]
        a, b = sorted((two * 2)[:2], key=lambda x: x & fingerprints.MASK)
        sig.append((h8(signed(b) >> 26, h8(signed(a) >> 26, h4(i, 42))) >> 32) & 0xFFFFFFFF)
    return "".join(f"{x:08x}" for x in sig)


def test_fingerprints_against_brute_force(frame):
    docs = [*corpus(3, 30), (100, ""), (101, "a"), (102, "a b"), (103, "a b c a b c a b c a b c x a b c"), (104, "中文字 text"), (105, "y" * 60)]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame(docs)).collect()}
    for k, t in docs:
        assert got[k] == brute_signature(t), t
    for k, t in docs:
        for j, u in docs:
            assert t != u or got[k] == got[j]


def test_edited_texts_and_neighbours(frame):
    docs = corpus(4, 50)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(frame(docs)).collect()}
    likeness = lambda a, b: sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 256, 8)) / 32
    for i, (k, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_signature(t) and r.edited_fingerprint == brute_signature(edited)
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == likeness(r.fingerprint, brute_signature(following))


def test_likeness_falls_with_edits_and_moves(frame):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    moved = words[1500:] + words[:1500]
    docs = [(0, " ".join(words))]
    for k, share in ((1, 0.02), (2, 0.1), (3, 0.3)):
        docs.append((k, " ".join(w if rng.random() > share else f"z{rng.random()}" for w in words)))
    docs.append((4, " ".join(moved)))
    sig = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(frame(docs)).collect()}
    like = [sum(sig[0][i : i + 8] == sig[k][i : i + 8] for i in range(0, 256, 8)) / 32 for k in range(5)]
    assert like[0] == 1 and like[1] > like[2] > like[3] and like[1] > 0.7 and like[3] < 0.4
    # the set of k-mers is nearly the same, but half of all pairs have changed their order
    assert 0.2 < like[4] < 0.8


def test_a_heavy_key_is_dealt_over_buckets(frame):
    rng = random.Random(10)
    docs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} {rng.random()} " * 3) for i in range(300)]
    got = fingerprints.neighbours(frame(docs)).collect()
    assert len(got) == 300 and sorted(r.t for r in got) == sorted(t for _, t in docs) == sorted(r.next_t for r in got)
    assert max(Counter(r.b for r in got).values()) < 60
    order = lambda k: -(1 << 63) if k is None else k
    key = {t: order(k) for k, t in docs}
    assert sum(key[r.next_t] < order(r.k) for r in got) == 1
    place = {(r.b, r.rn): r.t for r in got}
    assert all(place[r.nb, r.nrn] == r.next_t for r in got)


def test_fingerprints_of_odd_rows(frame, odd):
    got = fingerprints.edited_fingerprints(frame(odd)).collect()
    assert len(got) == len(odd) and all(r.near_next is not None and r.near_edited is not None for r in got)
    assert len(fingerprints.edited_fingerprints(frame(odd[:1])).collect()) == 1
    assert fingerprints.edited_fingerprints(frame(odd).filter("false")).count() == 0


def test_rows_with_maps_under_repeated_keys(spark):
    text = "one two three four five six seven"
    rows = [(1, text, {"b": 1}, [1]), (1, text, {"a": 2}, [2]), (1, text + " x", None, None), (2, text, {"c": 3}, []), (3, None, {}, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, a array<int>")
    got = neardup.without_near_duplicates(df, shingle=2)
    assert got.schema == df.schema
    kept = sorted((r.doc_id, r.m) for r in got.collect())
    assert [k for k, _ in kept] == [1, 3] and kept[0][1] in ({"b": 1}, {"a": 2}, None) and kept[1][1] == {}
