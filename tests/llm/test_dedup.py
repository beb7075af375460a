"""Duplicate finders against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import xxhash

from shrinkwise.llm import substring_dedup
from shrinkwise.llm.components import connected
from shrinkwise.llm.embedding_pairs import embedding_near_duplicates
from shrinkwise.llm.exact_dedup import exact_duplicates
from shrinkwise.llm.simhash import simhash, simhash_near_duplicates
from shrinkwise.llm.substring_dedup import WINDOW, remove_repeated_passages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    """Smallest node reachable from each node."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (139, 150)]
    out = {r.node: r.root for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    expected = groups({n for link in links for n in link}, links)
    assert out == {n: r for n, r in expected.items() if n != 200}


def test_components_of_no_links(spark):
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def plain_fingerprint(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(rng, n):
    base = [rng.choices([f"w{i}é" for i in range(300)], k=rng.randint(0, 120)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = "other"
        out.append(rng.choice([" ", "\n", "  \t"]).join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return out


def test_simhash_equals_brute_force(spark):
    texts = near_copies(random.Random(1), 160)
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert all(int.from_bytes(simhash(t), "big") == prints[i] for i, t in enumerate(texts))
    links = [(a, b) for a in prints for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert links
    expected = groups(prints, links)
    files = spark.createDataFrame(list(enumerate(texts)), "rel_path bigint, text string")
    for tile in (1024, 3):
        out = simhash_near_duplicates(files, tile=tile).collect()
        assert {r.rel_path: (int(r.fingerprint, 16), r.component_id) for r in out} == {i: (prints[i], expected[i]) for i in prints}


def test_exact_duplicates_equal_brute_force_at_any_block_size(spark):
    rng = random.Random(2)
    base = ["x" * 9 + "é" * 4, "x" * 9 + "é" * 3, "abc", "ABC", "", "aB" * 40, "ab" * 40, "ab" * 39]
    texts = [rng.choice(base) for _ in range(60)]
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in texts]
    files = spark.createDataFrame(list(enumerate(texts)), "rel_path bigint, text string")
    for block in (4096, 3):
        for r in exact_duplicates(files, block=block).collect():
            same = [i for i, t in enumerate(lower) if t == lower[r.rel_path]]
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.rel_path == max(same))
            assert r.text_sha256 == hashlib.sha256(lower[r.rel_path].encode()).hexdigest()


def passages(rng):
    word = lambda: "".join(rng.choices("abcd", k=3))
    shared = [[word() for _ in range(rng.randint(36, 60))] for _ in range(3)]
    texts = []
    for _ in range(40):
        text = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(shared)[rng.randint(0, 5) :]
        texts.append(text)
    return [*texts, ["same"] * 120, ["a", "b"] * 50, [f"u{i}" for i in range(35)], [f"u{i}" for i in range(36)], ["x"] * 34]


def test_repeated_passages_equal_brute_force(spark):
    texts = passages(random.Random(3))
    count = Counter(tuple(t[i : i + WINDOW]) for t in texts for i in range(len(t) - WINDOW + 1))
    files = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rel_path bigint, text string")
    for bucket in (4096, 1):
        out = {r.rel_path: r for r in remove_repeated_passages(files, bucket=bucket).collect()}
        for i, t in enumerate(texts):
            gone = {k for s in range(len(t) - WINDOW + 1) if count[tuple(t[s : s + WINDOW])] > 1 for k in range(s, s + WINDOW)}
            assert (out[i].n_words, out[i].n_removed) == (len(t), len(gone))
            assert out[i].kept == " ".join(w for k, w in enumerate(t) if k not in gone)
    assert out[40].n_removed == 120 and out[44].n_removed == 0 and out[42].n_removed == 35


def test_no_task_holds_all_copies_of_a_window(spark, monkeypatch):
    def held(rows, window, inner=substring_dedup.repeated_windows):
        if len(rows) > 50:
            raise ValueError(f"{len(rows)} rows in one group")
        return inner(rows, window)

    monkeypatch.setattr(substring_dedup, "repeated_windows", held)
    passage = [f"p{i}" for i in range(WINDOW + 4)]
    texts = [[f"a{i}"] * 2 + [f"b{i}-{k}" for k in range(40)] + passage + [f"c{i}-{k}" for k in range(40)] for i in range(300)]
    files = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rel_path bigint, text string")
    out = remove_repeated_passages(files, bucket=50).collect()
    assert len(out) == 300 and {(r.n_words, r.n_removed) for r in out} == {(82 + len(passage), len(passage))}
    assert all(r.kept.split() == [w for w in texts[r.rel_path] if w[0] != "p"] for r in out)


def test_a_long_repeated_word_is_cut_into_stretches():
    runs = substring_dedup.super_kmers([b"word"] * 100_000, WINDOW)
    value, first, last, weight = runs
    assert (last - first + 1).max() <= substring_dedup.STRETCH and set(weight.tolist()) == {2} and len(set(value.tolist())) == 1
    assert first[0] == 0 and last[-1] == 100_000 - WINDOW and (first[1:] == last[:-1] + 1).all()


def test_no_bucket_has_more_windows_than_its_bound(spark, monkeypatch):
    def held(rows, window, inner=substring_dedup.repeated_windows):
        if sum(len(r["packed"].split(b" ")) - window + 1 for r in rows) > 2000:
            raise ValueError("too many windows in one group")
        return inner(rows, window)

    monkeypatch.setattr(substring_dedup, "repeated_windows", held)
    long = "x" * 5000
    texts = [[f"a{i}", *["word"] * (9000 + i)] for i in range(4)] + [[f"b{i}", *[long, "y"] * 40] for i in range(2)] + [[f"u{i}" for i in range(60)]]
    files = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "rel_path bigint, text string")
    out = {r.rel_path: r for r in remove_repeated_passages(files, bucket=2000).collect()}
    assert [(out[i].n_words, out[i].n_removed, out[i].kept) for i in range(4)] == [(9001 + i, 9000 + i, f"a{i}") for i in range(4)]
    assert [(out[i].n_removed, out[i].kept) for i in (4, 5, 6)] == [(80, "b0"), (80, "b1"), (0, " ".join(texts[6]))]


def test_an_untouched_text_can_stay_as_it_was(spark):
    files = spark.createDataFrame([(1, "a  b\nc", "en")], "rel_path bigint, text string, lang string")
    assert remove_repeated_passages(files, whole=True, carry=["lang"]).first() == (1, 3, 0, "a  b\nc", "en")


def test_embedding_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vecs = [(centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12])).tolist() for _ in range(150)]
    rows = [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(vecs)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None, *vecs[0][1:]], 0), (204, [1e300] * 16, 1), (205, [1e-300] * 16, 1), (206, [1.0], 1), (207, vecs[4], 1), (207, vecs[4], 1)]
    good = {i: n for n, (i, v, y) in enumerate(rows) if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {n: np.array(rows[n][1]) / np.abs(rows[n][1]).max() for n in range(len(rows)) if rows[n][0] in good}
    unit = {n: v / np.sqrt(v @ v) for n, v in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    degree = Counter(n for link in links for n in link)
    least = groups(range(len(rows)), links)
    assert len(links) > 50
    expected = sorted((rows[n][0], degree[n], rows[least[n]][0]) for n in range(len(rows)))
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for tile, block in ((4096, 512), (5, 512), (40, 7)):
        out = embedding_near_duplicates(table, tile=tile, block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == expected
        assert all(r.kept == (r.vec_id == r.component_id) for r in out)
