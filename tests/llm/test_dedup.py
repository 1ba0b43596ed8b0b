"""Duplicate finders against brute force on small, awkward inputs."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomtext.llm import bktree, decontaminate, line_dedup, simhash, simhash_similar, substring_dedup, vector_dedup
from loomtext.llm.common import unused, words_of
from loomtext.llm.components import connected_components

DOCS = "doc_id long, text string, id string, tk long"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 5) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def corpus(seed=1, n=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ß", "a"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 90))]
        if rng.random() < 0.5:
            cut = rng.randint(0, 20)
            words[len(words) // 2 : len(words) // 2] = passage[cut : cut + rng.randint(20, 60)]
        out.append(rng.choice((" ", "  ", "\n", " \t")).join(words))
    return [*out, out[0], out[0], None, "", "   \n", "a " * 50, "b c " * 40, "x", "  y z"]


def test_words_match_split():
    texts = [*corpus(), "tail", "\x0bq\x0c"]
    for column in (pa.array(texts), pa.array(["skip", *texts])[1:]):
        document, hashes, bounds = words_of(column)
        flat = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
        assert document.tolist() == [i for i, _ in flat]
        by_word = {}
        assert all(by_word.setdefault(w, h) == h for (_, w), h in zip(flat, hashes.tolist(), strict=True))
        assert len(set(by_word.values())) == len(by_word)
        assert bounds.tolist() == [sum(1 for j, _ in flat if j < i) for i in range(len(texts) + 1)]


@pytest.mark.parametrize(("k", "m"), [(35, 8), (6, 3), (5, 5), (4, 1)])
def test_substring_dedup(spark, k, m):
    texts = corpus()
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    expected = []
    for i, w in enumerate(words):
        gone = {j for p in range(len(w) - k + 1) if count[tuple(w[p : p + k])] > 1 for j in range(p, p + k)}
        expected.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = substring_dedup.remove_repeats(frame(spark, texts), k=k, m=m, bitmap_bits=12)
    assert sorted(map(tuple, got.collect())) == expected


def test_substring_dedup_empty_and_repeated_ids(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    texts = [" ".join(f"q{i}" for i in range(40)), " ".join(f"r{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40)), "short"]
    got = substring_dedup.remove_repeats(frame(spark, texts, [1, 1, None, None])).collect()
    assert sorted((r["id"] is None, r["n_words"], r["n_removed"]) for r in got) == [(False, 40, 0), (False, 40, 40), (True, 1, 0), (True, 40, 40)]


def test_unused_prefix(spark):
    assert unused(spark.createDataFrame([(1, 2)], "__a int, __ int")) == "___"
    assert unused(spark.createDataFrame([(1, 2)], "a int, _b int")) == "__"


def test_leftmost_least():
    rng = np.random.default_rng(4)
    for span in (1, 2, 5, 28):
        values = rng.integers(0, 6, 200).astype(np.uint64)
        expected = [i + int(np.argmin(values[i : i + span])) for i in range(200 - span + 1)]
        assert substring_dedup.leftmost_least(values, span).tolist() == expected


def test_spans_are_verified_at_their_coordinates():
    """A span whose words aren't those of the repeat doesn't hold."""
    spelled = substring_dedup.Spelled(b" a  b\tc d e a b c d ")
    k = 3
    whole, head, tail = spelled.digest(0, 4), spelled.digest(0, 2), spelled.digest(2, 4)
    assert spelled.holds(0, 2, 1, whole, None, k) and spelled.holds(0, 2, 1, head, tail, k) and spelled.holds(5, 2, 1, whole, None, k)
    assert not spelled.holds(1, 2, 1, whole, None, k) and not spelled.holds(0, 3, 1, head, tail, k) and not spelled.holds(7, 2, 1, whole, None, k)


def test_edges_join_up_to_where_the_graph_branches(spark):
    """Nodes 1-2-3-4-5: an edge from 3 to 9 beside makes 3 branch, so the run of a path that occurs once is cut there."""
    rows = [(7, 70, 0, 1, [1, 2, 3, 4, 5, 6]), (8, 80, 4, 2, [1, 2, 3, 4, 5]), (9, 90, 2, 2, [3, 9]), (6, 60, 1, 1, [20, 21])]
    compact = spark.createDataFrame(rows, "id long, tk long, at int, copies long, ns array<long>")
    got = sorted(tuple(r) for r in substring_dedup.nonbranching(compact).collect())
    assert got == [(7, 70, 0, 2, 1, 3), (7, 70, 2, 2, 3, 5)]


def lines_by_hand(rows):
    """(n_lines, n_removed, text) of each row; rows are (id, text) in order, equal rows next to each other."""
    seen, out = set(), []
    filled = []
    for _, text in rows:
        lines = text.split("\n") if text is not None else []
        filled.append([(i, x) for i, x in enumerate(lines) if any(c not in " \t\n\x0b\x0c\r" for c in x)])
    for at, ((_, text), own) in enumerate(zip(rows, filled, strict=True)):
        gone = set()
        for p in range(len(own) - 2):
            key = tuple(x for _, x in own[p : p + 3])
            if key in seen:
                gone |= {i for i, _ in own[p : p + 3]}
            seen.add(key)
        lines = text.split("\n") if text is not None else []
        out.append((len(lines), len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = ["alpha", "beta", "gamma", "", "  ", "delta é"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None, "", "one\ntwo", "a\na\na\na\na\na", "\n\n\n\n\n\n"]
    texts = list(dict.fromkeys(texts))
    got = line_dedup.deduplicate_lines(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_removed"], r["text"]) for r in got] == lines_by_hand(list(enumerate(texts)))
    assert all(r["id"] == "x" and r["tk"] == 5 for r in got)
    assert line_dedup.deduplicate_lines(frame(spark, [])).count() == 0


def test_line_dedup_repeated_rows_null_ids_and_clashing_columns(spark):
    """Equal rows are told apart; ids may be null or equal; columns named as the operator's own are replaced or kept."""
    a, b, c = "k\nl\nm\nn", "k\nl\nm\nother\nlines", "x\ny"
    rows = [(None, a), (None, a), (1, b), (1, a), (1, a), (2, c), (2, c), (3, None), (3, None), (4, "\n".join("pqrs" * 3))]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    expected = sorted(((r[0], *h) for r, h in zip(sorted(rows, key=order), lines_by_hand(sorted(rows, key=order)), strict=True)), key=str)
    # Which of two different texts of id 1 comes first is settled by a hash; both lose what the rows without id have.
    schema = "doc_id long, text string, n_lines string, n_removed string, __at int, __tk string, id int"
    docs = spark.createDataFrame([(*r, "old", "old", 7, "kept", 8) for r in rows], schema)
    out = line_dedup.deduplicate_lines(docs)
    assert out.columns == ["doc_id", "text", "__at", "__tk", "id", "n_lines", "n_removed"]
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got), key=str) == expected
    assert {(r["__at"], r["__tk"], r["id"]) for r in got} == {(7, "kept", 8)}
    other = line_dedup.deduplicate_lines(docs, prefix="p_")
    assert other.columns == [*docs.columns, "p_n_lines", "p_n_removed"]


def fingerprint_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(n, linked):
    label = list(range(n))
    for a, b in linked:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_simhash_groups(spark):
    texts = [t for t in corpus(2)] + ["One two THREE four", "one TWO three four", "One two three É", None]
    prints = [fingerprint_by_hand(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    got = simhash.simhash_groups(frame(spark, texts)).orderBy("id").collect()
    assert [r["fp"] % (1 << 64) for r in got] == prints
    assert [r["component_id"] for r in got] == components_by_hand(len(texts), linked)
    kept = simhash.simhash_deduplicate(frame(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(components_by_hand(len(texts), linked)))
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    nulls = simhash.simhash_groups(frame(spark, ["p q r", "p q r", "p q r"], [None, 7, 7])).collect()
    assert [r["component_id"] for r in nulls] == [7, 7, 7]


def test_simhash_deduplicate_null_and_repeated_ids(spark):
    a, b, c, d = ("one two three four five", "quite another text stands here", "nothing like the others at all", "some last words of nobody")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, d), (None, d), (7, None), (None, a), (8, c), (8, c)]
    kept = simhash.simhash_deduplicate(frame(spark, [t for _, t in rows], [i for i, _ in rows]))
    assert kept.columns == ["doc_id", "text", "id", "tk"]
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (None, d), (7, None), (8, c)], key=str)


def grams_by_hand(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def near_copies(seed=8):
    """Texts with planted copies of which one word in twelve to thirty is changed, chains among them."""
    rng = random.Random(seed)
    texts = [None, "", "  \n", "a b", "A b", "a b c d e", "a b c d e f"]
    for _ in range(40):
        words = [f"v{rng.randrange(500)}" for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            for _ in range(rng.randint(1, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    rng.shuffle(texts)
    return texts


def test_near_dedup_stage_finds_planted_near_copies(spark):
    import corpus_pipeline as cp

    texts = near_copies()
    sets = [grams_by_hand(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    prints = [fingerprint_by_hand(t) for t in texts]
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in linked) > 20
    kept = cp.near_dedup(spark, frame(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(components_by_hand(len(texts), linked)))
    assert simhash.simhash_deduplicate(frame(spark, []), shingle=5, similarity=0.8).count() == 0
    rows = [(1, texts[0]), (5, texts[0]), (5, "another text of the same id"), (None, "of nobody but alone"), (None, texts[0])]
    kept = simhash.simhash_deduplicate(frame(spark, [t for _, t in rows], [i for i, _ in rows]), shingle=5, similarity=0.8).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([rows[0], *rows[2:4]], key=str)


def test_linker_joins_what_pairs_join():
    rng = random.Random(5)
    base = [rng.sample(range(100), 40) for _ in range(4)]
    sets = sorted({tuple(sorted(set(rng.choice(base)) - set(rng.sample(range(100), 12)) | set(rng.sample(range(100), rng.randint(0, 3))))) for _ in range(80)}, key=len)
    linker = simhash_similar.Linker(0.8)
    hashes = [np.sort(np.array([xxhash.xxh64_intdigest(str(x)) for x in s], np.uint64)) for s in sets]
    prints = simhash_similar.simhashes(hashes).tolist()
    found = [e for i, (fp, own) in enumerate(zip(prints, hashes, strict=True)) for e in linker.add(i, fp, own)]
    linked = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8]
    label = components_by_hand(len(sets), linked)
    assert 1 < len(set(label)) < len(sets) and components_by_hand(len(sets), found) == label


def test_simhash_radius_holds_similar_sets():
    """Sets at 0.8 differ in fewer bits than the radius, small sets too; unrelated ones mostly in more."""
    rng = np.random.default_rng(7)
    far = []
    for n in (5, 9, 10, 45, 90, 900):
        for _ in range(60):
            common, own, theirs = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n * 8 // 9 if n > 5 else 4, n // 9 if n > 5 else 1, n // 9))
            a, b = simhash_similar.simhashes([np.concatenate([common, own]), np.concatenate([common, theirs])]).tolist()
            assert (a ^ b).bit_count() < simhash_similar.RADIUS
            far.append((a ^ int(rng.integers(0, 1 << 63, dtype=np.uint64))).bit_count())
    assert np.mean(np.array(far) > simhash_similar.RADIUS) > 0.5


def test_bk_shards_find_every_link(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(25)]
    values = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for c in centres for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2).collect()
    place = {v: i for i, v in enumerate(signed)}
    linked = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 2]
    assert components_by_hand(len(values), [(place[r["a"]], place[r["b"]]) for r in found]) == components_by_hand(len(values), linked)
    tree = bktree.BKTree()
    for v in values:
        tree.add(v)
    assert all(sorted(tree.within(v, 3)) == [i for i, x in enumerate(values) if (x ^ v).bit_count() <= 3] for v in values[:40])


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = components_by_hand(150, edges)
    assert got == {i: label[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for centre in rng.normal(size=(6, 16)):
            for _ in range(5):
                rows.append((i, (centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist(), label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, [x * 3 for x in rows[0][1]], 0), (i + 3, None, 0), (i + 4, [0.0] * 16, 0), (i + 5, [float("nan")] + [1.0] * 15, 0), (i + 6, [float("inf")] + [1.0] * 15, 0), (i + 7, [], 0), (i + 8, [1.0, None] + [0.0] * 14, 1)]
    return rows


@pytest.mark.parametrize("tile", [1024, 4])
def test_vectors(spark, tile):
    rows = vectors()
    good = {i: np.array(v, float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    linked = [(a, b) for a, b in itertools.combinations(good, 2) if label[a] == label[b] and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.98]
    degree = Counter(x for e in linked for x in e)
    parts = components_by_hand(len(rows), linked)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_dedup.near_vectors(df, tile=tile).orderBy("id").collect()
    assert [(r["id"], r["n_links"], r["component_id"]) for r in got] == [(i, degree[i], parts[i]) for i in range(len(rows))]
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_equal_and_null_ids_and_of_any_size(spark):
    """Rows are vectors of their own; squares that overflow or vanish lose no link."""
    big, small = 1e200, 1e-200
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (None, [2.0, 0.0], 0), (None, [0.0, 1.0], 1), (3, [big, big], 2), (4, [small, small], 2), (6, [1.0, 1.01], 2), (7, [1.0, 1.0, 0.0], 2), (None, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 0, None), (3, 2, 3), (4, 2, 3), (6, 2, 3), (7, 0, 7), (None, 0, None)], key=str)


@pytest.mark.parametrize("dim", [24, 1024, 1040, 4096, 16384])
def test_products_of_codes_are_exact(dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(100, 128, (7, dim)).astype(np.int8), rng.integers(-127, 128, (9, dim)).astype(np.int8)
    for x, y in ((a, b), (a, a)):
        assert (vector_dedup.code_products(x, y) == x.astype(np.int64) @ y.astype(np.int64).T).all()


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c, s, e = vector_dedup.quantise(x)
    about = (c.astype(float) @ c.T.astype(float)) * s[:, None] * s
    assert (np.abs(x @ x.T - about) <= e[:, None] * (1 + e) + e * (1 + e[:, None]) + e[:, None] * e).all()


# ------------------------------------------------------------ decontamination


def test_masks_lose_nothing():
    for size in range(8, 17):
        masks = decontaminate.MASKS[:2] if size == 16 else decontaminate.MASKS[2:]
        placed = [{o + x for x in m} for m in masks for o in range(size - m[-1])]
        assert all(any(not (p & set(hit)) for p in placed) for hit in itertools.combinations(range(size), size // 5))


def leaks_by_hand(texts, items):
    """Pairs (text, item), by the equal words on each diagonal."""
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in t or "").split()
    out = set()
    for j, b in enumerate(map(words, items)):
        w = min(16, len(b))
        if w < 8:
            continue
        for i, t in enumerate(map(words, texts)):
            at = {}
            for q, x in enumerate(b):
                at.setdefault(x, []).append(q)
            diagonals = {}
            for p, x in enumerate(t):
                for q in at.get(x, ()):
                    diagonals.setdefault(p - q, set()).add(p)
            for d, hit in diagonals.items():
                starts = range(max(0, d), min(len(t), len(b) + d) - w + 1)
                if len(hit) >= w - w // 5 and any(sum(p in hit for p in range(s, s + w)) >= w - w // 5 for s in starts):
                    out.add((i, j))
                    break
    return out


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_decontamination(spark, block_words):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)] + ["étude", "Naïve"]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 7, 8, 9, 12, 15, 16, 20, 40, 40)] + [None, ""]
    texts = [None, "", "short"]
    for item in items[:10] * 8:
        words = item.split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = "Changed"
        texts.append(", ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + words + [rng.choice(vocabulary) for _ in range(5)]).upper().replace("É", "é").replace("Ï", "ï"))
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = leaks_by_hand(texts, items)
    got = decontaminate.find_leaks(docs, bench, block_words=block_words).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted(expected)
    kept = decontaminate.decontaminate(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {i for i, _ in expected})
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_decontamination_of_recurring_seeds_and_text_ids(spark, monkeypatch):
    """A seed that recurs on both sides is verified in chunks; ids of any type come back."""
    monkeypatch.setattr(decontaminate, "CHUNK", 7)
    index = decontaminate.Index.of(["a", None, "c"], ["la " * 40, "do re mi fa so la ti do " * 3, "la la"])
    text, item, *_ = index.leaks(pa.array(["la " * 50 + "do re mi fa so la ti do " * 2, None, "x " * 30, "LA, " * 16]))
    assert sorted(zip(text.tolist(), item.tolist(), strict=True)) == [(0, 0), (0, 1), (3, 0)]
    docs = spark.createDataFrame([("first", "la " * 20), (None, "la " * 20), ("other", "x")], "doc_id string, text string")
    bench = spark.createDataFrame([("song", "la " * 18)], "item_id string, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_equal"]) for r in got), key=str) == [("first", "song", 16), (None, "song", 16)]
