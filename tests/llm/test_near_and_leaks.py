import re

import numpy as np
import pytest

pytest.importorskip("metricloom.llm")
from metricloom.llm import pfair_mix as P  # noqa: E402
from metricloom.llm import simhash_slices as S  # noqa: E402
from metricloom.llm import template_decontam as T  # noqa: E402
from metricloom.llm.queries import oracle_sql, queries  # noqa: E402
from metricloom.llm.template_decontam import Index, contaminated_pairs, without_leaks  # noqa: E402


def slow_print(text):
    import xxhash

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A b C d E", "Ä ß x\x0by z", "x " * 9, "w%d " * 3])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_print(text)


def _classes(prints, radius=4):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("seed", range(12))
def test_forest_spans_all_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 10, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (int(rng.integers(1, 150)), 5)).astype(np.uint64), axis=1) for b in base]))
    rng.shuffle(prints)
    radius = seed % 6
    a, b = S.link_forest(np.zeros(len(prints), np.int64), prints, radius)
    place = {int(p): k for k, p in enumerate(prints)}
    want = _classes(prints, radius)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(place[x]), find(place[y])
        parent[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(prints))] == want


def test_components_of_a_chain_and_large_buckets(spark):
    rng = np.random.default_rng(3)
    far = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    chain = [np.uint64(0)]
    for k in range(40):
        chain.append(chain[-1] ^ np.uint64(1 << (k % 60)) ^ np.uint64(1 << ((7 * k + 3) % 60)))
    prints = np.unique(np.concatenate((far, np.array(chain, np.uint64))))
    rows = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    want = _classes(prints)
    for bucket_rows in (5, 4096):
        got = {r.node: r.root for r in S.components(S.near_edges(rows, bucket_rows=bucket_rows)).collect()}
        classes = [got.get(int(x), int(x)) for x in prints.view(np.int64)]
        assert len(set(classes)) == len(set(want)) and len(set(zip(classes, want))) == len(set(want))


def test_simhash_edges(spark):
    rows = [(9, "the quick brown fox jumps over it", 1), (4, "The quick brown fox jumps over it", 2), (None, "the quick  brown fox jumps over it", 3), (7, None, 4), (8, "", 5), (3, "something else altogether now", 6), (3, "something else altogether now", 6), (None, "alone and without any number", 7), (11, "y " * 20_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").selectExpr("*", "doc_id AS component_id", "text AS root")
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_components(docs).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (None, 4), (7, 7), (8, 7), (3, 3), (3, 3), (None, None), (11, 11)], key=str)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([4, 7, 3, None, 11], key=str)
    assert S.simhash_components(docs.limit(0)).collect() == [] == S.one_of_each(docs.limit(0)).collect()


def test_lanes():
    text = "a b c d e f g h"
    assert int(S.fingerprint_lanes(text, 4, 3)[0]) == S.fingerprint(text, 4) and len(set(S.fingerprint_lanes(text, 4, 3).tolist())) == 3
    assert S.fingerprint_lanes("", 5, 4).tolist() == [0] * 4


def _jaccard(a, b):
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_wide_links_similar_texts_and_no_others(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, near = [], []
    for k in range(60):
        words = [word() for _ in range(300)]
        copy = list(words)
        for at in rng.choice(300, 5, replace=False):
            copy[at] = word()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        near.append(_jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    assert sum(near) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket_rows in (3, 4096):
        kept = {r.doc_id for r in S.one_of_each(docs, bucket_rows=bucket_rows).collect()}
        assert {2 * k for k in range(60)} <= kept
        assert np.mean([2 * k + 1 not in kept for k in range(60) if near[k]]) > 0.9


def test_wide_links_are_verified(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    line = " ".join(word() for _ in range(14))
    rows = [(k, " ".join(word() for _ in range(100)) + f"\n{line}" * 20) for k in range(12)]  # a repeated line and nothing else in common
    for k in range(20, 60, 2):
        words = [word() for _ in range(300)]
        copy = [word() if i % 30 == 7 else w for i, w in enumerate(words)]  # every tenth place of a shingle: Jaccard of about 0.7
        rows += [(k, " ".join(words)), (k + 1, " ".join(copy))]
        assert _jaccard(rows[-2][1], rows[-1][1]) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in S.one_of_each(docs, radius=0).collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("seed", range(6))
def test_exact_links_span_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(5)]
    sets = [np.unique(np.concatenate((base[k % 5][rng.random(40) < 0.93], rng.integers(0, 1 << 63, 2, dtype=np.uint64)))) for k in range(60)] + [np.zeros(0, np.uint64)]
    groups = np.sort(rng.integers(0, 3, len(sets)))

    def classes(links):
        root = list(range(len(sets)))
        for a, b in links:
            root = [root[a] if x == root[b] else x for x in root]
        return [root.index(x) for x in root]

    alike = lambda a, b: groups[a] == groups[b] and 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])) > 0
    want = classes([(a, b) for a in range(len(sets)) for b in range(a) if alike(a, b)])
    links = list(zip(*S.alike_forest(groups, sets)))
    assert all(alike(a, b) for a, b in links) and classes(links) == want and len(set(want)) < len(sets)


def test_exact_links_of_a_cluster_in_parts(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in range(10, 190, 20)] + [" ".join(rng.permutation(words)) for _ in range(5)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "node long, text string")
    clusters = spark.createDataFrame([(k, 0) for k in range(len(texts))], "node long, root long")
    for part in (3, 512):
        got = S.components(S.alike_edges(rows, clusters, rows=part)).collect()
        assert {r.node for r in got} == set(range(1, 9)) and {r.root for r in got} == {0}


@pytest.mark.parametrize("shared, other", [(160, 20), (656, 72), (85, 7), (850, 75)])  # Jaccard 0.80, 0.82, 0.86, 0.85
def test_candidates_by_similarity(shared, other):
    rng = np.random.default_rng(shared)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    found = []
    for _ in range(300):
        both = draw(shared)
        h, bounds = np.concatenate((both, draw(other), both, draw(other))), np.array([0, shared + other, 2 * (shared + other)])
        keys, wide = S.bands(h, bounds), S._simhashes(h, bounds, S.LANES)
        found.append((keys[0] == keys[1]).any() and np.bitwise_count(wide[0] ^ wide[1]).sum() <= S.WIDE_RADIUS)
    assert np.mean(found) > 0.98


def test_unrelated_texts_do_not_meet_more_often_the_more_there_are():
    from math import comb

    for n in (10**5, 10**6, 10**8, 10**10):
        blocks = S.blocks_for(n)
        pairs = comb(blocks, blocks - S.RADIUS) * n / 2 ** (64 * (blocks - S.RADIUS) // blocks) / 2
        assert pairs < 300  # comparisons with unrelated fingerprints, a text
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 2000 * 60, dtype=np.uint64)
    keys = S.bands(h, np.arange(0, len(h) + 1, 60))
    assert len(np.unique(keys)) == keys.size  # no two of 2,000 unrelated texts share a band


def test_forest_of_a_large_group_in_spans(spark):
    """A bucket far above its bound: parts with the first row, then what is left with each part."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64), axis=1) for b in base]))
    rows = spark.createDataFrame([(0, int(x), 1) for x in prints.view(np.int64)], "bucket long, node long, size int")

    def compare(groups):
        return groups.selectExpr("group", "bucket", "large", "node", "node AS fp").repartition("group").sortWithinPartitions("group").mapInArrow(S._sliced(4, ["fp"]), S._EDGES)

    want = _classes(prints)
    got = {r.node: r.root for r in S.components(S._spanned(rows, compare, 40)).collect()}
    classes = [got.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(classes)) == len(set(want)) == len(set(zip(classes, want))) > 1


def test_wide_links_pairs_at_the_bound(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = []
    for k in range(200):
        words = [word() for _ in range(275)]
        copy = [word() if i % 40 == 20 and i < 240 else w for i, w in enumerate(words)]  # six words are others: 241 of 301 shingles
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        assert 0.8 <= _jaccard(rows[-2][1], rows[-1][1]) < 0.81
    kept = {r.doc_id for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * k for k in range(200)} <= kept and len(kept) < 206


def test_simhash_query(spark, sf):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    prints = np.array([slow_print(t) for _, t in docs], np.uint64)
    want = {d: (format(int(p), "016x"), docs[c][0]) for (d, _), p, c in zip(docs, prints, _classes(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op9_simhash_components"](spark, sf).collect()} == want


ITEMS = [(1, "A train leaves Berlin at 9 hours and travels 120 km before Anna stops it for 20 minutes near the old bridge"), (2, "A train leaves Berlin at 9 hours and travels 120 km before Anna stops it for 20 minutes near the old bridge"), (3, None), (None, "this item has no number so that nobody can name it at all"), (4, "too short"), (5, "")]


def test_templates(spark):
    text = ITEMS[0][1]
    index = Index.of(ITEMS)
    found = lambda t: [f[0] for f in index.found([t])[0]]
    assert found(text) == found(f"Some words before. {text}. And after.") == found(text.upper().lower().replace("a train", "A train").replace("berlin", "Berlin").replace("anna", "Anna")) == [1]
    assert found(text.replace("120", "340").replace("Berlin", "Paris").replace("km", "miles")) == [1]
    item, share, slots, changed = index.found([text.replace("120", "340")])[0][0]
    assert (item, changed) == (1, 1) and share > 0.9 and slots == 8
    twice = Index.of([(1, "If Tom has 5 apples and then gives 5 apples to his very good friend Sue how many apples remain")])
    assert twice.found(["If Tom has 7 apples and then gives 7 apples to his very good friend Sue how many apples remain"])[0]
    assert not twice.found(["If Tom has 7 apples and then gives 8 apples to his very good friend Sue how many apples remain"])[0]
    assert not found("A train leaves the station in the morning and nobody stops it near the old bridge") and not found("") and Index.of([]).found(["x"]) == [[]]


def test_templates_with_a_word_or_token_more_or_less():
    text = "when the old train leaves for the coast it carries nine sacks of green apples"
    words, index = text.split(), Index.of([(1, text)])
    for k in range(15):
        assert index.found(["so " + " ".join(words[:k] + ["very"] + words[k:]) + " now"])[0], k
        assert index.found(["so " + " ".join(words[:k] + words[k + 1 :]) + " now"])[0], k
    text = "The baker Anna sells 120 loaves of bread to her friend and then walks 7 km home through the rain"
    index = Index.of([(1, text)])
    for old, new in (("120", "3.5"), ("120", "1,200"), ("120", "1 200"), ("Anna", "Mary Ann")):
        assert index.found([text.replace(old, new)]) == [[(1, 1.0, 4, 1)]], new


def test_verbatim_short_and_case_folded_items():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    index = Index.of([(1, " ".join(words)), (2, "too short"), (3, "12 + 7 = 19, 3 + 4 = 7, 5 + 6 = 11"), (4, "those are Anna, Bert, Carl, Dora, Emil, Fritz, Gerd, Hans"), (5, ITEMS[0][1])])
    found = lambda t: [f[0] for f in index.found([t])[0]]
    for a in (0, 3, 11, 27):  # 33 of 60 words
        assert found("so " + " ".join(words[a : a + 33]) + " end") == [1]
        assert found("so " + " ".join(words[a : a + 19]) + " end") == []
    assert found("this is TOO short, is it") == [2] and found("too very short") == []
    assert found("note that 12 + 7 = 19, 3 + 4 = 7, 5 + 6 = 11 holds") == [3] and found("12 + 7 = 19, 3 + 4 = 8, 5 + 6 = 11") == []
    assert found("And those are Anna, Bert, Carl, Dora, Emil, Fritz, Gerd, Hans") == found("and THOSE are anna, bert, carl, dora, emil, fritz, gerd, hans") == [4]
    for text in (ITEMS[0][1], ITEMS[0][1].replace("120", "340")):
        assert found(text.upper()) == found(text.lower()) == found("He said: " + text.upper()) == [5]


def test_contamination_edges(spark):
    text = ITEMS[0][1]
    docs = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, f"x y. {text}", 2), (3, None, 3), (4, "", 4), (5, "filler " * 30_000 + ". " + text, 5), (6, "clean text", 6)], "doc_id long, text string, item_id long").selectExpr("*", "text AS covered")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "item_id AS doc_id")
    assert sorted(((r.doc_id, r.item_id) for r in contaminated_pairs(docs, items).collect()), key=str) == sorted([(1, 1), (1, 1), (None, 1), (5, 1)], key=str)
    assert contaminated_pairs(docs.limit(0), items).collect() == [] == contaminated_pairs(docs, items.limit(0)).collect()
    assert sorted(r.doc_id for r in without_leaks(docs, items).collect()) == [3, 4, 6] and without_leaks(docs, items).columns == docs.columns


def slow_template(text, with_names):
    """(token or kind, what stands there) of a text, by regular expressions."""
    low = lambda w: "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in w)
    found, out = list(re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)), []
    for k, m in enumerate(found):
        w, gap = m[0], text[found[k - 1].end() : m.start()] if k else None
        digit, was_digit = w[0] in "0123456789", k > 0 and found[k - 1][0][0] in "0123456789"
        glued = k > 0 and digit and was_digit and gap in (".", ",")
        begins = k == 0 or (re.search(r"[.!?:;\n]", text[found[k - 1].start() : m.start()]) is not None and not glued)
        name = with_names and low(w[0]) != w[0] and not begins
        joined = k > 0 and gap in (" ", "-", "'")
        if out and (glued or (joined and digit and was_digit and not begins) or (joined and name and out[-1][0] == "NAME")):
            out[-1] = (out[-1][0], (*out[-1][1], low(w)))
            continue
        unit = out and out[-1][0] == "NUMBER" and not begins and low(w) in T.UNITS and not digit
        out.append(("NUMBER" if digit else "UNIT" if unit else "NAME" if name else low(w), (low(w),)))
    return out


def slow_leak(item, text):
    """Whether a text has an item: every shift, every run of equal tokens, and the best order of them."""
    plain, mine = ([w for t in slow_template(x, False) for w in t[1]] for x in (text, item))
    need = min(T.VERBATIM, len(mine))
    if mine and any(mine[a : a + need] == plain[b : b + need] for a in range(len(mine) - need + 1) for b in range(len(plain) - need + 1)):
        return True
    for names in (True, False):
        x, y = slow_template(item, names), slow_template(text, names)
        kinds = ("NUMBER", "UNIT", "NAME")
        windows = [a for a in range(len(x) - 4) if sum(t[0] not in kinds for t in x[a : a + 5]) >= 3]
        shifts = {b - a for a in windows for b in range(len(y) - 4) if [t[0] for t in x[a : a + 5]] == [t[0] for t in y[b : b + 5]]}
        for shift in shifts:
            runs = []
            for s in range(shift - 8, shift + 9):
                a = 0
                while a < len(x):
                    e = a
                    while e < len(x) and 0 <= e + s < len(y) and x[e][0] == y[e + s][0]:
                        e += 1
                    if e - a >= 4:
                        runs.append((a, e, s))
                    a = max(e, a + 1)
            best = {}

            def longest(k):
                """Pairs of the longest chain that ends with run k, whole to its end."""
                if k not in best:
                    a, e, s = runs[k]
                    chains = [[(i, i + s) for i in range(a, e)]]
                    for j, (_, ej, sj) in enumerate(runs):
                        begin = max(a, ej, ej + sj - s)
                        if ej < e and begin < e:
                            chains.append(longest(j) + [(i, i + s) for i in range(begin, e)])
                    best[k] = max(chains, key=len)
                return best[k]

            chain = max(map(longest, range(len(runs))), key=len, default=[])
            pairs = {(x[i][1], y[j][1]) for i, j in chain if x[i][0] in kinds}
            if chain and len(chain) >= 0.6 * len(x) and len(pairs) == len({p[0] for p in pairs}):
                return True
    return False


def test_templates_against_a_slow_matcher():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi") for b in ("st", "rn", "ld", "ff", "gg")] + ["Anna", "Élan", "Bob", "12", "7", "3.5", "km", "kg", "hours", "1,200"]
    text = lambda n: " ".join(str(w) + str(rng.choice(["", "", "", ",", ".", ":"])) for w in rng.choice(words, n))
    items = [(k, text(int(rng.integers(2, 30)))) for k in range(25)]
    index, seen = Index.of(items), set()
    for k in range(250):
        parts = items[k % 25][1].split()
        for _ in range(int(rng.integers(0, 5))):
            at = int(rng.integers(0, len(parts)))
            parts[at : at + int(rng.integers(0, 2))] = [str(w) for w in rng.choice(words, int(rng.integers(0, 2)))]
            parts = parts or ["x"]
        doc = f"{text(6)} {' '.join(parts)} {text(6)}"
        got = {f[0] for f in index.found([doc])[0]}
        assert got == {i for i, t in items if slow_leak(t, doc)}, doc
        seen.add((k % 25) in got)
    assert seen == {True, False}


def test_a_large_benchmark_takes_passes_with_one_broadcast_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [(k, " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(12))) for k in range(40)]
    docs = spark.createDataFrame([(k, f"x {t} y") for k, t in items] + [(99, "clean of all that")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(T, "PASS_BYTES", 500)
    live, most, real = set(), [], type(spark.sparkContext).broadcast

    def broadcast(self, value):
        b = real(self, value)
        if isinstance(value, Index):
            live.add(b)
            most.append(len(live))
            b.destroy = lambda: live.discard(b) or type(b).destroy(b)
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert sorted((r.doc_id, r.item_id) for r in contaminated_pairs(docs, table).collect()) == [(k, k) for k in range(40)]
    assert len(most) > 5 and max(most) == 1
    assert [r.doc_id for r in without_leaks(docs, table).collect()] == [99]


def test_contamination_query_finds_verbatim_items(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert want and {(r.doc_id, r.item_id) for r in queries()["op10_template_decontamination"](spark, sf).collect()} == want


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 3, "b": 2, "c": 2}, {"a": 10_000, "b": 1}, {f"s{k}": 1 for k in range(20)}, {f"s{k}": (k % 7) ** 3 + 1 for k in range(60)}])
def test_pfair_deviation_from_the_weights_is_below_a_block(weights):
    """After any number of slots, against the weights themselves; periods that don't divide the whole, over 10^6 slots at their ends."""
    q = P.reduced(weights)
    slots, total = sum(q.values()), sum(weights.values())
    had = dict.fromkeys(q, 0)
    for s, j, t in P.period(q):
        assert j == had[s] and j * slots // q[s] <= t < -(-(j + 1) * slots // q[s])
        had[s] += 1
        assert all(abs(had[x] * total - weights[x] * (t + 1)) < total for x in q)
    n = 10**6
    at = {s: [] for s in q}
    for s, j, t in P.period(q):
        at[s].append(t)
    for s, own in at.items():
        got = n // slots * len(own) + sum(t < n % slots for t in own)
        assert abs(got * total - weights[s] * n) < total


def test_pfair_refuses_what_it_cannot_plan(spark):
    for weights in ({"a": P.MOST_SLOTS, "b": 1}, {"a": 0}, {"a": 1.5}):
        with pytest.raises(ValueError):
            P.reduced(weights)
    assert P.reduced({"a": 6 * P.MOST_SLOTS, "b": 3 * P.MOST_SLOTS}) == {"a": 2, "b": 1}
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    with pytest.raises(ValueError):
        P.pfair_slots(docs, {"b": 1})


def test_many_sources(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 3000) AS source")
    got = P.pfair_slots(docs, block_docs=1).collect()
    assert len({r.mix_slot for r in got}) == len(got) == 6000
    assert P.tempered({"a": 10**12, "b": 1}) == {"a": 1024, "b": 1}


def test_mix_edges(spark):
    rows = [(k, "hot", "t" * 10) for k in range(90)] + [(k, "b", "u") for k in range(90, 100)] + [(None, None, None), (None, None, None), (100, None, ""), (5, "b", "u"), (5, "b", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "doc_id AS mix_slot", "text AS count", "source AS __x", "text AS _source", "doc_id AS _Q", "text AS _before", "1 AS _slot")
    weights = {"hot": 1, "b": 2, None: 1}
    mixed = P.pfair_slots(docs, weights, block_docs=2)
    got = mixed.collect()
    assert len(got) == len(rows) and mixed.columns == [c for c in docs.columns if c != "mix_slot"] + ["mix_block", "mix_slot", "mix_place"]
    assert all((r._source, r._Q, r._before, r._slot) == (r.text, r.doc_id, r.text, 1) for r in got)
    assert len({(r.mix_slot, r.mix_place) for r in got}) == len(rows)
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.mix_block), set()).add(r.mix_slot)
    assert all(len(v) == 1 for v in blocks.values())
    slots = {s: sorted(v.copy().pop() for (x, _), v in blocks.items() if x == s) for s in ("hot", "b", None)}
    for s, w in weights.items():
        for t in range(max(slots[s])):
            assert abs(sum(x <= t for x in slots[s]) * 4 - w * (t + 1)) < 4
    assert P.pfair_slots(docs.limit(0)).collect() == []
    again = P.pfair_slots(docs.drop("mix_slot").withColumn("mix_place", docs.text), weights, names=("x1", "x2", "x3"))
    assert again.where("mix_place <=> text").count() == len(rows) and "x2" in again.columns


def test_ids_that_many_rows_share_are_split(spark, monkeypatch):
    monkeypatch.setattr(P, "SAME_ID", 10)
    docs = spark.range(300).selectExpr("if(id < 200, cast(null AS bigint), id) AS doc_id", "'a' AS source", "cast(id % 50 AS string) AS text").unionByName(spark.range(40).selectExpr("7L AS doc_id", "'b' AS source", "'same' AS text"))
    got = P.pfair_slots(docs, block_docs=1).collect()
    assert sorted((r.source, r.mix_block) for r in got) == [("a", k) for k in range(300)] + [("b", k) for k in range(40)]
    plan = P.pfair_slots(docs, block_docs=1)._jdf.queryExecution().toString()
    assert "_split" in plan


def test_mix_query_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(oracle_sql()["op4_pfair_mix"])
    names = [c[0] for c in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in queries()["op4_pfair_mix"](spark, sf).collect()) == sorted(cur.fetchall())
