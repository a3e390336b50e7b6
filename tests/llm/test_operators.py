"""The text operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonamark.llm import bpe_lexicon, exact_dedup, gru_langid, lattice_lm, licences, minhash, packing, prefix_hash, token_counts, token_files
from sonamark.llm.common import split_join, tokenizer_path, words_of, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, label string, key string, uid long"
WORDS = "the of and nature light where können größe été señor river stone <|endoftext|> it's 42 ½ ſ İstanbul ΣΑΣ 日本語 don't !!! 𝔘 naïve".split()


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en" if t and "the" in t else "de", s, 0, 1, 2, "x", "k", 3) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    rows = [(i, say(int(rng.integers(1, 60))), f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, rows[3][1], "s0") for i in range(5)] + [(110, rows[4][1].upper() if rows[4][1].isascii() else rows[4][1], "s1")]
    base = [f"w{i}" for i in range(80)]
    rows += [(200 + i, " ".join([*base[:-i], *(f"x{i}{k}" for k in range(i))]) if i else " ".join(base), "s0") for i in range(8)]
    rows += [(300, None, None), (301, "", "s0"), (302, " \t\n", "s0"), (303, "z" * 5000, "s1"), (304, "the river " * 3000, "s2"), (None, "no id the", None), (5, rows[5][1], "s1"), (5, rows[5][1], "s1")]
    return make(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def norm(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact(docs, empty):
    df, rows = docs
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((i, best[norm(t)], len(groups[norm(t)]), i == best[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, _ in rows)
    assert Counter(map(tuple, exact_dedup.exact_duplicates(df).collect())) == want
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact(empty).count() == 0


def test_near(docs, empty):
    df, rows = docs
    sets = []
    for _, t, _ in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            part[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = Counter((i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _, _) in enumerate(rows))
    assert Counter(map(tuple, minhash.near_duplicates(df).collect())) == want
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near(df).columns == df.columns


def test_rarest_shingles_lose_nothing(spark):
    """across() on sets near the threshold, each of its own component: every true link is among its pairs, and few others are."""
    rng = np.random.default_rng(2)
    rows = []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(60 + 50 * family)]
        for v in range(14):
            w = base[: len(base) - int(rng.integers(0, len(base) // 3))]
            for at in rng.choice(len(w), int(rng.integers(0, 4)), replace=False):
                w[at] = f"x{family}v{v}a{at}"
            rows.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(rows))), "doc_id long, text string")
    sketch = minhash.sketches(df, "doc_id", "text")
    nodes = sketch.groupBy("node").agg(F.min("uid").alias("uid"))
    rest = sketch.select("node", F.col("node").alias("label"), F.col("n_shingles").alias("n"))
    name = {r.node: r.id for r in sketch.select("node", "id").collect()}
    got, none = ({tuple(sorted((name[r.a], name[r.b]))) for r in df.collect()} for df in minhash.across(written(rest, "rest"), nodes, sketch, 75))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words_of(t) for t in dict.fromkeys(rows))]
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(sets)), 2)}
    true = {p for p, j in like.items() if j >= 0.75}
    assert len(true) > 20 and true <= got and not none
    assert not any(like[p] == 0 or 4 * min(map(len, (sets[p[0]], sets[p[1]]))) < 2.8 * max(map(len, (sets[p[0]], sets[p[1]]))) for p in got)
    same = {p for p in true if p[0] % 3 == p[1] % 3}  # three components: pairs within one are not made
    thirds = sketch.select("node", F.pmod("id", F.lit(3)).alias("label"), F.col("n_shingles").alias("n"))
    for few, cell in ((1 << 20, 1), (0, 1 << 20), (1, 400)):  # all in pairs, the largest label in one cell, in several
        got, links = ({tuple(sorted((name[r.a], name[r.b]))) for r in df.collect()} for df in minhash.across(written(thirds, "thirds"), nodes, sketch, 75, few, cell))
        assert true - same <= got | links and not any(a % 3 == b % 3 for a, b in got | links)
        assert links <= true and bool(links) == (few < 1 << 20)


def test_hot_keys_are_split(spark):
    """A key with a third of the rows is dealt to many tasks, with the same rows as a plain join; null keys drop out."""
    rows = written(spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("k")), "rows")
    table = written(spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "table")
    plain = sorted(map(tuple, rows.join(table, "k").select("id", "k", "v").collect()))
    split = split_join(rows, table, "k", "id")
    assert sorted(map(tuple, split.select("id", "k", "v").collect())) == plain and split.columns == ["k", "id", "v"]
    sizes = rows.groupBy("k").agg(F.count("*").alias("_n"))
    assert split_join(rows, table, "k", "id", sizes=sizes).count() == len(plain)
    assert split_join(rows.limit(0), table, "k", "id").count() == 0


def test_merge_of_runs(spark):
    """Half of the rows are one text; segments, several rounds, the smallest or largest identifier."""
    texts = ["hot" if i % 2 else f"t{i % 97}" for i in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    for keep, pick in (("max", max), ("min", min)):
        rows = written(exact_dedup.digests(df, F.col("doc_id"), F.col("text")), "digests")
        merged = exact_dedup.merge_runs(rows, 12, 5, 3, keep)
        groups = {}
        for i, t in enumerate(texts):
            groups.setdefault(hashlib.sha256(t.encode()).digest(), []).append(i)
        assert {bytes(r.sha): (r.best, r.group_size) for r in merged.collect()} == {k: (pick(v), len(v)) for k, v in groups.items()}
        assert merged.count() == len(groups)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Sort" in plan and "Python" not in plan and "Arrow" not in plan


def test_clashing_names_of_dedup(spark):
    """Columns that are named like helpers, in any case, come back as they were; repeated rows leave one, whatever the partitions."""
    rows = [(1, "The river runs", "a", True, "s", 5, {"m": 1}), (1, "the RIVER runs", "b", False, "t", 6, {"m": 2}), (2, "other", "c", None, "u", 7, None), (None, "other", "d", True, "v", 8, None), (None, None, "e", True, "w", 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _null boolean, Row string, row_ int, m map<string,int>")
    for drop in (exact_dedup.drop_exact, minhash.drop_near):
        seen = set()
        for parts in (1, 3):
            got = drop(df.repartition(parts))
            assert got.columns == df.columns
            out = [tuple(r) for r in got.collect()]
            assert all(r in rows for r in out) and len(out) == 3 and sum(r[0] == 1 for r in out) == 1
            seen.add(tuple(sorted(map(str, out))))
        assert len(seen) == 1 or drop is minhash.drop_near


def test_token_files_and_encoding(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    df, rows = docs
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, t, _ in rows:
        want[i] = lib.encode(t or "", add_special_tokens=False).ids
    got = bpe_lexicon.encode_documents(df, words=12, with_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == want[r.doc_id] and r.decoded == lib.decode(want[r.doc_id], skip_special_tokens=False)
    index = token_files.token_files(df, f"file://{tmp_path}/t")
    at = sorted(index.collect(), key=lambda r: (r.file, r.offset))
    assert [r.doc_id for r in at] == sorted((i for i, _, _ in rows), key=lambda i: -1 if i is None else i)
    start = 0
    for r in at:
        ids = np.array([*want[r.doc_id], 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = token_files.read_indexed(spark, f"file://{tmp_path}/t", index.where("doc_id % 7 = 3")).collect()
    assert some and all(r.ids == [*want[r.doc_id], 2] for r in some)
    assert token_files.token_files(empty, f"file://{tmp_path}/e").count() == 0 and bpe_lexicon.encode_documents(empty).count() == 0


def test_damaged_records():
    good = token_files.frame(b"payload") + b"\n"
    assert [p for _, _, p in token_files.records(good * 2)] == [b"payload"] * 2
    for bad in (good[:-3], good[:3] + b"x" + good[4:], good[:14] + b"x" + good[15:]):
        with pytest.raises(ValueError):
            list(token_files.records(bad))


def test_merging_long_words():
    bpe = bpe_lexicon.word_bpe(tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    for n in (1, 2, 30, 250, 900):
        word = "".join(rng.choice(list("etaoinshr"), n)).encode()
        ids = [bpe.first[b] for b in word[:-1]] + [bpe.last[word[-1]]]
        assert bpe._merge_long(list(ids)) == bpe._merge_short(list(ids)) == bpe.library.encode(word.decode(), add_special_tokens=False).ids
    words = [b"abc", b"abd", b"xbc", b"a", b"bc"]
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon([(w, [k, k + 1]) for k, w in enumerate(words)]))
    assert all(lexicon.get(w) == [k, k + 1] for k, w in enumerate(words)) and lexicon.get(b"ab") is None and lexicon.get(b"") is None


def segmentations(word, pieces):
    if not word:
        yield 1.0
    for p, x in pieces.items():
        if word.startswith(p):
            for rest in segmentations(word[len(p) :], pieces):
                yield x * rest


def test_lattice():
    pieces = {b"a": 0.2, b"b": 0.1, b"ab": 0.15, b"a\xff": 0.1, b"b\xff": 0.2, b"ba\xff": 0.05, b"bab": 0.2}
    lattice = lattice_lm.Lattice(list(pieces), np.log(list(pieces.values())))
    words = [b"a", b"ab", b"abab", b"babba", b"abababab"]
    brute = [sum(segmentations(w + b"\xff", pieces)) for w in words]
    expected = np.zeros(len(pieces) + 1)
    assert np.allclose(np.exp(lattice.forward(words, np.ones(5), expected)), brute)
    alone = np.zeros(len(pieces) + 1)
    assert np.allclose(np.exp([lattice._long(w, 1.0, alone) for w in words]), brute) and np.allclose(alone, expected)
    assert np.isclose(expected[[3, 4, 5]].sum(), 5)  # one last piece for each word


def test_lm_scores(docs, empty):
    df, rows = docs
    got = lattice_lm.score_documents(df).collect()
    assert len(got) == len(rows)
    count = Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t, _ in rows:
        if not held(i):
            count.update([*words_of(t), b""])
    n, v = count.total(), len(count)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        w = [*words_of(texts[r.doc_id]), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(count[x] > 0 for x in w), n)
        assert np.isclose(r.base_score, sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0
    assert lattice_lm.score_documents(empty).count() == 0


def test_fingerprints(docs, empty):
    df, rows = docs
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = {r.doc_id: r for r in prefix_hash.fingerprint_documents(df).collect()}
    assert prefix_hash.fingerprint_documents(df).count() == len(rows) and prefix_hash.fingerprint_documents(empty).count() == 0
    for k, (i, t, _) in enumerate(order):
        if i == 5:
            continue  # repeated rows: any order of theirs is right
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same = next((n for n, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        assert r.common_prefix == same and 0 <= r.near_edited <= 1 and r.near_edited == prefix_hash.likeness(r.fingerprint, r.edited_fingerprint)
    a, b = prefix_hash.Prefixes("xxabcabcd"), prefix_hash.Prefixes("abcabce")
    assert a.span(2, 5) == a.span(5, 8) == b.span(0, 3) != a.span(3, 6) and prefix_hash.longest_common_extension(a, 2, b, 0) == 6


def test_token_counts(docs, empty):
    df, rows = docs
    pieces = set(token_counts.pieces_of(tokenizer_path(token_counts.VOCABULARY)))
    most = max(map(len, pieces))

    def greedy(s):
        at = n = 0
        while at < len(s):
            for k in range(min(most, len(s) - at), 0, -1):
                if s[at : at + k] in pieces:
                    n, at = n + 1, at + k
                    break
            else:
                n, at = n + len(s[at].encode()), at + 1
        return n

    want = Counter((i, len(w := token_counts.WORD.findall(t or "")), sum(greedy("▁" + x) for x in w)) for i, t, _ in rows)
    assert Counter(map(tuple, token_counts.count_tokens(df).collect())) == want and token_counts.count_tokens(empty).count() == 0
    tiny = token_counts.Automaton(["ab", "abcd", "c", "de", "a"])
    assert [tiny.count(x) for x in ("abcde", "abcd", "abc", "xab", "")] == [2, 1, 2, 2, 0]  # abcd e: e costs its byte


def brute_pack(items, capacity):
    """Best fit by looking at every bin: (bin, offset) of each (size, source, cluster)."""
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(capacity - b["used"], k) for k, b in enumerate(bins) if capacity - b["used"] >= size and not (source and source in b["sources"]) and not (cluster and cluster in b["clusters"])]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append({"used": 0, "sources": set(), "clusters": set()})
        out.append((k, bins[k]["used"]))
        bins[k]["used"] += size
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


def test_best_fit_against_all_bins():
    rng = np.random.default_rng(8)
    for hot in (0.0, 0.4, 0.9):  # one source has none, many, most of the items
        sizes = sorted(rng.integers(0, 60, 300).tolist(), reverse=True)
        items = [(n, 1 if rng.random() < hot else 1 << int(rng.integers(0, 12)), 1 << int(rng.integers(0, 40)) if rng.random() < 0.5 else 0) for n in sizes]
        bins = packing.Bins(64)
        assert [bins.place(*x) for x in items] == brute_pack(items, 64)


def test_likeness_against_true_shares(spark):
    """Short texts: the fingerprint holds every span and every prefix, so likeness is the larger of the true Dice share and common prefix."""
    rng = np.random.default_rng(9)
    base = "abcabcabdabcabcabeabcaab"
    texts = ["", "a", base, base, base[:20] + "zz", "x" + base, *("".join(rng.choice(list("ab"), int(rng.integers(1, 32)))) for _ in range(30))]

    def want(a, b):
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        x, y = ({t[k : k + 16] for k in range(max(1, len(t) - 15))} for t in (a, b))
        same = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        return max(2 * len(x & y) / (len(x) + len(y)), 2 * same / (len(a) + len(b)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in prefix_hash.fingerprint_documents(df).collect():
        t, after = texts[r.doc_id], texts[r.doc_id - 1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert np.isclose(r.near_next, want(t, after)) and np.isclose(r.near_edited, want(t, edited)), (t, after)


def test_lm_score_against_its_formula(spark):
    """The sums over documents, classes and words in plain Python; the lattice has its own brute force above."""
    rng = np.random.default_rng(11)
    say = {"en": "the of and river light stone".split(), "de": "der und größe können stein".split(), None: "señor zzxqj the".split()}
    rows = [(i, " ".join(rng.choice(say[k], int(rng.integers(1, 9)))), k) for i in range(60) for k in [("en", "de", None)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    labels = ["de", "en"]
    counts = [Counter() for _ in range(3)]
    for i, t, k in rows:
        if not held(i):
            counts[labels.index(k) if k else 2].update([*words_of(t), b""])
    total = sum(counts, Counter())
    vocabulary = sorted({w for _, t, _ in rows for w in words_of(t)} | {b""})
    words = spark.createDataFrame([(bytearray(w), total[w]) for w in vocabulary], "word binary, c long")
    path = tokenizer_path(lattice_lm.VOCABULARY)
    lattice = lattice_lm.lattice_of(path, lattice_lm.piece_scores(words, path))
    free = {w: np.log(lattice_lm.END_SHARE) if w == b"" else float(lattice.forward([w])[0]) + np.log1p(-lattice_lm.END_SHARE) for w in vocabulary}
    once = lambda c: max(1, sum(v == 1 for v in c.values()))
    n, alpha = total.total(), once(total)
    p = {w: (total[w] + alpha * np.exp(free[w])) / (n + alpha) for w in vocabulary}
    share = np.array([c[b""] + 1.0 for c in counts])
    prior = share / share.sum()
    for r in lattice_lm.score_documents(df).collect():
        tokens = [*words_of(rows[r.doc_id][1]), b""]
        each = [np.log(prior[k]) + sum(np.log((c[w] + once(c) * p[w]) / (c.total() + once(c))) for w in tokens) for k, c in enumerate(counts)]
        assert np.isclose(r.score, np.logaddexp.reduce(each) / np.log(10)) and np.isclose(r.lattice_score, sum(free[w] for w in tokens) / np.log(10))


def test_network_against_plain_steps():
    """Every position by scalars, in both directions, and the mean over positions."""
    rng = np.random.default_rng(12)
    net = gru_langid.BiGru(["a", "b", "c"], hidden=3)
    net.p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in net.p.items()}
    net.shut()
    text = bytes(rng.integers(0, 256, gru_langid.STEPS + 9).tolist())
    sig = lambda v: 1 / (1 + np.exp(-v))
    rows = []
    for at in range(0, len(text), gru_langid.STEPS):
        piece, states = text[at : at + gru_langid.STEPS], {}
        for d, order in (("f", range(len(piece))), ("b", range(len(piece) - 1, -1, -1))):
            h = np.zeros(3)
            for t in order:
                x, u = net.p[f"x{d}"][:, piece[t]], net.p[f"u{d}"] @ h
                z, r = sig(x[:3] + u[:3]), sig(x[3:6] + u[3:6])
                cand = np.tanh(x[6:] + r * (u[6:] + net.p[f"c{d}"][:, 0]))
                h = states[d, t] = (1 - z) * cand + z * h
        for t in range(len(piece)):
            s = net.p["w"] @ np.concatenate((states["f", t], states["b", t])) + net.p["v"][:, 0]
            rows.append(np.exp(s) / np.exp(s).sum())
    assert np.allclose(net.documents([text, b"x"])[0], np.mean(rows, axis=0), atol=1e-5)


def test_every_label_is_learned(spark):
    """More labels than any fixed number of them, within the bound on windows; the least score follows their number."""
    rows = [(i, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 8, f"l{k:02d}") for i in range(400) for k in [i % 80]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {r["label"] for r in gru_langid.windows(df, "doc_id", "text", "lang", 800, 5, 0)}
    assert len(seen) == 80
    assert gru_langid.least_score(2) > 0.5 and 0.25 < gru_langid.least_score(4) < 0.5


def test_long_texts(spark):
    """A text of some MB beside short ones, through every operator."""
    rng = np.random.default_rng(13)
    long = " ".join(f"w{k}" for k in rng.integers(0, 50_000, 350_000))
    df = make(spark, [(1, long, "s"), (2, "the river", "s"), (3, long[:-9], "t"), (4, "y" * 300_000, "t")])
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert (got[1].component_id, got[3].component_id, got[4].component_id) == (1, 1, 4)
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    marks = {r.doc_id: r for r in prefix_hash.fingerprint_documents(df).collect()}
    assert marks[1].n_chars == len(long) and 0 <= marks[1].near_next <= 1
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    packed = packing.pack_documents(df).collect()
    assert {i: sum(r.n_tokens for r in packed if r.doc_id == i) for i in counts} == counts and counts[1] > 350_000
    ids = {r.doc_id: r.n_tokens for r in bpe_lexicon.encode_documents(df).collect()}
    files = {r.doc_id: r.n_tokens for r in token_files.token_files(df).collect()}
    assert {i: n + 1 for i, n in ids.items()} == files
    assert all(r.score < 0 for r in lattice_lm.score_documents(df).collect())
    assert {r.doc_id for r in gru_langid.identify(df).collect()} == {r.doc_id for r in licences.scan_licences(df).collect()} == {1, 2, 3, 4}


def test_many_files_in_order(spark, tmp_path, monkeypatch):
    """Rows of the writer hold whole records, files few rows; start follows the numbers in their names, also past five digits."""
    monkeypatch.setattr(token_files, "ROWS_PER_FILE", 1)
    df = make(spark, [(i, "the river " * (1 + i % 3), "s") for i in range(60)])
    index = token_files.token_files(df.repartition(3), f"file://{tmp_path}/many")
    rows = sorted(index.collect(), key=lambda r: r.doc_id)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    names = ["part-99999-a-c000.txt", "part-100000-a-c001.txt", "part-100000-a-c1000.txt", "part-100000-a-c999.txt"]
    fake = spark.createDataFrame([(n, 5, 0) for n in names], "file string, n_tokens long, start_in_file long")
    assert [r.file for r in token_files.with_starts(fake).orderBy("start").collect()] == [names[0], names[1], names[3], names[2]]
    some = token_files.read_indexed(spark, f"file://{tmp_path}/many", index.where("doc_id = 7"))
    assert [r.doc_id for r in some.collect()] == [7] and token_files.read_indexed(spark, f"file://{tmp_path}/many", index.where("doc_id < 0")).count() == 0


def test_packing(docs, empty):
    df, rows = docs
    got = packing.pack_documents(df, capacity=64, group=20).collect()
    sizes = Counter()
    bins = {}
    source = {i: s for i, _, s in rows}
    for r in got:
        sizes[r.doc_id] += r.n_tokens
        bins.setdefault((r.group, r.bin), []).append(r)
    want = Counter()
    for r in token_counts.count_tokens(df).collect():
        want[r.doc_id] += r.n_tokens
    assert sizes == want
    for own in bins.values():
        own.sort(key=lambda r: (r.start, r.n_tokens))
        assert all(a.start + a.n_tokens == b.start for a, b in zip(own, own[1:])) and own[-1].start + own[-1].n_tokens <= 64
        s = [source[r.doc_id] for r in own if source[r.doc_id] and r.doc_id != 5]  # 5 is in two sources
        assert len(s) == len(set(s))
    assert packing.pack_documents(empty).count() == 0
    b = packing.Bins(10)
    assert [b.place(*x) for x in ((6, 1, 1), (7, 2, 2), (3, 1, 4), (4, 2, 8), (3, 2, 16))] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]


def test_licences(spark, empty):
    mit = licences.KNOWN["MIT"]
    rows = [(1, mit.replace("MIT License", "MIT Licence").upper() + "\n", "a"), (2, mit.replace("\n", "\n  ").replace("MIT License\n", "MIT License\nCopyright (c) 2020 Someone\n", 1), "a"), (3, "released under THE mit licence", "a"), (4, mit + " and more", "a"), (5, None, None), (6, "", "b")]
    got = {r.doc_id: r.licence for r in licences.scan_licences(make(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT-declared", 4: None, 5: None, 6: None} and licences.scan_licences(empty).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    net = gru_langid.BiGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, target = rng.integers(97, 101, (6, 4)), np.array([0, 1, 2, 1])
    rows[4:, 1] = gru_langid.PAD
    g, _ = net.gradients(rows, target)
    for name in ("uf", "ub", "xf", "xb", "cf", "w", "v"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, h = net.p[name][at], 1e-2
        loss = []
        for x in (was + h, was - h):
            net.p[name][at] = x
            loss.append(net.gradients(rows, target)[1])
        net.p[name][at] = was
        assert abs((loss[0] - loss[1]) / (2 * h) - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at]), name


def test_language(spark, empty):
    rng = np.random.default_rng(1)
    say = {"en": "the of and that with this from".split(), "de": "der und die nicht mit über straße".split()}
    rows = [(i, " ".join(rng.choice(say[lang], int(rng.integers(6, 60)))), lang) for i in range(300) for lang in [("en", "de")[i % 2]]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 !!!", "de")]
    df = spark.createDataFrame([(i, t, lang, "s", 0, 1.5) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    got = {r.doc_id: r for r in gru_langid.identify(df).collect()}
    truth = {i: lang for i, _, lang in rows}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    held = [r for i, r in got.items() if r.held_out and i < 900]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in held)
    kept = gru_langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 300
    assert gru_langid.identify(empty).count() == 0
