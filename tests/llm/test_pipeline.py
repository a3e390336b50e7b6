"""The pipeline and its stages against plain versions, on the smallest table and on rows with nulls, repeated ids, empty texts and clashing columns."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from sonamark.llm import gru_langid, packing, token_counts
from sonamark.llm.common import words_of, written

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf):
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        seen.append(docs)
    return seen


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def of_words(t):
    w = words_of(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_dedup(rows):
    """rows (id, text, ...) left by exact dedup (largest id), then near dedup (smallest id of a component): what each leaves."""
    groups = {}
    for r in rows:
        groups.setdefault(lowered(r[1]), []).append(r)
    exact = [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    sets, part = [of_words(r[1]) for r in exact], list(range(len(exact)))
    for i in range(len(exact)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                part = [part[i] if p == part[j] else p for p in part]
    best = {}
    for r, p in zip(exact, part):
        best[p] = min(best.get(p, r), r, key=lambda r: (r[0] is None, r[0] or 0))
    return exact, list(best.values())


def check_packing(docs, packed):
    """Every token is in a bin once, no bin is too full, no source or cluster twice in a bin."""
    rows = docs.collect()
    want = Counter()
    for r in token_counts.count_tokens(docs).collect():
        want[r.doc_id] += r.n_tokens
    got, bins = Counter(), {}
    for r in packed.collect():
        got[r.doc_id] += r.n_tokens
        bins.setdefault((r.group, r.bin), []).append(r)
    assert got == want and {r.doc_id for r in packed.collect()} == {r.doc_id for r in rows}
    source = {r.doc_id: r.source for r in rows}
    for own in bins.values():
        own.sort(key=lambda r: (r.start, r.n_tokens))
        assert own[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(own, own[1:])) and own[-1].start + own[-1].n_tokens <= packing.CAPACITY
        s = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert len(s) == len(set(s))


def test_run_and_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = stages(spark, docs, SF)
    assert all(out.columns == docs.columns for out in seen[:-1])
    rows = {r.doc_id: r.text for r in docs.collect()}
    score = {r.doc_id: r for r in gru_langid.identify(docs).collect()}
    known = {i for i, r in score.items() if r.lang_pred != "und" and r.score >= gru_langid.least_score(4)}
    first = {r.doc_id for r in seen[0].collect()}
    assert first == known and len(first) > 0.97 * len(rows)
    exact, near = plain_dedup([(i, rows[i]) for i in first])
    assert {r.doc_id for r in seen[1].collect()} == {r[0] for r in exact} and {r.doc_id for r in seen[2].collect()} == {r[0] for r in near}
    check_packing(seen[2], seen[3])
    final = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, final.collect())) == Counter(map(tuple, seen[3].collect()))


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated ids, copies in other case, near copies, clashing names."""
    base = [f"the river word{k}" for k in range(25)]
    near = [" ".join([*base[:-1], f"end{k}"]) for k in range(3)]
    rows = [(i, f"the light of nature and number {i} stands where the water was", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, f"der Fluss und das Licht nummer {i} stehen wo das Wasser war", "de", None) for i in range(60)]
    rows += [(200 + k, t, "en", "s0") for k, t in enumerate(near)] + [(300, near[0].upper(), "en", "s1"), (301, near[0], None, "s1")]
    rows += [(None, None, None, None), (None, "the light of nature has no id but has words", "en", "s1"), (5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2"), (400, "", "en", "s0"), (401, "  ", "en", "s0"), (402, "12 34", None, "s0")]
    df = spark.createDataFrame([(i, t, lang, s, 0 if t is None else len(t), 1, "x", True) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row long, lang_pred string, _null boolean")
    df.write.parquet(f"{tmp_path}/some/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    seen = stages(spark, docs, str(tmp_path))
    assert all(out.columns == docs.columns for out in seen[:-1])
    first = [tuple(r)[:2] for r in seen[0].collect()]
    assert len(first) == len(rows) - 4 and all(any(map(str.isalpha, t)) for _, t in first)
    exact, near = plain_dedup(first)
    assert Counter(tuple(r)[:2] for r in seen[1].collect()) == Counter(exact) or {lowered(r.text) for r in seen[1].collect()} == {lowered(r[1]) for r in exact}
    assert Counter(r.doc_id for r in seen[1].collect()) == Counter(r[0] for r in exact)
    assert Counter(r.doc_id for r in seen[2].collect()) == Counter(r[0] for r in near)
    check_packing(seen[2], seen[3])
    assert all(r.row == 1 and r.lang_pred == "x" and r._null for r in seen[2].collect())


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_clean_texts_stay(spark):
    """Held-out texts of the learned languages pass the least score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 60).select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    assert gru_langid.keep_identified(docs).where(held).count() >= 0.97 * docs.where(held).count()
