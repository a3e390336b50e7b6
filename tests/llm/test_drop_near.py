"""Exactly one row of each component stays, also where ids are null or repeated."""

from itertools import combinations

from sonamark.llm import minhash
from sonamark.llm.common import words_of


def texts(word, n):
    """n near copies: 60 words, another last one for each."""
    base = [f"{word}{i}" for i in range(59)]
    return [" ".join([*base, f"end{k}"]) for k in range(n)]


def test_one_row_of_each_component(spark):
    a, b, c, d, e = (texts(w, 3) for w in "abcde")
    rows = [(None, t) for t in a] + [(7, b[0]), (7, b[1]), (7, b[1]), (None, b[2])] + [(9, c[0]), (9, d[0]), (12, d[1]), (None, e[0]), (None, e[0]), (3, e[1])] + [(None, None), (None, ""), (1, " "), (7, "")]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words_of(t) for _, t in rows)]
    part = list(range(len(rows)))
    for i, j in combinations(part[:], 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            part = [part[i] if p == part[j] else p for p in part]
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    want = sorted((str(least([r[0] for r, q in zip(rows, part) if q == p])), p) for p in set(part))
    place = {}
    for (i, t), p in zip(rows, part):
        place.setdefault((i, t), []).append(p)
    df = spark.createDataFrame([(x, t, "en") for x, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = minhash.drop_near(df)
    assert got.columns == df.columns
    out = sorted((str(r.doc_id), place[r.doc_id, r.text].pop()) for r in got.collect())
    assert out == want and len(out) == 9
