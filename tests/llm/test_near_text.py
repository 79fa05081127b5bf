"""Operators 1 and 10: against brute force and planted cases."""

import random
import re

import pyarrow as pa
import numpy as np

from ferrule.llm import blocks, common as C
from ferrule.llm import op1_ngram_join as join
from ferrule.llm import op10_substring_dedup as sub
from ferrule.llm.components import components
from tests.llm.conftest import words


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows, t=0.8):
    rows = [(i, x) for i, x in rows if i is not None]
    sets = {k: shingle_set(x) for k, (_, x) in enumerate(rows)}
    n, ids = len(rows), [i for i, _ in rows]
    near = {k: [] for k in range(n)}
    for a in range(n):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if u and len(sets[a] & sets[b]) / u >= t:
                near[a].append(b)
                near[b].append(a)
    label = list(ids)
    for _ in range(n):
        new = [min([label[k], *(label[j] for j in near[k])]) for k in range(n)]
        if new == label:
            break
        label = new
    return {ids[k]: (len(near[k]), label[k]) for k in range(n)}


def family(seed, n, size=120, edits=2):
    rng = random.Random(seed)
    base = words(seed, size)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(spark, make_docs):
    texts = [x for s in range(6) for x in family(s, 6 + s, edits=1 + s)] + [" ".join(words(90 + k, 60)) for k in range(20)]
    texts += ["a b", "a b", "a  b\n", "a b c", "", None, " \n\t", "", "one two three four five", texts[0], texts[0] + "\n"]
    random.Random(1).shuffle(texts)
    rows = [(7 * k + 1, x) for k, x in enumerate(texts)]
    want = brute_join(rows)
    got = join.join(make_docs(rows + [(None, texts[0]), (None, None)])).collect()
    assert len(got) == len(rows) + 2
    copies = {}
    for i, x in rows:
        copies.setdefault(x, []).append(i)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["n_links"] == 0
            continue
        n, comp = want[r["doc_id"]]
        assert (r["n_links"], r["component_id"], r["kept"]) == (n, comp, comp == r["doc_id"]), r
        same = copies[dict(rows)[r["doc_id"]]]
        if shingle_set(dict(rows)[r["doc_id"]]):
            assert (r["class_id"], r["class_size"]) == (min(same), len(same))


def test_join_large_family_is_split_and_whole(spark, make_docs, monkeypatch):
    monkeypatch.setattr(join, "FAMILY_BLOCK", 12)
    monkeypatch.setattr(join, "NODE_BLOCK", 16)
    rows = list(enumerate(family(5, 70, size=200, edits=3)))
    want = brute_join(rows)
    got = join.join(make_docs(rows)).collect()
    assert {r["doc_id"]: (r["n_links"], r["component_id"]) for r in got} == want


def test_forest_depth_reaches_recall():
    d = join.shortened()
    assert 1 - (1 - join.THRESHOLD**d) ** join.TREES >= join.RECALL > 1 - (1 - join.THRESHOLD ** (d + 1)) ** join.TREES


def test_empty_tables(no_docs):
    assert join.join(no_docs).count() == 0
    spans = sub.repeats(no_docs)
    assert spans.count() == 0 and sub.cleaned(no_docs, spans).count() == 0


def test_components_of_long_path_and_star(spark):
    rng = random.Random(0)
    path = list(range(1000, 1200))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(5, k) for k in range(6, 60)] + [(3, 3), (None, 4), (9, 8)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1000 for k in path[1:] if k != 1000) and all(got[k] == 5 for k in range(6, 60)) and 3 not in got


def test_roots():
    got = blocks.roots(8, np.array([7, 5, 2]), np.array([5, 3, 1]))
    assert got.tolist() == [0, 1, 1, 3, 4, 3, 6, 3]


def passages(rows, n=51):
    seen = {}
    for i, x in rows:
        w = (x or "").split()
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {p: d for p, d in seen.items() if len(d) > 1}


def planted():
    p, q = " ".join(words(500, 55)), " ".join(words(501, 90))
    near = " ".join(w if k != 40 else "other" for k, w in enumerate(words(501, 90)))
    rows = [(10 + k, " ".join(words(600 + k, 150))) for k in range(12)]
    glue = lambda k, text: (rows[k][0], "é " + rows[k][1][:300] + " " + text + " " + rows[k][1][300:])
    for k, text in ((1, p), (4, p), (7, p), (2, q), (5, near), (8, q + "\n" + p)):
        rows[k] = glue(k, text)
    rows += [(40, rows[0][1]), (41, "short text"), (42, "short text"), (43, None), (44, ""), (45, "de " * 300), (46, "de " * 300), (10, rows[0][1])]
    return rows


def test_passages_are_found_and_removed(spark, make_docs):
    rows = planted()
    docs = make_docs(rows + [(None, rows[1][1])])
    spans = sub.repeats(docs).collect()
    by_doc = {}
    for r in spans:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert {11, 14, 17, 12, 15, 18, 40, 10, 45, 46} == set(by_doc)
    assert all(not r["removed"] for i in (10, 11, 12) for r in by_doc[i])
    assert all(r["removed"] and min(r["keepers"]) < i for i in (14, 17, 15, 18, 40) for r in by_doc[i])
    out = sub.cleaned(docs, sub.repeats(docs)).collect()
    assert len(out) == len(rows) + 1
    left = [(r["doc_id"], r["text"]) for r in out if r["doc_id"] is not None]
    assert passages(rows) and not passages(left)
    for i, text in rows:
        if i not in by_doc or not any(r["removed"] for r in by_doc[i]):
            assert (i, text) in left
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None and r["doc_id"] is not None)
    assert [r["text"] for r in out if r["doc_id"] is None] == [rows[1][1]]
    assert set(docs.columns) == set(out[0].asDict())


def jaccard(a, b):
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    return len(x & y) / len(x | y)


def test_near_passages_go_in_full_wherever_they_are_edited(spark, make_docs):
    rng = random.Random(3)
    rows, want = [], []
    for n in (44, 60, 75, 90, 105, 120):
        for kind in ("change", "insert", "delete"):
            for at in (3, n // 4, n // 2, 3 * n // 4, n - 4):
                for more in (0, 1):
                    base = words(rng.random(), n)
                    edited = list(base)
                    places = {at, (at + n // 2) % n} if more else {at}
                    for k in sorted(places, reverse=True):
                        edited[k : k + (kind != "insert")] = [] if kind == "delete" else ["new"]
                    if jaccard(base, edited) < 0.8:
                        continue
                    k = len(rows)
                    rest = [words(rng.random(), 40) for _ in range(4)]
                    rows += [(k, " ".join(rest[0] + base + rest[1])), (k + 1, " ".join(rest[2]) + "\n\n" + " ".join(rest[3][:20] + edited).replace(" ", "  ", k % 3 * 40) + " " + " ".join(rest[3][20:]))]
                    want.append((k + 1, set(edited), rest[2] + rest[3], min(min(x, n - 1 - x) for x in places)))
    docs = make_docs(rows)
    left = {r["doc_id"]: r["text"].split() for r in sub.cleaned(docs, sub.repeats(docs)).collect()}
    assert len(want) > 80
    for k, text in rows[::2]:
        assert left[k] == text.split()
    for k, passage, rest, edge in want:
        # an edit within four words of the edge leaves no shingle beyond it
        assert len([w for w in left[k] if w in passage - set(rest)]) <= (0 if edge > 4 else 5), k
        # a similar paragraph of 25 words may reach two words beyond the passage
        assert len([w for w in left[k] if w not in passage]) >= len([w for w in rest if w not in passage]) - 4, k


def test_short_similar_paragraphs_go(spark, make_docs):
    """25 pairs of each length, of Jaccard similarity 0.8 and more."""
    rng = random.Random(8)
    rows, want = [], []
    for n in (25, 26, 27, 30, 44, 120):
        made = 0
        while made < 25:
            base = words(rng.random(), n)
            edited = list(base)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(edited))
                edited[k : k + 1] = rng.choice([["new"], [], ["new", edited[k]]])
            if edited == base or len(edited) < 25 or jaccard(base, edited) < 0.8:
                continue
            made += 1
            k = len(rows)
            rest = [words(rng.random(), 30) for _ in range(4)]
            rows += [(k, " ".join(rest[0] + base + rest[1])), (k + 1, " ".join(rest[2] + edited + rest[3]))]
            want.append((n, k + 1, set(edited) - set(rest[2] + rest[3]), rest[2] + rest[3]))
    docs = make_docs(rows)
    left = {r["doc_id"]: r["text"].split() for r in sub.cleaned(docs, sub.repeats(docs)).collect()}
    assert all(left[k] == text.split() for k, text in rows[::2])
    for n in (25, 26, 27, 30, 44, 120):
        gone = [1 - len(set(left[k]) & mine) / len(mine) for m, k, mine, _ in want if m == n]
        assert sum(g > 0.75 for g in gone) >= 0.9 * len(gone), (n, gone)
    assert all(len(set(rest) - set(left[k])) <= 4 for _, k, _, rest in want)


def test_equal_words_of_short_texts_stay(spark, make_docs):
    p = words(31, 24)
    rows = [(0, " ".join(p)), (1, " ".join(p)), (2, " ".join(words(32, 40) + p[:22] + words(33, 40))), (3, " ".join(words(34, 40) + p[:22] + words(35, 40)))]
    docs = make_docs(rows)
    assert sub.repeats(docs).count() == 0


def test_least_words():
    n = sub.least_words()
    same = lambda m: (m - 4) / (2 * (sub.WORDS - 4) - (m - 4))
    assert same(n) >= sub.THRESHOLD > same(n - 1)


def test_stretches_of_several_words_go_whole(spark, make_docs):
    rows, want = [], {}
    for period in (1, 2, 3, 7, 12, 13, 24):
        turn = words(3000 + period, period)
        round_ = lambda a, n: [turn[(a + k) % period] for k in range(n)]
        lone = [words(4000 + 10 * period + k, 30) for k in range(9)]
        k = 10 * period
        rows += [(k, lone[0] + round_(0, 400) + lone[1]), (k + 1, lone[2] + round_(1, 900) + lone[3]), (k + 2, round_(2, 51)),
                 (k + 3, lone[4] + round_(3, 20) + lone[5]), (k + 4, lone[6] + lone[8] + round_(4, 300) + lone[7])]
        want |= {k: rows[-5][1], k + 1: lone[2] + lone[3], k + 2: [], k + 3: rows[-2][1], k + 4: lone[6] + lone[8] + lone[7]}
    docs = make_docs([(k, " ".join(x)) for k, x in rows])
    spans = C.written(sub.repeats(docs), "test-spans")
    left = {r["doc_id"]: r["text"].split() for r in sub.cleaned(docs, spans).collect()}
    assert not passages([(k, " ".join(x)) for k, x in left.items()])
    # a similar paragraph of 25 words may reach two words beyond a stretch on each side
    assert all(not set(left[k]) - set(x) and len(left[k]) >= len(x) - 4 for k, x in want.items())
    assert all(left[k] == x for k, x in want.items() if k % 10 in (0, 2, 3))
    assert spans.count() <= 4 * 7


def test_periodic_equals_plain_search():
    rng = random.Random(2)
    for _ in range(60):
        rows = [[rng.randrange(2 if rng.random() < 0.3 else 1000) for _ in range(rng.randrange(90))] for _ in range(3)]
        for r in rows:
            p, k = rng.randint(1, 24), rng.randrange(len(r) + 1)
            r[k:k] = (r[:p] or [1]) * rng.randint(1, 30)
        w, first = np.array(sum(rows, []), np.uint64), np.cumsum([0, *map(len, rows)])
        got = sorted(zip(*(x.tolist() for x in sub.periodic(w, first))))
        plain: list = []
        for p in range(1, sub.WORDS):
            for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                a = x
                while a < y:
                    z = a + p
                    while z < y and w[z] == w[z - p]:
                        z += 1
                    if z <= y and z - a >= max(sub.WORDS, 2 * p):
                        if not any(i <= a and z <= j and q < p for i, j, q in plain):
                            plain.append((a, z, p))
                    a = max(a + 1, z - p + 1)
        assert got == sorted(plain)


def test_stretches_of_one_word_go_whole(spark, make_docs):
    lone = [" ".join(words(700 + k, 30)) for k in range(8)]
    rows = [(0, "de " * 300), (1, "de " * 300), (2, lone[0] + " é" + " de" * 60 + " " + lone[1]), (3, lone[2] + " de" * 24 + " " + lone[3]),
            (4, lone[4] + " -" * 80), (5, "- " * 26 + lone[5]), (6, lone[6] + " =" * 90), (7, " ".join(["a"] * 40 + lone[7].split() + ["a"] * 40))]
    docs = make_docs(rows)
    spans = sub.repeats(docs)
    left = {r["doc_id"]: r["text"] for r in sub.cleaned(docs, spans).collect()}
    assert not passages(list(left.items()))
    assert left[1].split() == [] and left[2].split() == lone[0].split() + ["é"] + lone[1].split() and left[5].split() == lone[5].split()
    assert all(left[k] == dict(rows)[k] for k in (0, 3, 4, 6, 7))


def test_paragraphs_do_not_depend_on_neighbours():
    p = " ".join(words(77, 51))
    one = sub.paragraphs(next(C.chunks(pa.array([p]))), 2)
    for k in range(5):
        text = " ".join(words(800 + k, 40)) + " " + p + " " + " ".join(words(900 + k, 40))
        got = sub.paragraphs(next(C.chunks(pa.array(["x", text, "é " + text]))), 2)
        assert {h for r, h in zip(got["row"], got["hash"]) if r == 1} & set(one["hash"].tolist())
        for r, a, b in zip(got["row"], got["start"], got["stop"]):
            part = ["x", text, "é " + text][r][a:b]
            assert len(part.split()) == sub.WORDS and part == part.strip()


def test_prefilter_keeps_every_row(spark, make_docs):
    docs = make_docs([(k if k % 5 else None, str(k)) for k in range(200)])
    ids = docs.filter("doc_id % 3 = 0").select("doc_id")
    some, rest = C.prefilter(docs, "doc_id", ids, bits=64)
    assert some.count() + rest.count() == 200
    assert not rest.filter("doc_id % 3 = 0").count()
