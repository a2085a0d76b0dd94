"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

ALPHABET = "abcé×zÉ"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows, noise=199, min_count=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def test_noise_counts_forms_and_roots(docs_of, edge_rows):
    from crosstide.llm import spelling as s

    rnd = random.Random(4)
    base = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(6, 9))) for _ in range(6)]
    texts = []
    for w in base:  # chains of edits, each a fifth as frequent as the last
        for n in (700, 120, 20, 5):
            texts += [w] * n
            k = rnd.randrange(len(w))
            w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(ALPHABET) + w[k:], w[:k] + rnd.choice(ALPHABET) + w[k + 1 :]])
    rnd.shuffle(texts)
    rows = [r[:2] for r in edge_rows] + [(i, " ".join(texts[i::40]).upper() if i % 7 == 0 else "-".join(texts[i::40])) for i in range(40)]
    rows = [(i, t.replace("É", "é") if t and i == 7 else t) for i, t in rows]
    docs = docs_of([(*r, None, None) for r in rows])
    for noise in (199, 3):
        got = s.spelling_variants(s.word_counts(s.noisy_runs(docs, noise=noise))).collect()
        want = brute_force(rows, noise)
        assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == want and len(got) == len(want)
    assert any(w[3] and w[5] != w[3] for w in want)
    assert s.spelling_variants(s.word_counts(s.noisy_runs(docs_of([])))).collect() == []


@pytest.mark.parametrize("letters,longest", [("ab", 8), ("aé÷", 7)])
def test_every_pair_is_found_once(spark, letters, longest):
    from crosstide.llm import spelling as s

    rnd = random.Random(longest)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(2, longest))) for _ in range(400)}
    counts = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = Counter(frozenset((r["x"], r["y"])) for r in s.near_words(counts).collect())
    assert set(got.values()) == {1}
    assert set(got) == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}


def test_long_chains_of_forms(spark):
    from crosstide.llm.spelling import follow_forms

    links = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(70)] + [("x", "w069"), ("y", "z")]
    got = dict(map(tuple, follow_forms(spark.createDataFrame(links, "word string, form string")).collect()))
    assert got == {**{a: "w070" for a, _ in links}, "y": "z"}


def test_query_on_a_table(spark):
    from crosstide.llm.spelling import op12_spelling_variants

    got = op12_spelling_variants(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()} == brute_force(rows)
