"""BPE, packing, language ID, toxicity, near duplicates and chat formatting against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_byte_bpe(docs_of, edge_rows):
    import tiktoken

    from crosstide.llm import bpe

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.SegmentTreeBpe(ranks, P.PATTERN)
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(" \n\t ab'sllZ9é漢🎉\x1c 　.!") for _ in range(rnd.randint(0, 30)))
        assert own.encode(text) == ref.encode_ordinary(text)
        assert own.decode_bytes(own.encode(text)).decode() == text
    long = "abc" * 20_000
    assert own.encode(long) == ref.encode_ordinary(long)
    got = bpe.bpe_ids(docs_of(edge_rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = Counter()
    for i, t, *_ in edge_rows:
        ids = ref.encode_ordinary(t or "")
        want[(i, tuple(ids), len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert bpe.bpe_ids(docs_of([]), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


def test_byte_bpe_many_texts():
    """Pieces of many texts merged together equal the library and the single trees, also where the caches overflow."""
    import tiktoken

    from crosstide.llm import bpe

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, single = (bpe.SegmentTreeBpe(ranks, P.PATTERN) for _ in range(2))
    rnd = random.Random(3)
    letters = "etaoinshrdlu" * 4 + "EZé漢🎉ß'7.-"
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 20, 40, 70])))
    gap = lambda: rnd.choice([" ", " ", " ", " ", "\n", "   ", " \n ", "\t "])
    texts = ["", " ", "   "] + ["".join(word() + gap() for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    want = [ref.encode_ordinary(t) for t in texts]
    assert [ids for _, ids in own.encode_many(texts)] == want
    assert [joined for joined, _ in own.encode_many(texts)] == [" ".join(map(str, ids)) for ids in want]
    for size in (2, 4, 8, 16, 32, 64):
        pieces = ["".join(rnd.choice(letters[:50]) for _ in range(rnd.randint(2, size))).encode() for _ in range(200)]
        pieces = [p for p in pieces if 2 <= len(p) <= size and p not in ranks] + [b"ab" * (size // 2)]
        assert own.trees.encode(pieces, size) == [ref._encode_single_piece(p) for p in pieces]
    no_bytes = bpe.SegmentTreeBpe({b"a": 0, b"b": 1, b"ab": 2}, P.PATTERN)
    assert no_bytes.trees is None and [ids for _, ids in no_bytes.encode_many(["abba ".strip()])] == [[2, 1, 0]]


def test_byte_bpe_forgets(monkeypatch):
    from crosstide.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "GATHER", 400)
    own = bpe.SegmentTreeBpe(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("qxzvk") for _ in range(6)) for _ in range(60)) for _ in range(60)]
    assert [ids for _, ids in own.encode_many(texts)] == [own.encode(t) for t in texts]
    assert len(own.chunks) <= 400 and len(own.chunks.older) <= 400


def fewest_bins(items, limit):
    """Brute force over all ways to put items into bins."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= limit:
                place(k + 1, bins[:i] + [bins[i] + items[k]] + bins[i + 1 :])
        place(k + 1, bins + [items[k]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    from crosstide.llm.packing import plan_bins, reduce_dominated

    rnd = random.Random(5)
    for _ in range(400):
        limit = rnd.choice([10, 17, 30])
        items = sorted((rnd.randint(rnd.choice([1, 3]), limit) for _ in range(rnd.randint(1, 8))), reverse=True)
        fixed, left = reduce_dominated(Counter(items), limit)
        used = Counter()
        for held, times in fixed:
            assert sum(held) <= limit and len(held) <= 3
            used.update({l: n * times for l, n in Counter(held).items()})
        assert used + Counter(left) == Counter(items)
        rest = list(Counter(left).elements())
        assert sum(t for _, t in fixed) + (fewest_bins(rest, limit) if rest else 0) == fewest_bins(items, limit)
        packed = Counter()
        for held, times in plan_bins(Counter(items), limit):
            assert sum(held) <= limit
            packed.update({l: n * times for l, n in Counter(held).items()})
        assert packed == Counter(items)
    assert plan_bins({}) == []
    assert sum(t for _, t in plan_bins({1: 10**9, 4096: 10**9, 2048: 3}, 4096)) == 10**9 + -(-(10**9 + 3 * 2048) // 4096)


def check_packing(rows, docs, limit=4096):
    """rows: result of pack; docs: (id, text)."""
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), limit)):
            part = ids[s : s + limit]
            want[(i, p, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    return len(places), sum(r["length"] for r in rows)


def test_packing(docs_of, edge_rows):
    from crosstide.llm.packing import pack

    rows = edge_rows + [(500 + i, "Ünïcode İstanbul Σίσυφος <|endoftext|> it's 1,234.5 \x1d é", None, None) for i in range(3)]
    got = pack(docs_of(rows), P.path("word_bpe_49k.json")).collect()
    bins, tokens = check_packing(got, [r[:2] for r in rows])
    assert bins == -(-tokens // 4096)
    assert pack(docs_of([]), P.path("word_bpe_49k.json")).collect() == []


def test_language_id(spark, docs_of, edge_rows):
    from pyspark.sql import functions as F

    from crosstide.llm import langid

    p = langid.Profiles(256)
    grams, counts = p.counts("Ab,  ab!")
    plain = Counter(zip("\0ab\0ab\0", "ab\0ab\0", "b\0ab\0"))
    assert {tuple(chr(g >> 42 & 0x1FFFFF) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)): c for g, c in zip(grams.tolist(), counts.tolist())} == plain
    total = sum(c * np.roll(p._letter(ord(a)), 2) * np.roll(p._letter(ord(b)), 1) * p._letter(ord(x)) for (a, b, x), c in plain.items())
    assert (p.bundle(grams, counts) == total).all()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert held["n"] > 150 and held["right"] > 0.95
    edges = docs_of(edge_rows)
    out = langid.identify_languages(edges, langid.language_prototypes(edges)).select("row.text", "lang_pred", "score").collect()
    assert len(out) == len(edge_rows)
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in langid.identify_languages(edges, {}).select("lang_pred").collect()} == {"und"}
    assert langid.language_prototypes(docs_of([])) == {}


def test_toxicity(spark, docs_of, edge_rows):
    from crosstide.llm import toxicity as t

    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice("the river stone quiet garden light harbour winter copper cloud".split()) for _ in range(n))
    rows, labels = list(edge_rows), [(None, 1), (3, None), (4, 0)]
    for i in range(1000, 1400):
        bad = i % 5 == 0
        rows.append((i, f"{say(rnd.randint(3, 80))} {rnd.choice(['vilefolk', 'vileness', 'grubby']) if bad else ''} {say(4)}", "en", None))
        if i % 2 == 0:
            labels += [(i, int(bad))] * 2
    docs = docs_of(rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.fit_toxicity(docs, lab)
    got = {r["doc_id"]: r for r in t.score_toxicity(docs, model).collect()}
    wrong = [i for i in range(1000, 1400) if got[i]["predicted"] != int(i % 5 == 0)]
    assert len(wrong) <= 8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert t.score_toxicity(docs, model).count() == len(rows)
    none = t.fit_toxicity(docs, lab.limit(0))
    assert {r["predicted"] for r in t.score_toxicity(docs, none).collect()} == {0}
    assert t.score_toxicity(docs_of([]), model).collect() == []


def test_toxicity_held_out(spark):
    from crosstide.llm import toxicity as t

    got = {r["doc_id"]: r for r in t.op3_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels if r["toxic"] is not None and got[r["doc_id"]]["held_out"]]
    caught = [p for y, p in held if y == 1]
    false = [p for y, p in held if y == 0]
    assert len(caught) > 20 and np.mean(caught) > 0.85 and np.mean(false) < 0.01


def set_of(text, words):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    n = min(words, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_components(rows, words, percent):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets[i], parent[i] = set_of(t, words), i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs_of, edge_rows, words, percent):
    from crosstide.llm.minhash import drop_near_duplicates, near_duplicates

    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = list(edge_rows)
    for k, n in enumerate((30, 60, 150)):
        base = [rnd.choice(vocabulary) for _ in range(n)]
        for j in range(70):  # edits from none to far past the threshold, some at the same places: chains and lone links
            t = list(base)
            for _ in range(rnd.randint(0, 8)):
                t[rnd.randrange(n)] = rnd.choice(vocabulary[:6])
            rows.append((1000 + 100 * k + j, " ".join(t[: n - rnd.choice([0, 0, 0, rnd.randrange(n // 2)])]), "en", None))
    docs = docs_of(rows)
    want = brute_components([r[:2] for r in rows], words, percent)
    got = near_duplicates(docs, words=words, percent=percent, block=16).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    left = drop_near_duplicates(docs, words=words, percent=percent).collect()
    assert Counter(r["doc_id"] for r in left) == Counter(i for i, *_ in rows if i is None or want[i][1] == i)
    assert near_duplicates(docs_of([])).collect() == []


def test_texts_of_one_id_are_one_vertex(docs_of):
    from crosstide.llm.minhash import near_duplicates

    a, b, c = "one two three four five six", "the river runs to the sea at night", "quite another text than those two"
    docs = docs_of([(5, a, None, None), (6, b, None, None), (7, a, None, None), (7, b, None, None), (8, c, None, None), (8, c, None, None)])
    assert Counter((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()) == {(5, 5): 1, (6, 5): 1, (7, 5): 2, (8, 8): 2}


def test_bands_hold_the_promised_miss():
    from crosstide.llm.minhash import CirculantMinHash, bands_for

    for t in (0.8, 0.85, 0.95):
        assert (1 - t**5) ** bands_for(t) <= 1e-6 < (1 - t**5) ** (bands_for(t) - 1)
    rnd = np.random.default_rng(0)
    pool = rnd.integers(0, 2**63, 3000, np.uint64)
    m = CirculantMinHash(40, 5)
    a, b = m.signature(pool[:2000]), m.signature(pool[1000:])
    assert abs((a == b).mean() - 1 / 3) < 0.12


def test_components(spark):
    from crosstide.llm.components import connected_components

    links = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 230)] + [(300, 300), (None, 4), (9, 3), (9, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in range(200, 230)}}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_viterbi_is_the_best_path():
    from crosstide.llm import chat

    rnd = np.random.default_rng(3)
    draw = lambda *s: np.log(rnd.dirichlet(np.ones(s[-1]), s[:-1] or None))
    model = chat.RoleModel(draw(chat.STATES), draw(chat.STATES, chat.STATES), draw(chat.STATES, 4))
    for _ in range(20):
        obs = rnd.integers(0, 4, 5)

        def score(path, start):
            s = start[path[0]] + model.emit[path[0], obs[0]]
            return s + sum(model.move[a, b] + model.emit[b, o] for a, b, o in zip(path, path[1:], obs[1:]))

        paths = list(itertools.product(range(chat.STATES), repeat=5))
        best = max(paths, key=lambda p: score(p, model.start))
        assert tuple(model.viterbi(obs, -1, -1)) == best
        table = model.transfer(obs)
        assert np.isclose(table[-1].max(), score(best, model.start))
        assert np.isclose(table[2, 4], max(score(p, model.move[2]) for p in paths if p[-1] == 4))


def test_chat_format(spark):
    from crosstide.llm import chat

    turns = [(c, t, r, f"{r} says {'a long explanation ' * 12 if r == 'assistant' else 'hello?'}\nmore {t}") for c in range(30) for t, r in enumerate(["system", *["user", "assistant"] * 40])]
    turns += [(99, 0, None, None), (99, 1, "user", ""), (None, 0, "user", "who?"), (98, None, "user", "hi\n\nthere")] + [(97, 0, "user", "same")] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    raw = chat.as_transcript(df)
    lines = chat.transcript_lines(raw, role_col="role")
    model = chat.fit_roles(lines)
    states = chat.recover_roles(lines, model).collect()
    assert len(states) == lines.count()
    by_conv = defaultdict(list)
    for r in lines.collect():
        by_conv[r["conv"]].append((r["turn"], r["rh"], r["pos"], r["obs"]))
    found = defaultdict(list)
    for r in states:
        found[r["conv"]].append((r["turn"], r["rh"], r["pos"], r["found"]))
    for c in (0, 7, 98, None):  # 81 turns span two blocks: blockwise decoding is the plain one
        obs = np.array([o for *_, o in sorted(by_conv[c])])
        assert [s for *_, s in sorted(found[c])] == model.viterbi(obs, -1, -1).tolist()
    got = chat.render_turns(chat.transcript_lines(raw), chat.recover_roles(lines, model)).collect()
    right = {(r["conv"], r["turn_no"], r["role"], r["text"]) for r in got}
    assert np.mean([(c, t, r, x) in right for c, t, r, x in turns[:2430]]) > 0.9
    assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}\n<|end|>\n" for r in got)
    none = df.limit(0)
    assert chat.render_turns(chat.transcript_lines(none), chat.recover_roles(chat.transcript_lines(none), model)).collect() == []
