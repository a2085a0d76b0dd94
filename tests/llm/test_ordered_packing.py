"""Packing in order against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")


def padding(length, limit):
    return 0 if length & (length - 1) == 0 else limit - length


def cheapest(places, costs, limit, per_sequence):
    best = {0: 0}
    for p, c in zip(places, costs):
        best[p] = min(best[s] + padding(p - s, limit) for s in best if p - s <= limit) + c + per_sequence
    return best[places[-1]]


def test_cuts_are_the_cheapest():
    from crosstide.llm.ordered_packing import plan_cuts

    rnd = random.Random(8)
    for _ in range(400):
        limit = rnd.choice([8, 12, 16, 64])
        places = np.cumsum([rnd.randint(1, rnd.choice([2, limit])) for _ in range(rnd.randint(1, 40))])
        costs = np.array([rnd.choice([0, 0, 3, 9]) for _ in places])
        each = rnd.choice([0, 1, 5])
        cuts, cost = plan_cuts(places, costs, limit, each)
        assert cost == cheapest(places.tolist(), costs.tolist(), limit, each)
        at, again = 0, 0
        for i in cuts:
            assert 0 < places[i] - at <= limit
            again += padding(int(places[i] - at), limit) + int(costs[i]) + each
            at = places[i]
        assert at == places[-1] and again == cost


def test_places_of_a_document():
    from crosstide.llm.ordered_packing import cut_places

    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(1, 200)
        ends = np.array(sorted(rnd.sample(range(0, n + 1), min(n, rnd.randint(0, 5)))), np.int64)
        places, costs = cut_places(n, ends, 16, 5, 50)
        got = dict(zip(places.tolist(), costs.tolist()))
        assert len(got) == len(places) and sorted(got) == places.tolist() and got[n] == 0
        assert {p for p, c in got.items() if c == 5} == set(ends.tolist()) - {0, n}
        assert max(np.diff([0, *places])) <= 16


def test_sentences_end_after_stops():
    from tokenizers import Tokenizer

    from crosstide.llm.ordered_packing import SentenceEnds

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ends = SentenceEnds(t.get_vocab())
    ids = lambda x: np.array(t.encode(x, add_special_tokens=False).ids, np.int64)
    parts = ["It costs 3.50, he said.", "Really?!", "Yes, v1.2 does! (", "No.)", "No stop here"]
    want = np.cumsum([len(ids(p)) for p in parts])[:-1].tolist()
    got = ends(ids(" ".join(parts))).tolist()
    assert [g for g in got if g in want] == [want[0], want[1], want[3]] and len(got) <= 4
    assert ends(ids("")).tolist() == [] and ends(ids("one.")).tolist() == []


def check(rows, docs, limit):
    """rows: result; docs: (id, text). Padding, tokens and cuts inside documents."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, n), pieces in by_doc.items():
        copies = sum(c for (a, m, _), c in want.items() if (a, m) == (i, n))
        cover = Counter(x for s, l in pieces for x in (range(s, s + l)))
        assert cover == {x: copies for x in range(n)}
    assert set(by_doc) == {(i, n) for i, n, _ in want}
    ids_of = defaultdict(list)
    for i, text in docs:
        ids_of[i].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in rows:
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in ids_of[r["doc_id"]])
    pads = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= limit
        pads += padding(at, limit)
    return pads, sum(r["length"] for r in rows), len(rows) - sum(want.values())


@pytest.mark.parametrize("limit,stretch", [(64, 700), (2048, 1 << 19)])
def test_every_id_lies_in_one_piece(docs_of, edge_rows, limit, stretch):
    from crosstide.llm.ordered_packing import pack_in_order

    rows = edge_rows + [(500 + i, f"Ünïcode İstanbul <|endoftext|> it's 1,234.5 number {i}. A second one! " * i, None, None) for i in range(30)]
    got = pack_in_order(docs_of(rows), P.path("word_bpe_49k.json"), limit=limit, stretch=stretch).collect()
    check(got, [r[:2] for r in rows], limit)
    assert pack_in_order(docs_of([]), P.path("word_bpe_49k.json")).collect() == []


def test_little_padding_few_cuts(spark):
    from crosstide.llm.ordered_packing import op13_ordered_packing

    got = op13_ordered_packing(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {t for _, t in got.dtypes[1:]} == {"bigint"}
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    pads, tokens, cuts = check(got.collect(), docs, 2048)
    print(pads, tokens, cuts)
    assert pads < 0.01 * tokens and cuts < 1.1 * tokens / 2048
