"""Mixing, packing and shards against plain loops; language and toxicity on held-out rows."""

import math
import random
from collections import Counter

import pytest

from canlake.llm import language, mixing, packing, sharding, toxicity
from canlake.llm.common import reach_workers
from canlake.llm.tokens import VOCABULARY, PieceEncoder

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "é", "x1"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 80, 400]))), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(50)]
    return out + [(50, None, "en", "b"), (51, "", "en", "d")]


def plain_targets(sizes, share=1.5, most=2.0, cycle=(5.0, 2.0, 1.0)):
    """Water filling by repetition: full sources leave, the rest share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    budget, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            budget -= target[s]
        open_ -= full
    return target


def test_mixing_equals_plain_loops(spark, rows):
    reach_workers(spark)
    found = mixing.mixed_rows(mixing.measured(spark.createDataFrame(rows, SCHEMA).repartition(3), "t")).collect()
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    target = plain_targets(sizes)
    for source in sizes:
        mine = sorted((r for r in found if r["source"] == source), key=lambda r: (r["size"], r["doc_id"]))
        assert [r["size"] for r in mine] == [size[r["doc_id"]] for r in mine]
        assert all(r["source_size"] == sizes[source] and math.isclose(r["target"], target[source], abs_tol=1e-6) for r in mine)
        # Copies are the whole numbers crossed by equal steps from one offset: any two sums differ by less than one.
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        sums = [sum(r["copies"] for r in mine[:i]) - rate * i for i in range(len(mine) + 1)]
        assert max(sums) - min(sums) < 1 + 1e-6
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - target[source]) <= max(r["size"] for r in mine) + 1e-6
        assert all(r["copies"] * r["size"] <= 2 * r["size"] for r in mine)


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 5.0, "c": 1.0}])
def test_packing_equals_a_sequential_round_robin(spark, rows, weights):
    reach_workers(spark)
    window, packet = 128, 40
    given = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight double")
    found = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), given, window, packet).collect()
    encode = PieceEncoder(VOCABULARY).tokenizer
    tokens = {r[0]: len(encode.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    queues = {}
    for doc, _, _, source in rows:
        queue = queues.setdefault(source, [])
        queue += [(doc, at, min(packet, tokens[doc] - at)) for at in range(0, tokens[doc], packet)]
    sizes = {s: float(sum(n for *_, n in q)) for s, q in queues.items()}
    share = {s: (weights or {}).get(s, 0) or sizes[s] for s in queues}
    quantum = {s: window * share[s] / sum(share.values()) for s in queues}
    order, deficit, served = [], dict.fromkeys(queues, 0.0), []
    while any(queues.values()):
        for source in sorted(queues, key=lambda s: (s is not None, s or "")):
            deficit[source] += quantum[source]  # what is not used is carried on
            while queues[source] and queues[source][0][2] <= deficit[source] + 1e-9:
                doc, at, n = queues[source].pop(0)
                deficit[source] -= n
                order += [(doc, at + j) for j in range(n)]
        served.append(len(order))
    got = {}
    for r in found:
        for j in range(r["length"]):
            got[r["sequence_id"] * window + r["offset"] + j] = (r["doc_id"], r["start"] + j)
    assert [got[i] for i in range(len(got))] == order
    if weights is None:  # all queues run together: every round serves about a window
        assert all(abs(b - a - window) <= 5 * packet for a, b in zip(served, served[1:-1]))


def test_shards_follow_the_curve(spark, rows):
    reach_workers(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    described = sharding.described(docs)
    celled, cells = sharding.with_cells(described, ["source"], ["size"], 4)
    cell = {r["doc_id"]: tuple(r[c] for c in cells) for r in celled.collect()}
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], set()).add(cell[r[0]][0])
    assert all(len(found) == 1 for found in by_source.values())  # one value, one cell
    ordered = sorted(by_source, key=lambda s: (s is not None, s or ""))
    places = [next(iter(by_source[s])) for s in ordered]
    assert places == sorted(places) and len(set(places)) == len(places)
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    pairs = sorted((size[d], c[1]) for d, c in cell.items())
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))


def test_language_and_toxicity_on_held_out_rows(spark):
    """Floors on rows that learning never saw; clean rows stay clean."""
    reach_workers(spark)
    rng = random.Random(3)
    stems = {"en": "the and with other house water light morning people".split(), "fr": "le et avec autre maison eau lumière matin gens".split(),
             "de": "der und mit andere haus wasser licht morgen leute".split()}
    rows, labels = [], []
    for i in range(900):
        lang = ("en", "fr", "de")[i % 3]
        words = [rng.choice(stems[lang]) for _ in range(50)]
        if i % 10 == 0:
            words[20:20] = rng.choice(["you are a st.u.p.i.d idiot", "what a worthless moron you are", "you pathetic 1d1ot"]).split()
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, int(i % 10 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    known = docs.where(~language.held_out(docs["doc_id"]))
    told = language.with_language(docs, language.trained(known), ("told", "share")).collect()
    held = {r["doc_id"] for r in docs.where(language.held_out(docs["doc_id"])).select("doc_id").collect()}
    assert len(held) > 150 and sum(r["told"] == r["lang"] for r in told if r["doc_id"] in held) >= 0.97 * len(held)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scores = {r["doc_id"]: r["s"] for r in toxicity.with_toxicity(docs, toxicity.trained(known, marks), "s").collect()}
    toxic = {i for i, t in labels if t and i in held}
    caught = {i for i in held if scores[i] >= toxicity.THRESHOLD}
    assert len(toxic) >= 15 and len(caught & toxic) >= 0.9 * len(toxic) and len(caught - toxic) <= 0.02 * len(held)
