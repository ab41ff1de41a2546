"""Inputs that once gave wrong results: colliding words, long obfuscated words, clashing columns, outliers, chains."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canlake.llm import common, sharding, tokens, toxicity, url_filter
from canlake.llm import kernels as K
from canlake.llm.common import components, running_total
from canlake.llm.tokens import VOCABULARY, PieceEncoder


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


def test_words_of_a_regular_build_get_their_own_ids():
    texts = [thue_morse(1024), thue_morse(1024, 1), thue_morse(2048), thue_morse(2048, 1)]
    encoder, library = PieceEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    data, offsets = K.text_buffers(pa.array(texts))
    ids, at = encoder.encode(data, offsets)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(set(K.word_hashes(data, offsets)[0].tolist())) == 4


def test_word_hashes_do_not_depend_on_place_or_block():
    text = b"One two ONE " + b"x" * 70_000 + b" two one"
    data = np.frombuffer(text, np.uint8)
    h, _ = K.word_hashes(data, np.array([0, len(text)]))
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3
    alone = np.frombuffer(b"two", np.uint8)
    assert K.word_hashes(alone, np.array([0, 3]))[0][0] == h[1]


def test_ids_beyond_the_stored_type_are_refused(docs_frame):
    with pytest.raises(ValueError, match="do not fit"):
        tokens.tokenised(docs_frame([(1, "a", "en", "s")]), ["doc_id"], 70_000)


@pytest.mark.parametrize("dots", [0, 9, 10, 1000, 300_000])
def test_obfuscated_words_of_every_length_are_undone(dots):
    lexicon = toxicity.Lexicon(toxicity.Terms(np.zeros(0, np.uint64)), {})
    word = "i" + "." * dots + ".d.1" + "-" * dots + "-o.t"
    texts = [f"he is an {word} now", "he is an i.n.n.o.c.e.n.t now"]
    found = lexicon.features(*K.text_buffers(pa.array(texts)))
    place = toxicity.FEATURES.index("undone_hits")
    assert found[0, place] > 0 and found[1, place] == 0


CLASHING = "_row long, _size long, _key long, _language string, _share double, _toxicity double, row_key long, run long, size long, source_key string, shard int, slot long, copy int, score double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
VALUES = (77, 78, 79, "klingon", 0.25, 0.5, 80, 81, 82, "sk", 83, 84, 85, 0.75)


@pytest.fixture(scope="module")
def docs_frame(spark):
    common.reach_workers(spark)
    return lambda rows: spark.createDataFrame([(*row, len(row[1] or ""), *VALUES) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(docs_frame, spark, tmp_path_factory):
    """A small folder of tables: two languages, toxic rows, copies, and columns named like helpers."""
    rng = random.Random(4)
    english, french = "the cat sat on a mat and then it ran home with some of the others".split(), "le chat dort sur la table et puis il va dans une autre maison".split()
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(english if i % 2 else french) + rng.choice(["", "", "s", "er"]) for _ in range(60)]
        toxic = i % 8 == 3
        if toxic:
            words[10:10] = "you are a stupid worthless idiot".split()
        rows.append((i, " ".join(words), ["fr", "en"][i % 2], f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[5][1] + " tail", "en", "s2"), (202, None, None, None), (203, "", "en", None), (204, "1 2 3", "en", "s0")]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs_frame(rows).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_named_like_helpers(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n in docs.columns if n not in ("doc_id", "text", "lang", "source", "n_chars")]
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, corpus)
        assert found.schema == docs.schema, name
        docs = common.settle(found, f"test-{name}")
        kept = docs.collect()
        assert kept and all(tuple(r[n] for n in names) == VALUES for r in kept), name
        rows[name] = {r["doc_id"] for r in kept}
    clean = {i for i in range(160) if i % 8 != 3}
    assert {202, 203, 204}.isdisjoint(rows["language_id"]) and set(range(160)) <= rows["language_id"]
    assert len(clean - rows["toxicity"]) <= 2 and len(rows["toxicity"] & {i for i in range(160) if i % 8 == 3}) <= 4
    assert len({5, 200, 201} & rows["ngram_join"]) == 1 and min({5, 200, 201} & rows["toxicity"]) in rows["ngram_join"]


def test_pipeline_runs_over_all_that_stays(spark, corpus):
    pieces = corpus_pipeline.run(spark, corpus).collect()
    assert pieces and {r["doc_id"] for r in pieces}.isdisjoint({202, 203, 204})
    held = {}
    for r in pieces:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
    assert max(held.values()) == 1024 and sum(n < 1024 for n in held.values()) <= 1


def test_written_shards_keep_columns_named_like_helpers(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert read.count() == docs.count()
    back = read.select(*[c for c in docs.columns if c != "shard"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, docs.drop("shard").collect()), key=str)


def test_an_outlier_does_not_spoil_the_cells(spark, docs_frame):
    rows = [(i, "t", "en", f"https://example.org/{i % 100:03d}") for i in range(1600)] + [(9999, "t", "en", "A")]
    celled, cells = sharding.with_cells(sharding.described(docs_frame(rows)), ["source"], [])
    per_cell = [r["count"] for r in celled.groupBy(cells[0]).count().collect()]
    assert len(per_cell) >= 95 and max(per_cell) <= 32
    placed = sharding.shard_rows(sharding.described(docs_frame(rows)), ["source"], []).collect()
    spread = {}
    for r in placed:
        spread.setdefault(r["shard"], set()).add(r["source"])
    assert all(len(s) <= 16 for s in spread.values())


def test_running_total_with_columns_named_like_helpers(spark):
    rows = spark.createDataFrame([(i, 5, 6, 7, 8, 9) for i in range(30)], "id long, run long, row long, total long, offset long, inside long")
    got = running_total(rows, [], ["id"], "run", "before", "t").collect()
    assert all(r["before"] == 5 * r["id"] and tuple(r[1:6]) == (5, 6, 7, 8, 9) for r in got) and len(got) == 30


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_chains_take_few_rounds(spark, monkeypatch, order):
    names = {"ascending": list(range(1000)), "descending": list(range(999, -1, -1)), "shuffled": random.Random(2).sample(range(1000), 1000)}[order]
    written = []
    real = common.settle
    monkeypatch.setattr(common, "settle", lambda df, label: written.append(label) or real(df, label))
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    found = components(edges, "t").collect()
    assert len(found) == 1000 and {r["component"] for r in found} == {0}
    rounds = sum(label in ("t-jumps", "t-moves") for label in written)
    assert rounds <= 18 and written.count("t-jumps") <= 12


def test_stars_and_cliques(spark):
    star = [(0, i) for i in range(1, 400)]
    cliques = [(i, j) for base in (1000, 2000) for i in range(base, base + 40) for j in range(i + 1, base + 40)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(star + cliques, "a long, b long"), "t").collect()}
    assert len(found) == 400 + 80 and all(c == (0 if n < 1000 else n - n % 1000) for n, c in found.items())


@pytest.mark.parametrize("keys", [500, 5000])
def test_cascade_levels_do_not_grow_with_the_universe(spark, keys):
    universe = spark.range(keys).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit("/")).alias("key"))
    listed = [f"host{i}/" for i in range(0, 50, 5)]
    cascade = url_filter.Cascade(universe, listed)
    assert all(level.bits <= 64 * 8 for level in cascade.levels)
    assert sorted(r["key"] for r in universe.where(cascade.contains(F.col("key"))).collect()) == sorted(listed)
