"""The dealt operators against brute force on small and awkward inputs."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

from canlake.llm import embeddings, imatch, language, near_duplicates, packing, sharding, token_files, toxicity, url_filter
from canlake.llm import kernels as K
from canlake.llm.common import components, reach_workers, running_total
from canlake.llm.mixing import measured, mixed_documents, mixed_rows
from canlake.llm.tokens import VOCABULARY, PieceEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, weight double"
WEIRD = ["", " ", "a  b", "x　y", " \n a", "é è", "a  b", "it's me 's", "  lead", "tail  ", "a \t b\n\n c", "日本 語 x",
         "\U0001f389 b \U0001f389 \U0001f389", "<|endoftext|> x", "line\nline", "a1b 2c3", "×. ÷, z", None]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, a long text, copies, repeated rows and columns named like results."""
    reach_workers(spark)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    texts = list(WEIRD)
    for i in range(40):
        w = list(rng.choice(words, 60))
        texts.append(" ".join(w))
        if i % 2:
            w[int(rng.integers(0, 60))] = "edit"
            texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words, 30_000)), texts[20], texts[20]]
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "a", "b", "b", "b"][i % 5], 0, 1, 0.5) for i, t in enumerate(texts)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_ids(text):
    return PieceEncoder(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_like_whole_texts():
    encoder = PieceEncoder(VOCABULARY)
    data, offsets = K.text_buffers(pa.array(WEIRD))
    for _ in range(2):  # new, then known pieces
        ids, at = encoder.encode(data, offsets)
        for i, text in enumerate(WEIRD):
            assert ids[at[i] : at[i + 1]].tolist() == reference_ids(text)


def same_as_library(encoder, library, texts, **size):
    data, offsets = K.text_buffers(pa.array(texts))
    for _ in range(2):  # new, then known pieces
        ids, at = encoder.encode(data, offsets, **size)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_encode_like_the_library(tmp_path):
    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, end + end, f"a{end}b", f"a {end}\n{end} b", f"x\n\n {end}\t\n y", f" {end} ", "<|endof", "text|>", "<|endoftext|",
             f"<|{end}|> it's{end}'s", f"\u00e9{end}\u00e9 1{end}2", "PAD a PADa bPAD <m>\nc d\n<m> e <m> f", "a<w>b <w> c<w> <w>d"]
    same_as_library(PieceEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), texts)
    library = Tokenizer.from_file(VOCABULARY)
    library.add_tokens(["PAD", AddedToken("<m>", lstrip=True, rstrip=True, normalized=False), AddedToken("<w>", single_word=True, normalized=False)])
    library.save(str(tmp_path / "more.json"))
    same_as_library(PieceEncoder(str(tmp_path / "more.json")), Tokenizer.from_file(str(tmp_path / "more.json")), texts)


def test_block_ends_do_not_split_white_space(tmp_path):
    wide = ["\u00a0", "\u0085", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000"]
    runs = [" ", "\n", "  ", "\n\n", "\n\n ", " \n  ", "\t\t \n\n\n", "     ", "\x1c \n ", *wide, *(f"{w} \n {w} " for w in wide)]
    texts = ["return a\n\n def", "".join(f"a{r}b,{r}\u00e9{r}\u65e5{r}\u3042{r}<|endoftext|>{r}" for r in runs), " \n\n\n  ", "\n\n tail \n\n "]
    library = Tokenizer.from_file(VOCABULARY)
    for size in (1, 2, 3, 5, 8, 9, 10, 11, 40):
        same_as_library(PieceEncoder(VOCABULARY), library, texts, size=size)
    library.add_tokens(["two  words", AddedToken("<m>", lstrip=True, rstrip=True, normalized=False)])
    library.save(str(tmp_path / "more.json"))
    texts = ["a two  words b two  word c", "a <m>  b \n<m>\n\n c  <m> d"]
    for size in (1, 2, 3, 5, 8):
        same_as_library(PieceEncoder(str(tmp_path / "more.json")), library, texts, size=size)


def test_control_bytes_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32)
    control, data = token_files.encode_ranks(ranks)
    assert len(control) == 2 and len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4
    assert token_files.decode_ranks(control, data).tolist() == ranks.tolist()


def test_token_files_hold_all_ids(spark, docs, empty, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "f"))
    read = token_files.read_token_files(spark, str(tmp_path / "f")).orderBy("part", "row").collect()
    want = sorted((r["doc_id"], reference_ids(r["text"]) + [2]) for r in docs.collect())
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read] == want
    token_files.write_token_files(empty, str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_packing_places_each_id_once(docs, empty):
    rows = packing.pack(docs).collect()
    ids = {r["doc_id"]: reference_ids(r["text"]) + [0] for r in docs.collect()}
    twice = max(ids)  # this row is repeated
    covered = {}
    for r in rows:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
    for doc, found in covered.items():
        assert sorted(found) == sorted(list(range(len(ids[doc]))) * (2 if doc == twice else 1))
    assert set(covered) == set(ids)
    by_window = {}
    for r in rows:
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for n, pieces in by_window.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or n == max(by_window)
    assert packing.pack(empty).count() == 0


def test_mixing_meets_targets(docs, empty):
    rows = [r.asDict() for r in mixed_rows(measured(docs, "t")).collect()]
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * s + 1e-9 for t, s in targets.values()) and all(0 <= r["copies"] <= 2 for r in rows)
    again = [r.asDict() for r in mixed_rows(measured(docs, "t")).collect()]
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixed_documents(docs).columns == docs.columns and mixed_documents(empty).count() == 0


def test_shards_differ_by_one_row(docs, empty):
    rows = sharding.described(docs)
    placed = sharding.shard_rows(rows, ["lang", "source"], ["size"]).collect()
    assert len(placed) == docs.count()
    slots = {}
    for r in placed:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and set(slots) == set(range(8))
    assert sharding.shard_rows(sharding.described(empty), ["lang", "source"], ["size"]).count() == 0


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_neighbours_touch(spark, dims):
    from pyspark.sql import functions as F

    side = 8
    grid = spark.range(side**dims).select(*[F.expr(f"cast(id div {side**d} % {side} as int)").alias(f"c{d}") for d in range(dims)])
    found = grid.select("*", sharding.hilbert_index([F.col(f"c{d}") for d in range(dims)], 3).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in found] == list(range(side**dims))
    for a, b in zip(found, found[1:]):
        assert sum(abs(a[f"c{d}"] - b[f"c{d}"]) for d in range(dims)) == 1


def test_imatch_follows_the_next_document(docs, empty):
    import hashlib

    unique = docs.dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in imatch.fingerprinted(unique).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in unique.collect()}
    order = sorted(texts)
    for i, doc in enumerate(order):
        text, after = texts[doc], texts[order[(i + 1) % len(order)]]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert rows[doc]["n_chars"] == len(text) and rows[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[doc]["near_edited"] <= 1 and 0 <= rows[doc]["near_next"] <= 1
    by_text = {}
    for doc, text in texts.items():
        assert by_text.setdefault(text, rows[doc]["fingerprint"]) == rows[doc]["fingerprint"]
    assert imatch.fingerprinted(empty).count() == 0


@pytest.mark.parametrize("counted", [1 << 20, 64])
def test_imatch_lexicon_is_exact_whatever_the_number_of_words(spark, monkeypatch, counted):
    """Texts with a few common words and more distinct ones than the sketch has counters; tasks pass words on early, too."""
    reach_workers(spark)
    monkeypatch.setattr(imatch, "COUNTED", counted)
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(400)]
    rare = 60_000 if counted > 64 else 50
    texts = [" ".join([*rng.choice(common, 60), *(f"r{i}x{k}" for k in range(rare))]) for i in range(40)] + [None, "", "one", "one"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {}
    for t in texts:
        for w in set((t or "").split()):
            found[w] = found.get(w, 0) + 1
    n = len(texts)
    want = [w for w, f in found.items() if imatch.BAND[0] <= np.log(n / f) / np.log(n) <= imatch.BAND[1]]
    data, offsets = K.text_buffers(pa.array(want))
    words, at = imatch.distinct_words(data, offsets)
    assert 50 < len(want) == len(words) and imatch.lexicon(docs).tolist() == sorted(words.tolist())


def test_language_and_toxicity_on_awkward_rows(spark, docs, empty):
    marked = language.with_language(docs, language.trained(docs, steps=5))
    assert marked.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    for r in marked.collect():
        text = r["text"] or ""
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text))) and 0 <= r["score"] <= 1
    assert language.with_language(empty, language.trained(empty)).count() == 0
    labels = spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    scored = toxicity.with_toxicity(docs, toxicity.trained(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.with_toxicity(empty, toxicity.trained(empty, labels)).count() == 0


def test_language_learns_every_language(spark, monkeypatch):
    """Six languages where samples are full for two; one has two texts, one has empty texts as well."""
    reach_workers(spark)
    monkeypatch.setattr(language, "LANGUAGES", 2)
    rows = [(i, f"{c * 9} {c} {c * 3}", c * 2) for i, c in enumerate("abcd" * 12)] + [(100 + i, "", "zz") for i in range(8)]
    rows += [(200 + i, "zz z zzzz", "zz") for i in range(12)] + [(300 + i, "e eee ee", "ee") for i in range(4)]
    found = spark.createDataFrame(rows, "doc_id long, text string, lang string").where("length(text) = 0 or lang <> 'ee' or doc_id = 300 or doc_id = 301")
    classes, windows, labels = language.training_windows(found)
    assert classes == ["aa", "bb", "cc", "dd", "ee", "zz"] and set(labels.tolist()) == set(range(6)) and len(windows) == len(labels)
    marked = language.with_language(found.where("length(text) > 0"), language.trained(found)).collect()
    assert all(r["lang_pred"] == r["lang"] for r in marked)


def test_language_samples_stay_bounded(spark, monkeypatch):
    reach_workers(spark)
    monkeypatch.setattr(language, "PER_LANGUAGE", 30)
    monkeypatch.setattr(language, "LEAST", 5)
    many = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 100) AS lang")
    classes, _, labels = language.training_windows(many)
    each = np.bincount(labels)
    assert len(classes) == 100 and each.min() > 0 and abs(len(labels) - 19 * 100) < 200


def test_language_stage_keeps_texts_between_languages(spark):
    """Each text is there in four languages, so no language can have a clear share; only null, empty and letterless texts go."""
    texts = [f"casa {i} menu radio {i * i} hotel" for i in range(12)]
    rows = [(4 * i + k, text, lang) for i, text in enumerate(texts) for k, lang in enumerate(("de", "en", "es", "fr"))]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "12 34 !", "es")]
    found = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_stage(spark, found, "")
    assert kept.columns == found.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(4 * len(texts)))


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 0.0, 1.0, 0.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def brute_components(texts, width, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
        if not changed:
            break
    return sets, label


def test_sketches_never_differ_more_than_their_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 12, 300, 6000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) << np.uint64(12)
        for gone in (0, n // 20, n // 3):
            other = np.unique(np.append(base[gone:], rng.integers(0, 2**51, gone, dtype=np.uint64) << np.uint64(12)))
            bits = near_duplicates.sketch_of(base) ^ near_duplicates.sketch_of(other)
            assert len(bits) * 64 == near_duplicates.SKETCH_BITS
            differ = np.unpackbits(bits.view(np.uint8)).sum()
            members = len(np.setxor1d(base, other))
            assert differ <= members and (members - differ) % 2 == 0 and bool(differ) <= bool(members)


@pytest.mark.parametrize("frequent", [False, True])
def test_ngram_join_equals_brute_force(spark, docs, empty, monkeypatch, frequent):
    """Also with nearly all shingles in the frequent classes, which are indexed by combinations."""
    if frequent:
        monkeypatch.setattr(near_duplicates, "classes_of", lambda counts: (1 + (counts > 1) + (counts > 3)).astype(np.uint8))
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(0, 400)}" for _ in range(90)]
    texts = []
    for i in range(60):  # a large group around the threshold, of many sizes
        w = list(base[: 90 - int(rng.integers(0, 12))])
        for p in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[int(p)] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:n]) for n in (1, 2, 3, 4, 5, 9, 10, 11, 12, 14, 15, 16, 17, 25, 26, 27, 28, 29)]
    texts += [r["text"] for r in docs.where("doc_id < 60").orderBy("doc_id").collect()]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates.near_duplicate_groups(found, "doc_id", 4, 85).collect()}
    sets, label = brute_components(texts, 4, 85)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == label
    if not frequent:
        assert near_duplicates.near_duplicate_groups(empty.select("doc_id", "text"), "doc_id", 4, 85).count() == 0


@pytest.mark.parametrize("percent", [85, 80])
def test_isolated_pairs_link_across_the_spare(spark, percent):
    """Pairs that meet nothing else, of sizes on both sides of where the spare begins and of larger ones."""
    texts = []
    for size in (*range(18, 32), 60, 100):
        for more in (0, 1, 2, 3, 4, 5, 6, 8, size // 6, size // 5, size // 4):
            words = [f"p{len(texts)}w{i}" for i in range(size + 3 + more)]
            texts += [" ".join(words[: size + 3]), " ".join(words)]
            texts += [" ".join(f"q{w}" for w in words[more:]), " ".join(f"q{w}" for w in words)]
    found = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_groups(found, "doc_id", 4, percent).collect()}
    for i in range(0, len(texts), 2):
        _, label = brute_components(texts[i : i + 2], 4, percent)
        assert [got[i], got[i + 1]] == [i + k for k in label], (texts[i].count(" ") - 2, texts[i + 1].count(" ") - 2)


def test_near_vectors_equal_brute_force(spark):
    reach_workers(spark)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    vectors = [*base, *(base[0] + rng.normal(scale=0.06, size=16) for _ in range(40)), *(base[1] + rng.normal(scale=0.2, size=16) for _ in range(20))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] * 16), (504, [1.0, None]), (505, [1.0, 2.0]), (506, [2.0, 4.0])]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (found <= near).all() and found.sum() >= 0.98 * near.sum()
    assert [got[i]["n_links"] for i in range(500, 507)] == [0, 0, 0, 0, 0, 1, 1] and got[506]["component_id"] == 505
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embeddings.near_vectors(empty).count() == 0


def test_url_rules(spark):
    urls = [None, "no scheme", "http://", "http://X.Example.ORG/es/1?a=/b", "http://example.org/en/12#x", "http://org/", "http://notexample.org/es/",
            "http://a.com/de/", "http://a.com/fr/x", "http://a.com?u=http://b.com/de/", "http://org", "http://example.net/es/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(rows, list(url_filter.ALLOW), list(url_filter.BLOCK)).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[3] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert [got[i][2] for i in range(4, 12)] == ["example.org/en/1", "org/", "org/", "com/de/", "com/fr/", None, None, None]
    assert [got[i][3] for i in (4, 5, 7, 8)] == ["block", "allow", "block", "allow"]


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = [f"k{i}" for i in range(0, 3000, 11)]
    cascade = url_filter.Cascade(universe, listed)
    assert len(cascade.levels) > 1
    from pyspark.sql import functions as F

    assert sorted(r["key"] for r in universe.where(cascade.contains(F.col("key"))).collect()) == sorted(listed)


def test_running_total_and_components(spark):
    rows = spark.createDataFrame([(i, [None, "a"][i % 2], i) for i in range(50)], "id long, g string, v long")
    got = {r["id"]: r["before"] for r in running_total(rows, ["g"], ["id"], "v", "before", "t").collect()}
    assert all(got[i] == sum(range(i % 2, i, 2)) for i in range(50))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r["component"] for r in components(edges, "t").where("node < 90").collect()} == {1}
    assert components(edges.where("a < 0"), "t").count() == 0
